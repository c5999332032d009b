"""The manifest's digests and proofs against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import merkle
from maskwright.llm.entry import op11_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    """[nodes of each level], up to one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def beside(tree, at):
    for nodes in tree[:-1]:
        run = at - at % 3
        yield nodes[run:at], nodes[at + 1 : run + 3]
        at //= 3


def plain(rows, now):
    """Rows of the manifest; ``now`` gives a row's present text."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaf = lambda r: sha("".join(value(r[f]) for f in FIELDS))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for i, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            done, siblings = leaf(r | {"text": now(r)}), ""
            for left, right in [*beside(trees[s], at), *beside(top, i)]:
                done, siblings = sha("".join([*left, done, *right])), siblings + "".join(left + right)
            yield r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], sha(siblings), done, done == top[-1][0]


def tampered(r):
    if r["doc_id"] is None or r["text"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2:
        return r["text"]
    return r["text"].replace("\n", "")


NAMES = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels_in_block", [1, 2, 5])
def test_manifest(table, odd_rows, monkeypatch, levels_in_block):
    """Blocks of 3, 9 and 243 rows, so with several tiers and with one, give the plain rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels_in_block)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels_in_block)
    rng = random.Random(4)
    sources = [None, "", "a", "b", "B", "é", "日", *(f"s{i}" for i in range(12))]
    rows = [(i, f"{t}\nline" if t and i % 3 else t, rng.choice(["en", None]), rng.choice(sources)) for i, t in odd_rows]
    rows += [(1000 + i, f"hot\n{i}", "en", "hot") for i in range(120)] + [(None, "no id\n", None, "a"), (2000, "alone\n", None, "alone"), (2001, "x\n", None, None), (2001, "x\n", None, None)]
    docs = table(rows)
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    text = F.when(~odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(docs, FIELDS, now={"text": text}).collect()
    assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in out) == Counter(plain([r.asDict() for r in docs.collect()], tampered))


def test_manifest_of_few_rows(table):
    for rows in ([], [(1, "only\n")], [(1, "a", None, "x"), (2, "b", None, "x")], [(1, "a", None, "x"), (2, "b", None, None)]):
        docs = table(rows)
        out = merkle.manifest(docs, FIELDS).collect()
        want = list(plain([r.asDict() for r in docs.collect()], lambda r: r["text"]))
        assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in out) == Counter(want)
        assert all(r.verified for r in out)


def test_registered_query(spark, table, odd_rows, tmp_path):
    docs = table(odd_rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", *NAMES]
    assert Counter(tuple(r) for r in out.collect()) == Counter(plain([r.asDict() for r in docs.collect()], tampered))
