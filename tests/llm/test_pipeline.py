from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from maskwright.llm import langid, mixing
from maskwright.llm.entry import tokenizer_path


def test_stages(spark, table, odd_rows, tmp_path):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, t in odd_rows] + [(None, "no id at all", None, "a")]
    docs = table(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if k == 0:
            assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()} == {300, 301, 302, 303}
        if k == 1:
            texts = [r.text for r in out.collect()]
            assert len(texts) == len(set(texts)) == len({t for i, t in odd_rows if i not in (300, 301, 302, 303)} | {"no id at all"})
        docs = out
    assert out.count() > 0


@pytest.mark.parametrize("k", range(4))
def test_stages_of_an_empty_table(spark, table, k):
    assert corpus_pipeline.STAGES[k][1](spark, table([]), "").count() == 0


def test_near_copies_with_repeated_and_null_ids(spark, table):
    group = lambda name: [" ".join(f"{name}{i}" for i in range(60)) + f" tail{k}" for k in range(3)]
    rows = [(5, t) for t in group("a")] + [(5, t) for t in group("b")] + [(None, t) for t in group("c")] + list(zip([None, 9, 8], group("d"), strict=True)) + [(5, ""), (5, "alone")]
    out = [(r.doc_id, r.text[:1]) for r in corpus_pipeline.near_copies(spark, table(rows), "").collect()]
    assert sorted(out, key=str) == sorted([(5, "a"), (5, "b"), (None, "c"), (8, "d"), (5, ""), (5, "a")], key=str)


def test_mix_and_languages_equal_plain_versions(table, odd_rows):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), lang, rng.choice(["s", "t", "u", "u", "u", None])) for i, (lang, words) in enumerate(rng.choices([("en", ["the", "and", "with", "house."]), ("de", ["der", "und", "mit", "schön,"]), (None, ["und", "the", "1 2"])], k=400))]
    rows += [(1000 + k, t, None, "only odd") for k, (_, t) in enumerate(odd_rows) if t != "same row"]
    docs = table(rows)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    want = brute.mix([(i, t, s) for i, t, _, s in rows])
    assert len(got) == len(want)
    for i, s, n, target, repeats in want:
        assert (got[i].source, got[i].size, got[i].taken) == (s, n, repeats * n) and abs(got[i].target - target) < 1e-6
    found = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()}
    assert found == {i: (lang, round(score, 9)) for i, (lang, score) in brute.languages([(i, t, lang) for i, t, lang, _ in rows]).items()}


def test_run_equals_plain_stages(spark, table, odd_rows, tmp_path):
    rng = random.Random(5)
    rows = {i: (i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", None])) for i, t in odd_rows}
    for i in range(400, 430):  # near copies
        words = (rows[i % 7][1] + " " + rows[307][1][:600]).split()
        words[rng.randrange(len(words))] = f"changed{i}"
        rows[i] = (i, " ".join(words), None, rng.choice("ab"))
    table(list(rows.values())).write.parquet(str(tmp_path / "documents.parquet"))
    spoken = brute.languages([r[:3] for r in rows.values()])
    last = {t: i for i, t, *_ in sorted(rows.values(), key=lambda r: r[0]) if spoken[i][0] != "und"}
    near = brute.jaccard([(i, t) for t, i in last.items()], 5, 80)
    left = [i for i, (_, least) in near.items() if i == least]
    assert len(left) < len(last) < len(rows)
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, _, _, _, repeats in brute.mix([(i, rows[i][1], rows[i][3]) for i in left]):
        ids = plain.encode(rows[i][1], add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += repeats
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +want
    ends = Counter()
    for r in out:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_packing_of_an_empty_table(spark, table):
    assert corpus_pipeline.packed(spark, table([]), "").count() == 0


def test_stages_keep_columns_of_working_names(spark, table):
    docs = table([(1, "one two three", "en", "a"), (2, "one two three", "en", "a"), (2, "one two three", "en", "a"), (3, "vier fünf", "de", None)])
    docs = docs.withColumnsRenamed({"key": "__mw_key", "id": "__mw_id", "block": "__mw_n", "name": "__mw_side"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r["__mw_key"], r["__mw_side"]) for r in out.collect()} == {("y", "z")}
