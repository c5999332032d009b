"""Faults that were found after an operator was done."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import media, mixing, packing, secrets, tokens
from maskwright.llm.entry import tokenizer_path


def test_no_document_repeats_more_than_its_cap(table):
    rows = [(i, " ".join("w" * 3 for _ in range(5)), None, "small") for i in range(4)] + [(10 + i, "", None, "small") for i in range(40)] + [(100 + i, "w " * 50, None, "large") for i in range(40)]
    out = mixing.mix(table(rows)).collect()
    capped = [r for r in out if r.source == "small"]
    assert capped[0].target == 3 * capped[0].source_size
    assert max(r.repeats for r in out) <= 3 and all(r.repeats == 3 for r in capped if r["size"])


def test_media_columns_of_given_names(table):
    docs = media.text_to_media(table([(1, "text"), (2, None)])).withColumns({"payload_bytes": F.lit("given"), "Feature": F.lit(1), "other": F.lit("x")})
    out = media.media_features(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {(r.doc_id, r.payload_bytes, r.other) for r in out.collect()} == {(1, 192, "x"), (2, 192, "x")}


def test_token_files_keep_the_ids_type(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None), ("é", "x")], "doc_id string, text string")
    out = tokens.token_files(docs, tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, "a", "b", "é"] and out[0].n_tokens == 1 and out[1].start == 1


def test_random_strings_beside_base_spans(table):
    rng = random.Random(12)
    letters, digits = secrets.ALPHABET[:62], "0123456789abcdef"
    run = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    texts = [f"G{run(18)}G{run(32, digits)}G{run(38)}", f"x{run(7)} token={run(9)}/{run(5)}.{run(30)} {run(8)}", f"AKIA{run(3)}{run(20)}", "é " + run(300), f"{run(40, digits)}{run(12)}{run(40, digits)}", "password=short " + run(12), ""]
    pool = ["token=", run(9), run(33, digits), " ", "=", "secret: ", "AKIA" + "B" * 14, "z", "日", "apikey='", run(15)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts.append(" ".join(rng.choice(pool) + rng.choice(pool) for _ in range(3000)))
    weights = [rng.uniform(-1, 1.6) for _ in range(len(secrets.ALPHABET) ** 2)]
    out = {r.doc_id: r.spans for r in secrets.scan(table(list(enumerate(texts))), weights).collect()}
    found = 0
    for i, t in enumerate(texts):
        given = [x[7:] for x in out[i].split(",") if x.startswith("markov:")]
        assert given == brute.random_strings(t, weights, secrets.ALPHABET, secrets.LEAST, secrets.THRESHOLD, secrets.PER_CHAR), t
        assert ",".join(x for x in out[i].split(",") if x and not x.startswith("markov:")) == brute.secrets(t)[-1]
        found += len(given)
    assert found > 100


def test_secret_models_count_every_pair_of_long_words(table):
    rng = random.Random(1)
    word = "".join(rng.choice("ghijklmn") for _ in range(5000))
    n = len(secrets.ALPHABET)
    long_, short = (secrets.fit(table([(1, t)]), fit_docs=10) for t in (word, "x"))
    pairs = [[0.5] * n for _ in range(n)]
    for a, b in zip(word, word[1:], strict=False):
        pairs[secrets.ALPHABET.index(a)][secrets.ALPHABET.index(b)] += 1
    for a in "ghijklmn":
        i = secrets.ALPHABET.index(a)
        expected = [np.log((0.5 / n + 0.5 / n) / (x / sum(pairs[i]))) for x in pairs[i]]
        assert long_[i * n : i * n + n] == pytest.approx(expected)
    assert short != long_


def test_short_random_strings_are_found(spark, table):
    rng = random.Random(4)
    words = ["configuration", "connections", "international", "organization", "documents", "maximum", "directory", "Builder", "retries", "quality", "just", "vowels", "zigzag", "exchange", "of", "the"]
    words += [w.upper() for w in words] + ["1234567890", "20240115", "year_2024", "1000000", "98765432"]
    plain = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" token=" + "".join(rng.choice("0123456789abcdef") for _ in range(32)) if i % 4 == 0 else "")) for i in range(400)]
    keys = [(1000 * n + i, "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))) for n in (12, 16, 20) for i in range(100)]
    found = {r.doc_id: r.spans for r in secrets.scan(table([*plain, *keys]), secrets.fit(table(plain))).collect()}
    assert min(sum(found[i] != "" for i, k in keys if len(k) == n) for n in (12, 16, 20)) >= 95
    assert not any("markov" in found[i] for i, _ in plain)


def test_evolution_packs_what_best_fit_cannot():
    for seed in range(4):
        rng, sizes = np.random.default_rng(seed), []
        for _ in range(30):  # three items fill a bin, and none of them goes with another one
            a = int(rng.integers(380, 490))
            b = int(rng.integers(200, (1000 - a) // 2 + 1))
            sizes += [a, b, 1000 - a - b]
        sizes = rng.permutation(np.array(sizes, np.int64))
        plain = np.full(len(sizes), -1)
        packing.best_fit(sizes.tolist(), list(range(len(sizes))), {}, plain, 1000, 0)
        best = packing.evolve(sizes, [], 1000, seed, generations=10, population=6)
        assert best.min() >= 0 and packing._loads(best, sizes).max() <= 1000
        assert 30 <= len(np.unique(best)) <= len(np.unique(plain)) - 2
