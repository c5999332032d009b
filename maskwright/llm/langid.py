"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, forget_tokenizers, release, slices

#: N-grams in a profile, of a language as of a document.
TOP = 300
#: Labelled documents read for each language's profile, about; chosen by a hash of the id.
FIT_DOCS = 20_000
#: N-grams of documents that a task holds before it sums them up.
HELD = 1 << 20
UNKNOWN = "und"


@lru_cache
def _fold() -> np.ndarray:
    """Code point to lower-case letter; 1 stands for all that is no letter."""
    table = np.ones(0x110000, np.uint64)
    for i in range(0x32400):
        if (c := chr(i)).isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def _top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes in rank order; ties by code."""
    if len(codes) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:k]]


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 letters, word edges as blanks, and their counts."""
    letters = _fold()[points]
    is_letter = letters > 1
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    edge = np.ones(1, np.uint64)
    s = np.concatenate((edge, letters[keep], edge))
    two = (s[:-1] << np.uint64(21)) | s[1:]
    three = (two[:-1] << np.uint64(21)) | s[2:]
    return np.unique(np.concatenate((s[s > 1], two, three)), return_counts=True)


def _points(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, _, data, offsets in slices(column):
        text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        for i in range(len(offsets) - 1):
            yield row + i, text[starts[i] : starts[i + 1]]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Each language's most frequent n-grams in rank order, from all rows of ``labelled``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for name, parts in found.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.record_batch([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            text, lang = columns(batch, "text", "lang")
            for i, points in _points(text):
                part = _grams(points)
                found.setdefault(lang[i].as_py(), []).append(part)
                held += len(part[0])
                if held > HELD:
                    yield from sums()
                    held = 0
        yield from sums()
        release()

    counts = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():  # at most `top` rows for each language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``<id_col>, lang_pred, score`` by the least out-of-place distance.

    An n-gram of the document counts the distance of its two ranks, or ``top`` where the profile lacks
    it. ``score`` is one less the distance's share of the largest possible one. Ties go to the language
    that comes first in order. A text that is null, empty or without letters is ``und`` with score 0, and so
    is every text where no profile was learned. Every row gives one row; other columns are not read.
    """
    langs = sorted(profiles)
    known = np.unique(np.array([g for k in langs for g in profiles[k]], np.uint64))
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, k in enumerate(langs):
        ranks[i, np.searchsorted(known, np.array(profiles[k], np.uint64))] = np.arange(len(profiles[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        for batch in batches:
            (text,) = columns(batch, "text")
            names, scores = [UNKNOWN] * len(text), [0.0] * len(text)
            for i, points in _points(text) if langs else ():
                codes = _top(*_grams(points), top)
                if not len(codes):
                    continue
                at = np.searchsorted(known, codes)
                at[known[np.minimum(at, len(known) - 1)] != codes] = len(known)
                there = ranks[:, at]
                away = np.where(there < 0, top, np.abs(there - np.arange(len(codes)))).sum(1)
                best = int(away.argmin())
                names[i], scores[i] = langs[best], max(0.0, 1 - float(away[best]) / (top * len(codes)))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text modulo 3 (a null id counts as empty text); fold 1 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def learned_profiles(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, list[int]]:
    """Profiles from labelled documents outside fold 1, about ``fit_docs`` of each language."""
    labelled = docs.filter(F.col("lang").isNotNull() & (fold_of() != 1))
    share = {r["lang"]: min(1.0, fit_docs / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not share:
        return {}
    of = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    return fit(labelled.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < of * 1_000_000))


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document, learned from the labels outside fold 1.

    Rows that repeat give a row each; a null id is in fold 0; texts of any length are read whole. An empty
    table gives no rows, one without labels ``und`` for all. Ties are those of ``predict``.
    """
    return predict(docs, learned_profiles(docs, fit_docs)).select("doc_id", (fold_of() == 1).alias("held_out"), "lang_pred", "score")
