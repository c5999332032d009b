"""Token counts of every prefix of a text, stored once; questions about lengths and budgets are answered from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, new_table, release, slices
from .subwords import Ragged, Units, piece_model, unit_starts, with_blank

LIMIT = 4096
_STORED = "n_bytes long, width int, steps binary"


class PrefixCounter:
    """Steps of the token count from character to character; each distinct unit of text goes through the prefixes once."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.forget()

    def forget(self) -> None:
        self.units, self.steps = Units(), Ragged(np.int32)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, offsets) of texts: a text's steps add up to the tokens of each of its prefixes, one step a character."""
        if self.units.full:
            self.forget()
        data, offsets = with_blank(data, offsets)
        start = unit_starts(data, offsets, self.model.together)
        length = np.append(start[1:], len(data))[: len(start)] - start
        numbers, new = self.units.numbers(data, start, length)
        if new:
            self.steps.append_flat(*self.model.steps([data[start[i] : start[i] + length[i]].tobytes().decode("utf-8", "replace") for i in new]))
        steps = self.steps.of(numbers)
        upto = np.concatenate(([0], np.cumsum(self.steps.lengths(numbers))))[np.searchsorted(start, offsets)]
        # The blank before a text is no character of it: its step goes to the first one.
        blanks = upto[:-1][np.diff(upto) > 0]
        steps[blanks + 1] += steps[blanks]
        keep = np.ones(len(steps), bool)
        keep[blanks] = False
        return steps[keep], upto - np.concatenate(([0], np.cumsum(np.diff(upto) > 0)))


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_bytes, width, steps``: by how much the count of tokens grows from each character to the next.

    The sum of the first n steps is the exact number of tokens of the first n characters, as the
    library gives it for that prefix alone, without begin or end tokens. ``steps`` are signed little-endian integers of ``width`` bytes.
    A null text counts as empty and has no steps; ids are kept as they are, repeated or null, and no other column is read.
    Nothing moves between executors; a text is whole in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            ids, text = columns(batch, "id", "text")
            for row, end, data, offsets in slices(text):
                steps, at = counter.count(data, offsets)
                width, packed = [], []
                for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                    mine = steps[a:b]
                    kind = "<i1" if not len(mine) or max(int(mine.max()), -int(mine.min())) < 128 else "<i4"
                    width.append(int(kind[2]))
                    packed.append(mine.astype(kind).tobytes())
                yield pa.record_batch([ids.slice(row, end - row), pa.array(np.diff(offsets), pa.int64()), pa.array(width, pa.int32()), pa.array(packed, pa.binary())], ["id", "n_bytes", "width", "steps"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_STORED}").withColumnRenamed("id", id_col)


def answers(stored: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit, fit_chars`` from stored prefix counts; no text is encoded again.

    ``fit_chars`` is the number of characters of the longest prefix that has at most ``limit`` tokens. Counts can fall
    where a character completes a longer token, so this is the last such prefix, not the first excess.
    """
    id_col = stored.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_bytes, width, steps = columns(batch, "id", "n_bytes", "width", "steps")
            total, fit = [], []
            for w, s in zip(width.to_pylist(), steps, strict=True):
                counts = np.cumsum(np.frombuffer(s.as_buffer() or b"", f"<i{w}"), dtype=np.int64)
                total.append(int(counts[-1]) if len(counts) else 0)
                fit.append(len(counts) if not len(counts) or counts[-1] <= limit else int(np.max(np.flatnonzero(counts <= limit), initial=-1)) + 1)
            total = np.array(total, np.int64)
            yield pa.record_batch([ids, n_bytes, pa.array(total), pa.array(total > limit), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = stored.withColumnRenamed(id_col, "id")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("id", id_col)


def prefix_tokens(steps: bytes, width: int, chars: int) -> int:
    """Tokens of the first ``chars`` characters of one stored text."""
    return int(np.frombuffer(steps, f"<i{width}")[:chars].sum(dtype=np.int64))


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Write the prefix counts of ``docs``, in the shared folder where no path is given, and answer from them."""
    path = path or new_table(docs.sparkSession, "prefix-counts")
    prefix_counts(docs, model).write.parquet(path)
    return answers(docs.sparkSession.read.parquet(path), limit)
