"""Two tokenizers' tokens of the same text, aligned: groups between common ends, and links of tokens that overlap.

Tokens of a byte range of a text are a fragment: an open prefix up to the first place where tokens of both end,
closed groups, and an open suffix after the last such place. Joining two neighbouring fragments closes what is open
between them, and it does not matter in which order fragments are joined; so ranges of a very long
text are encoded in different tasks and joined as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, columns, release, slices, stored
from .subwords import piece_encoder, plain_encoder, with_blank

#: Texts of more bytes are cut into ranges of so many.
RANGE = 1 << 16
#: Bytes of text aligned at once in a task.
AT_ONCE = 1 << 19
#: Neighbouring fragments that are joined at once.
JOINED = 8
#: Pairs of ids whose counts are sent to all tasks at most; rarer pairs are joined by a shuffle.
SENT = BROADCAST_BYTES // 24

_LINKS = "array<struct<pair:long,times:int>>"
_ROW = f"n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {_LINKS}"
_LINK = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))


class Vocabularies:
    """Encoders of both files, and the digits of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = plain_encoder(path_a), piece_encoder(path_b)
        self.bytes_a, self.bytes_b = self.a.n_bytes, self.b.model.n_bytes
        self.n_b = len(self.bytes_b)
        self.size = len(self.bytes_a) * self.n_b
        n = max(len(self.bytes_a), self.n_b)
        ids = np.arange(n)
        self.width = np.char.str_len(ids.astype(str)).astype(np.int64)
        self.digits = [(48 + ids // 10**k % 10).astype(np.uint8) for k in range(int(self.width.max()))]  # from the last one

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Ids and offsets of both, and which texts both give back."""
        a, a_at = self.a.encode(data, offsets, None)
        b, b_at, exact = self.b.encode(data, offsets)
        ends = np.concatenate(([0], np.cumsum(self.bytes_a[a])))[a_at]
        return a, a_at, b, b_at, exact & (np.diff(ends) == np.diff(offsets))


@dataclass
class Aligned:
    """Groups and links of stretches of text that begin and end where tokens of both do."""

    n_groups: np.ndarray
    n_links: np.ndarray
    text: np.ndarray  # all stretches' groups, each followed by a semicolon
    text_at: np.ndarray
    pairs: np.ndarray  # a * n_b + b, distinct and ascending in each stretch
    times: np.ndarray
    pairs_at: np.ndarray


def align(v: Vocabularies, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, bounds: np.ndarray) -> Aligned:
    """Align tokens by their ends in one coordinate; ``bounds`` are the stretches' ends, the first stretch begins at ``bounds[0]``."""
    base, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    a_end, b_end, bounds = a_end - base, b_end - base, bounds - base
    in_a, in_b = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    in_a[a_end], in_b[b_end] = True, True
    both, edge = in_a & in_b, np.flatnonzero(in_a | in_b)
    upto = lambda flags: np.cumsum(flags, dtype=np.int64)
    ends_a, ends_b, ends = upto(in_a), upto(in_b), upto(both)
    common = np.flatnonzero(both)

    # Each stretch between neighbouring ends lies in one token of each.
    pair = a[ends_a[edge - 1]].astype(np.int64) * v.n_b + b[ends_b[edge - 1]]
    row = np.searchsorted(bounds, edge) - 1
    keys = row * v.size + pair
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    distinct = keys[first]
    rows = np.arange(len(bounds) - 1)

    group_a, group_b = ends[a_end - 1], ends[b_end - 1]
    before_b = np.concatenate(([0], ends_b[common]))[group_a]  # B tokens of earlier groups
    upto_a = ends_a[common][group_b] if len(b) else group_b  # A tokens up to the end of the group
    place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + upto_a
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
    ids[place_a], ids[place_b] = a, b
    sign[place_a[both[a_end]]], sign[place_b[both[b_end]]] = 124, 59
    width = v.width[ids] + 1
    stop = np.cumsum(width)
    text = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    text[stop - 1] = sign
    for k, digit in enumerate(v.digits):
        some = np.flatnonzero(width > k + 1) if k else slice(None)
        text[stop[some] - 2 - k] = digit[ids[some]]
    stop = np.concatenate(([0], stop))
    links = upto(in_a | in_b)
    return Aligned(np.diff(ends[bounds]), np.diff(links[bounds]), text, stop[(ends_a + ends_b)[bounds]], distinct % v.size, np.diff(np.append(first, len(keys))).astype(np.int32), np.searchsorted(distinct, np.append(rows, len(rows)) * v.size))


def _none(kind: type = np.int64) -> np.ndarray:
    return np.zeros(0, kind)


@dataclass
class Open:
    """Tokens of both that no common end closes on one side, with their ends."""

    a: np.ndarray = field(default_factory=_none)
    a_end: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_end: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate((x, y)) for x, y in zip(vars(self).values(), vars(other).values(), strict=True)))


@dataclass
class Fragment:
    """Tokens that end in a byte range. Where no common end is in it (``closed`` false) all are in the prefix."""

    prefix: Open
    closed: bool
    first: int  # first and last common end
    last: int
    groups: bytes
    n_groups: int
    n_links: int
    pairs: np.ndarray
    times: np.ndarray
    suffix: Open
    exact: bool
    n_a: int
    n_b: int

    @staticmethod
    def of(v: Vocabularies, tokens: Open, begin: int, begins: bool, exact: bool) -> Fragment:
        """``begins`` if the range begins the text, at ``begin``."""
        n = (len(tokens.a), len(tokens.b))
        if not exact:
            return Fragment(Open(), False, 0, 0, b"", 0, 0, _none(), _none(), Open(), False, *n)
        common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
        if begins:
            common = np.concatenate(([begin], common))
        if not len(common):
            return Fragment(tokens, False, 0, 0, b"", 0, 0, _none(), _none(), Open(), True, *n)
        first, last = int(common[0]), int(common[-1])
        (a0, a1), (b0, b1) = (np.searchsorted(end, [first, last], "right").tolist() for end in (tokens.a_end, tokens.b_end))
        cut = lambda i, j, k, m: Open(tokens.a[i:j], tokens.a_end[i:j], tokens.b[k:m], tokens.b_end[k:m])
        got = align(v, *vars(cut(a0, a1, b0, b1)).values(), np.array([first, last]))
        return Fragment(cut(0, a0, 0, b0), True, first, last, got.text.tobytes(), int(got.n_groups[0]), int(got.n_links[0]), got.pairs, got.times, cut(a1, None, b1, None), True, *n)

    def then(self, v: Vocabularies, other: Fragment) -> Fragment:
        """This range and the one right after it as one."""
        exact, n = self.exact and other.exact, (self.n_a + other.n_a, self.n_b + other.n_b)
        if not exact:
            return Fragment(Open(), False, 0, 0, b"", 0, 0, _none(), _none(), Open(), False, *n)
        if not self.closed:
            return replace(other, prefix=self.prefix + other.prefix, n_a=n[0], n_b=n[1])
        if not other.closed:
            return replace(self, suffix=self.suffix + other.prefix, n_a=n[0], n_b=n[1])
        between = self.suffix + other.prefix  # one group, or nothing
        got = align(v, between.a, between.a_end, between.b, between.b_end, np.array([self.last, other.first]))
        pairs, place = np.unique(np.concatenate((self.pairs, got.pairs, other.pairs)), return_inverse=True)
        times = np.bincount(place, np.concatenate((self.times, got.times, other.times)), len(pairs)).astype(np.int64)
        groups = self.groups + got.text.tobytes() + other.groups
        return Fragment(self.prefix, True, self.first, other.last, groups, self.n_groups + int(got.n_groups[0]) + other.n_groups, self.n_links + int(got.n_links[0]) + other.n_links, pairs, times, other.suffix, True, *n)

    def whole(self) -> tuple:
        """The values of a whole text."""
        if not self.exact:
            return 0, 0, 0, 0, "", []
        return self.n_a, self.n_b, self.n_groups, self.n_links, hashlib.sha256(self.groups[:-1]).hexdigest(), list(zip(self.pairs.tolist(), self.times.tolist(), strict=True))


_OPEN = "a array<int>, a_end array<long>, b array<int>, b_end array<long>"
_FRAGMENT = ", ".join(f"{side}_{c}" for side in ("prefix", "suffix") for c in _OPEN.split(", ")) + ", closed boolean, first long, last long, groups binary, n_groups long, n_links long, pairs array<long>, times array<long>, exact boolean, n_a long, n_b long"


def _to_row(f: Fragment) -> dict:
    sides = {f"{side}_{k}": x for side in ("prefix", "suffix") for k, x in vars(getattr(f, side)).items()}
    values = sides | {k: x for k, x in vars(f).items() if k not in ("prefix", "suffix")}
    return {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in values.items()}


def _from_row(row: dict) -> Fragment:
    side = lambda s: Open(*(np.array(row[f"{s}_{c}"], np.int64) for c in ("a", "a_end", "b", "b_end")))
    plain = {k: row[k] for k in ("closed", "first", "last", "groups", "n_groups", "n_links", "exact", "n_a", "n_b")}
    return Fragment(side("prefix"), suffix=side("suffix"), pairs=np.array(row["pairs"], np.int64), times=np.array(row["times"], np.int64), **plain)


def ranges(text: bytes, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(begin, end, where its bytes begin, bytes) of each byte range of a text with its blank.

    A range's bytes reach to the nearest places on both sides where both tokenizers begin anew whatever
    stands around: a blank between visible ASCII characters. Of several range ends between the same two
    such places one is kept, so that no byte is in more than a few ranges.
    """
    data = np.frombuffer(text, np.uint8)
    seen = (data > 32) & (data < 127)
    safe = np.flatnonzero((data[1:-1] == 32) & seen[2:] & seen[:-2]) + 1
    safe = np.concatenate(([0], safe, [len(data)]))
    at = np.arange(size, len(data), size)
    low, high = safe[np.searchsorted(safe, at, "right") - 1], safe[np.searchsorted(safe, at)]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(at)]
    at, low, high = at[new], low[new], high[new]
    for begin, end, left, right in zip([0, *at], [*at, len(data)], [0, *low], [*high, len(data)], strict=True):
        yield int(begin), int(end), int(left), text[int(left) : int(right)]


def range_fragment(v: Vocabularies, begin: int, end: int, left: int, raw: bytes) -> Fragment:
    """The fragment of one range: both tokenizers' tokens that end in it."""
    data = np.frombuffer(raw, np.uint8)
    a, _, b, _, exact = v.encode(data, np.array([0, len(data)]))
    tokens = []
    for ids, n_bytes in ((a, v.bytes_a), (b, v.bytes_b)):
        ends = left + np.cumsum(n_bytes[ids])
        mine = (ends > begin) & (ends <= end)
        tokens += [ids[mine].astype(np.int64), ends[mine]]
    return Fragment.of(v, Open(*tokens), begin, begin == 0, bool(exact[0]))


def _short(rows: DataFrame, path_a: str, path_b: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(path_a, path_b)
        for batch in batches:
            ids, text = columns(batch, "id", "text")
            for row, end, raw, raw_at in slices(text, AT_ONCE):
                data, offsets = with_blank(raw, raw_at)
                a, a_at, b, b_at, exact = v.encode(data, offsets)
                used = exact & (np.diff(offsets) > 0)
                some, n_a, n_b = np.flatnonzero(used), np.diff(a_at) * used, np.diff(b_at) * used
                a, b = a[np.repeat(used, np.diff(a_at))], b[np.repeat(used, np.diff(b_at))]
                bounds = np.concatenate(([0], np.cumsum(np.diff(offsets)[some])))
                got = align(v, a, np.cumsum(v.bytes_a[a]), b, np.cumsum(v.bytes_b[b]), bounds)
                n_groups, n_links, sha = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64), [""] * len(used)
                n_groups[some], n_links[some] = got.n_groups, got.n_links
                raw_text = memoryview(got.text)
                for i, lo, hi in zip(some.tolist(), got.text_at.tolist(), got.text_at[1:].tolist(), strict=False):
                    sha[i] = hashlib.sha256(raw_text[lo : hi - 1]).hexdigest()
                count = np.zeros(len(used) + 1, np.int64)
                count[some + 1] = np.diff(got.pairs_at)
                links = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.StructArray.from_arrays([pa.array(got.pairs), pa.array(got.times)], ["pair", "times"]))
                yield pa.record_batch([ids.slice(row, end - row), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(sha), links], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
            release()

    return rows.mapInArrow(run, f"id {kind}, {_ROW}")


def _long(rows: DataFrame, path_a: str, path_b: str, kind: str) -> DataFrame | None:
    """Texts cut into ranges that are dealt to tasks; their fragments are joined as a tree. None if there are no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, text in zip(*(c.to_pylist() for c in columns(batch, "key", "id", "text")), strict=True):
                for n, (begin, end, left, raw) in enumerate(ranges(b" " + text.encode(), RANGE)):
                    yield pa.record_batch([pa.array([key]), pa.array([i], batch.schema.field("id").type), *(pa.array([x], pa.int64()) for x in (n, begin, end, left)), pa.array([raw], pa.binary())], ["key", "id", "range", "begin", "stop", "left", "raw"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(path_a, path_b)
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                out = _to_row(range_fragment(v, row["begin"], row["stop"], row["left"], row["raw"]))
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "id": row["id"], "range": row["range"]} | out], fragments)
        release()

    def join(part: pa.Table) -> pa.Table:
        v = Vocabularies(path_a, path_b)
        rows = part.sort_by("range").to_pylist()
        done = _from_row(rows[0])
        for row in rows[1:]:
            done = done.then(v, _from_row(row))
        return pa.Table.from_pylist([{"key": rows[0]["key"], "id": rows[0]["id"], "range": rows[0]["range"] // JOINED} | _to_row(done)], fragments)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                n_a, n_b, n_groups, n_links, sha, links = _from_row(row).whole()
                out = {"id": row["id"], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha, "links": [{"pair": p, "times": t} for p, t in links]}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("id", batch.schema.field("id").type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", _LINK)]))

    schema = f"key long, id {kind}, range long, {_FRAGMENT}"
    fragments = to_arrow_schema(StructType.fromDDL(schema))
    pieces = stored(rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(cut, f"key long, id {kind}, range long, begin long, stop long, left long, raw binary"), "ranges")
    most = pieces.agg(F.max("range")).head()[0]
    if most is None:
        return None
    done = pieces.repartition("key", "range").mapInArrow(encode, schema)
    while most:
        done = done.groupBy("key", F.expr(f"range div {JOINED}")).applyInArrow(join, schema)
        most //= JOINED
    return done.mapInArrow(finish, f"id {kind}, {_ROW}")


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups_sha256, links`` of each document; ``links`` has each pair of ids once, with its times.

    Tokens of A are those of a blank and the text by a byte-level BPE, tokens of B those of the text by a
    sentencepiece BPE that puts the blank itself; strings of special tokens are plain text. A text that is null or empty, or that
    the tokens of one do not give back, has zeros, no links and an empty digest.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = _short(rows.filter(size <= RANGE), path_a, path_b, kind)
    long = _long(rows.filter(size > RANGE), path_a, path_b, kind)
    return short if long is None else short.unionByName(long)


def cross_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    A pair of ids counts once in each document that links it. ``n_best`` are the links whose count is the
    highest of any pair with their A id, ties included; ``count_sum`` adds the counts of all links. Rows
    that repeat are documents of their own; ids may be null or repeated; other columns are not read, and an empty table gives no rows.

    Links are stored with their documents. The counts of the most frequent pairs, as many as may be broadcast, are
    sent to the documents; only links of rarer pairs are dealt by their pair, so no frequent pair meets in one task.
    """
    n_b = len(piece_encoder(path_b).model.bytes)
    docs = stored(align_texts(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = docs.select("row", F.inline("links"))
    counts = stored(links.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"))  # one row for each id of A at most
    counts = stored(counts.withColumn("a", F.expr(f"pair div {n_b}")).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")

    def summed(known: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return known.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    # Pairs by the length of their count in bits: the rarest count that is sent follows.
    bits = lambda c: F.length(F.bin(c))
    sizes = {r["bits"]: r["pairs"] for r in counts.groupBy(bits(F.col("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()}  # 63 rows at most
    least, sent = 64, 0
    while least > 1 and sent + sizes.get(least - 1, 0) <= SENT:
        least -= 1
        sent += sizes.get(least, 0)
    often = F.broadcast(counts.filter(bits(F.col("n")) >= least))
    sums = summed(links.join(often, "pair"))
    if sent < sum(sizes.values()):
        rare = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(counts.filter(bits(F.col("n")) < least), "pair")
        sums = sums.unionByName(summed(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = docs.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
