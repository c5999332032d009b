"""Repeated passages by suffix sorting: minimizer anchors bring equal passages together, deep-shallow sorting compares them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import words as W
from .common import columns, slices, stored

#: Bytes of a repeated string.
LENGTH = 400
#: Depth in bytes down to which multikey quicksort orders suffixes; blind tries order what is still equal.
SHALLOW = 32
#: Distinct contexts of one anchor that are sorted together; larger groups meet in pairs of parts.
GROUP = 20_000
U = np.uint64


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "next")

    def __init__(self, depth: int):
        self.depth, self.next = depth, {}


def blind_trie_order(strings: list[bytes], items: list[int]) -> list[int]:
    """Order strings that agree for long: a trie of branching bytes only, searched blindly, then one comparison."""
    root: _Node | list[int] = [items[0]]
    for i in items[1:]:
        s, node = strings[i], root
        while isinstance(node, _Node):
            node = node.next.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.next.values()))
        other = strings[node[0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node.append(i)
            continue
        parent, key, node = None, None, root
        while isinstance(node, _Node) and node.depth < n:
            parent, key = node, s[node.depth]
            node = node.next[key]
        mine = s[n] if n < len(s) else -1
        if isinstance(node, _Node) and node.depth == n:
            node.next[mine] = [i]
            continue
        fork = _Node(n)
        fork.next = {mine: [i], other[n] if n < len(other) else -1: node}
        if parent is None:
            root = fork
        else:
            parent.next[key] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Node):
            todo += [node.next[k] for k in sorted(node.next, reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Sorted order of strings: multikey quicksort on eight bytes at a time down to ``shallow``, blind tries below."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        items, depth = todo.pop()
        if len(items) < 2:
            out += items
        elif depth >= shallow:
            out += blind_trie_order(strings, items)
        else:
            keys = [strings[i][depth : depth + 8] for i in items]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(items, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(items, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(items, keys, strict=True) if k > pivot]
            todo.append((more, depth))
            todo.append((same, depth + 8 if len(pivot) == 8 else shallow))
            todo.append((less, depth))
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, block, context, at, low, high) of each anchor; positions count from the text's start.

    Every string of ``length`` bytes has one anchor: the first place in it where a block of half its
    length has the least hash. Equal strings have it at the same place. An anchor stands for the strings
    that start at ``low`` to ``high``; ``block`` hashes its block and ``context`` all bytes of these strings.
    """
    half = length // 2
    span = length - half + 1
    n = len(data)
    starts = np.repeat(offsets[:-1], np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    none = (np.zeros(0, np.int64),) * 6
    place = np.arange(n)
    valid = place + length <= ends
    if not valid.any():
        return none
    total = np.zeros(n + 1, U)
    np.cumsum(W._TABLE[data] * W.powers(n, W._ODD), out=total[1:])
    unshift = W.powers(n + 1, W._INV)
    block = np.full(n, np.iinfo(np.uint64).max, U)
    block[: n - half + 1] = W.mix((total[half:] - total[:-half]) * unshift[: n - half + 1])
    # Least block of each window of `span` places: running minima from both sides of fixed stretches.
    rows = -(-n // span) + 1
    keys = np.full(rows * span, np.iinfo(np.uint64).max, U)
    keys[:n] = (block >> U(9) << U(9)) | (place % span).astype(U)
    keys = keys.reshape(rows, span)
    ahead = np.minimum.accumulate(keys, 1).ravel()
    back = np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
    p = np.flatnonzero(valid)
    a, b = back[p], ahead[p + span - 1]
    first = p // span * span
    mask = U(511)
    # A window that is one whole stretch has the same minimum on both sides.
    at = np.where((a >> U(9)) <= (b >> U(9)), first + (a & mask).astype(np.int64), (p + span - 1) // span * span + (b & mask).astype(np.int64))
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    low, high, at = p[head], p[np.append(head[1:], len(p)) - 1], at[head]
    raw = memoryview(data)
    context = np.array([xxh3_64_intdigest(raw[x:y]) for x, y in zip(low.tolist(), (high + length).tolist(), strict=True)], U)
    context = W.mix(context ^ W.mix((at - low).astype(U) * U(1 << 20) + (high - low).astype(U)))
    row = np.searchsorted(offsets, low, side="right") - 1
    base = offsets[row]
    return row, block[at].view(np.int64), context.view(np.int64), at - base, low - base, high - base


def shared_starts(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(member, from, to): strings of ``length`` that start ``from`` to ``to`` bytes before the anchor and occur in another member.

    Members agree at the anchor; ``left`` is what stands before it, last byte first, ``right`` what follows.
    Both are suffix-sorted. Each node of the left order's tree is a set of members that agree on so many bytes
    before the anchor; in the right order, neighbours within the set agree furthest after it.
    """
    m, out = len(left), []
    by_right, by_left = np.array(deep_shallow(right)), np.array(deep_shallow(left))
    rank = np.empty(m, np.int64)
    rank[by_right] = np.arange(m)
    agree_right = np.array([0] + [common_prefix(right[i], right[j]) for i, j in zip(by_right[:-1].tolist(), by_right[1:].tolist(), strict=True)], np.int64)
    agree_left = np.array([0] + [common_prefix(left[i], left[j]) for i, j in zip(by_left[:-1].tolist(), by_left[1:].tolist(), strict=True)], np.int64)
    todo = [(0, m)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        inner = agree_left[i + 1 : j]
        depth = int(inner.min())
        r = np.sort(rank[by_left[i:j]])
        near = np.minimum.reduceat(agree_right[: r[-1] + 1], r[:-1] + 1)
        best = np.maximum(np.concatenate(([0], near)), np.concatenate((near, [0])))
        for k in np.flatnonzero(length - best <= depth).tolist():
            out.append((int(by_right[r[k]]), depth, max(0, length - int(best[k]))))
        cut = i + 1 + np.flatnonzero(inner == depth)
        todo += zip([i, *cut.tolist()], [*cut.tolist(), j], strict=True)
    return out


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key = columns(batch, "text", "key")
            key = key.to_numpy()
            for row, _, data, offsets in slices(text):
                of, block, context, at, low, high = anchors(data, offsets, length)
                yield pa.record_batch([pa.array(key[row + of]), pa.array(block), pa.array(context), pa.array(at), pa.array(low), pa.array(high)], ["key", "block", "context", "at", "low", "high"])

    return docs.mapInArrow(run, "key long, block long, context long, at long, low long, high long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the wanted anchors, read again from the texts; copies of a text give them once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(len(batch)):
                key, text, places = (c[0].as_py() for c in columns(batch.slice(i, 1), "key", "text", "places"))
                if key in seen:  # a copy
                    continue
                seen.add(key)
                raw = text.encode()
                part = [(key, x["block"], x["parts"], x["at"], x["low"], raw[x["low"] : x["at"]][::-1], raw[x["at"] : x["high"] + length]) for x in places]
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("parts", pa.int32()), ("at", pa.int64()), ("low", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
    places = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("block", "parts", "at", "low", "high")).alias("places")), "places")
    joined = docs.join(places, "key")
    return joined.select("key", "text", "places").mapInArrow(run, "key long, block long, parts int, at long, low long, left binary, right binary")


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (key, start, end) of the strings that two different contexts of one anchor share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def spans() -> pa.RecordBatch:
            found = shared_starts([x[3] for x in held], [x[4] for x in held], length)
            rows = [(held[i][0], held[i][1] - far, held[i][1] - near + length) for i, far, near in found]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["key", "start", "end"])

        for batch in batches:
            for block, x, y, *member in zip(*(c.to_pylist() for c in columns(batch, "block", "x", "y", "key", "at", "low", "left", "right")), strict=True):
                if (block, x, y) != group:
                    if len(held) > 1:
                        yield spans()
                    held, group = [], (block, x, y)
                if not held or held[-1][:2] != member[:2]:
                    held.append(member)
        if len(held) > 1:
            yield spans()

    part = F.pmod(F.xxhash64("key", "at"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j.cast("long")).alias("x"), F.greatest("part", j.cast("long")).alias("y")))
    met = contexts.withColumn("part", part).select("block", F.explode(others).alias("xy"), "key", "at", "low", "left", "right").select("block", "xy.x", "xy.y", "key", "at", "low", "left", "right")
    return met.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "key", "at").mapInArrow(run, "key long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, spans``: for each text (by ``key``) with strings of ``length`` bytes that occur anywhere else, where they are.

    Anchors whose whole context occurs again need no comparing: all their strings repeat. Of the others,
    those that share a block are compared in suffix order, one context of each kind.
    """
    rows = stored(_anchor_rows(docs, length), "anchors")
    again = stored(rows.groupBy("block").count().filter("count > 1").select("block"), "blocks")
    rows = stored(rows.join(again, "block"), "repeated")
    place = F.struct("key", "at", "low", "high")
    kinds = stored(rows.groupBy("block", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "contexts")
    whole = rows.join(kinds.filter("n > 1").select("block", "context"), ["block", "context"]).select("key", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    several = kinds.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("block", F.ceil(F.col("k") / GROUP).cast("int").alias("parts"))
    wanted = kinds.join(several, "block").select("block", "parts", "place.*")
    spans = whole.unionByName(_sorted_spans(_contexts(docs, wanted, length), length)).distinct()
    # One context stands for all its equals: their strings repeat anyway.
    return stored(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns for each row ``<id_col>, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``kept``
    (bytes, as a cut may fall within a character). Strings never cross texts; overlaps count, and strings
    are judged on the input. A null text counts as empty; shorter texts stay whole. Rows that repeat an id or
    a text are rows of their own, and equal long texts go whole. A very long text is worked on alone. An empty
    table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                ids, text, spans = columns(batch.slice(lo, 500), "id", "text", "spans")
                rows = []
                for t, found in zip(text, spans.to_pylist(), strict=True):
                    raw = (t.as_py() or "").encode()
                    merged: list[list[int]] = []
                    for x in found or ():
                        if merged and x["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x["end"])
                        else:
                            merged.append([x["start"], x["end"]])
                    cut = [0, *(x for m in merged for x in m), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)) if merged else raw
                    rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                made = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.record_batch([ids, *made][: 5 + keep_text], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(rows.select("key", "text"), length)
    joined = rows.join(spans, "key", "left").select("id", "text", "spans")
    kind = dict(rows.dtypes)["id"]
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text).withColumnRenamed("id", id_col)
