"""Packing documents into fixed-length sequences by a grouping genetic algorithm."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, release, stored
from .tokens import crc, encoded

LENGTH = 1024
#: Text encoded at once, after which a worker gives memory back.
SLICE = 1 << 20
#: Pieces packed together, about; groups are dealt by hash, so that none grows with a key.
GROUP = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4
#: Exchanges for one child, neighbours in a bin that leave it together, and loose items that enter in pairs.
EXCHANGES, NEAR, PAIRED = 32, 8, 32


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, piece, start, length, ids_crc32`` of each document's ids and end id.

    A document longer than a sequence is cut into whole sequences and a first piece that is shorter or as long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, text = columns(batch, "id", "text")
            for row, _, ids, offsets in encoded(text, tokenizer, SLICE):
                n = np.diff(offsets)
                count = -(-n // length)
                of = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * length
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * length)
                size = np.where(piece == 0, head[of], length)
                at = offsets[of] + start
                sums = [crc(ids[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pa.record_batch(
                    [doc_ids.take(pa.array(row + of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
                release()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def best_fit(sizes: list[int], items: list[int], room: dict[int, int], bins: np.ndarray, capacity: int, next_bin: int) -> int:
    """Put ``items``, largest first, each where it leaves the least room; returns the next free bin number."""
    open_ = sorted((r, b) for b, r in room.items())
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            r, b = open_.pop(at)
        else:
            r, b, next_bin = capacity, next_bin, next_bin + 1
        bins[i] = b
        if r > n:
            insort(open_, (r - n, b))
    return next_bin


def _loads(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def _fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, unevenly filled ones."""
    load = _loads(bins, sizes)
    load = load[load > 0]
    return -len(load), float(((load / capacity) ** 2).sum())


def _exchange(bins: np.ndarray, load: np.ndarray, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Let one or two loose items take the place of one or two in a bin that they fill better; returns who is loose then.

    Bins that become full go first, then those that gain most. Each bin gives once; ``bins`` and ``load`` change in place.
    """
    held = np.flatnonzero(bins >= 0)
    held = held[load[bins[held]] < capacity]
    held = held[np.argsort(bins[held], kind="stable")]
    first, second = [held], [np.full(len(held), -1)]
    for lag in range(1, NEAR):
        same = bins[held[:-lag]] == bins[held[lag:]]
        first.append(held[:-lag][same])
        second.append(held[lag:][same])
    first, second = np.concatenate(first), np.concatenate(second)
    where = bins[first]
    gone = sizes[first] + np.where(second >= 0, sizes[second], 0)
    upto = gone + capacity - load[where]
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    for _ in range(EXCHANGES):
        if not len(first) or not len(loose):
            break
        i, j = np.triu_indices(min(len(loose), PAIRED), 1)
        one, two = np.concatenate((loose, loose[i])), np.concatenate((np.full(len(loose), -1), loose[j]))
        size = sizes[one] + np.where(two >= 0, sizes[two], 0)
        order = np.argsort(size, kind="stable")
        at = np.searchsorted(size[order], upto, side="right") - 1
        got = np.where(at >= 0, size[order][at], 0)
        gain = np.where(got > gone, got - gone + capacity * (got == upto), 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        b, out = where[best], [x for x in (first[best], second[best]) if x >= 0]
        into = [x for x in (one[order[at[best]]], two[order[at[best]]]) if x >= 0]
        bins[out], bins[into] = -1, b
        load[b] += got[best] - gone[best]
        loose = np.concatenate((loose[~np.isin(loose, into)], np.array(out, np.int64)))
        left = where != b
        first, second, where, gone, upto = first[left], second[left], where[left], gone[left], upto[left]
    return loose


def _reinsert(bins: np.ndarray, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange loose items for others that fill bins less well, then best-fit those that are loose; bins are numbered anew."""
    fixed = np.ones(len(bins), bool)
    fixed[loose] = False
    _, dense = np.unique(bins[fixed], return_inverse=True)
    out = np.full_like(bins, -1)
    out[fixed] = dense
    load = _loads(dense, sizes[fixed]) if fixed.any() else np.zeros(0, np.int64)
    loose = _exchange(out, load, loose, sizes, capacity) if fixed.any() else loose
    room = {b: int(capacity - x) for b, x in enumerate(load.tolist()) if x < capacity}
    best_fit(sizes.tolist(), loose.tolist(), room, out, capacity, len(load))
    return out


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Some of the fullest bins of ``b`` enter ``a`` whole; bins of ``a`` with the same items are dissolved and
    their other items best-fitted."""
    load = _loads(b, sizes)
    fullest = np.argsort(-load, kind="stable")[: max(1, len(load) // 2)]
    chosen = rng.choice(fullest, max(1, len(fullest) // 4), replace=False)
    entering = np.isin(b, chosen)
    hit = np.isin(a, np.unique(a[entering])) & ~entering
    child = a.copy()
    child[entering] = b[entering] + len(a) + 1
    return _reinsert(child, np.flatnonzero(hit), sizes, capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bins and a few others, and best-fit their items."""
    load = _loads(a, sizes)
    k = max(2, len(load) // 50)
    gone = np.concatenate((np.argsort(load, kind="stable")[:k], rng.choice(len(load), min(k, len(load)), replace=False)))
    return _reinsert(a, np.flatnonzero(np.isin(a, gone)), sizes, capacity)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The best packing (bin of each item) of one island after some generations, starting from the elites."""
    least = -(-int(sizes.sum()) // capacity)
    rng = np.random.default_rng(seed)
    people = [x for x in elites if len(x) == len(sizes)]
    if not people:
        people = [_reinsert(np.zeros(len(sizes), np.int64), np.arange(len(sizes)), sizes, capacity)]
    score = lambda x: _fitness(x, sizes, capacity)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if -score(people[0])[0] <= least or len(sizes) < 3:
            break
        while len(people) < population:
            people.append(mutate(people[int(rng.integers(len(people)))], sizes, capacity, rng))
        i, j = rng.choice(len(people), 2, replace=False)
        children = [crossover(people[i], people[j], sizes, capacity, rng), crossover(people[j], people[i], sizes, capacity, rng)]
        people = sorted([*people, *children, mutate(people[0], sizes, capacity, rng)], key=score, reverse=True)[:population]
    return people[0]


def _islands(states: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island: rows ``grp, island, items, elites`` get a new ``elite`` and its ``bins``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                grp, island, items, elites = columns(row, "grp", "island", "items", "elites")
                sizes = items.flatten().field("length").to_numpy(zero_copy_only=False).astype(np.int64)
                known = [np.array(x, np.int64) for x in elites.to_pylist()[0] or []]
                best = evolve(sizes, known, capacity, hash((grp[0].as_py(), island[0].as_py(), epoch)) & 0x7FFFFFFF)
                bins, fill = _fitness(best, sizes, capacity)
                yield pa.record_batch([grp, island, items, pa.array([best.tolist()], pa.list_(pa.int32())), pa.array([-bins], pa.int64()), pa.array([fill])], ["grp", "island", "items", "elite", "bins", "fill"])

    items = dict(states.dtypes)["items"]
    return states.mapInArrow(run, f"grp long, island int, items {items}, elite array<int>, bins long, fill double")


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id, offset`` to the rows of ``pieces()``, in as few sequences of ``length`` as it can.

    Whole pieces are a sequence each. The others are dealt by hash into groups of about ``group``; each
    group is evolved on several islands (best fit first, then crossover of whole bins and mutation), which
    pass their elites around between epochs. The best island's packing counts. Reruns agree.
    """
    parts = stored(parts, "pieces")
    whole = parts.filter(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    short = parts.filter(F.col("length") < length)
    n_groups = max(1, round(short.count() / group))
    item = F.struct("length", F.col(id_col).alias("id"), "piece", "start", "ids_crc32")
    grouped = short.groupBy(F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_groups)).alias("grp")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    states = grouped.select("grp", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "items", F.array().cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        done = stored(_islands(states.repartition(F.col("grp"), F.col("island")), length, epoch), "islands")
        if epoch + 1 < epochs:
            elite = done.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
            states = done.join(elite, ["grp", "island"]).select("grp", "island", "items", F.array("elite", "guest").alias("elites"))
    best = done.select("grp", "island", "bins", "fill").groupBy("grp").agg(F.min(F.struct("bins", (-F.col("fill")).alias("fill"), "island")).alias("best")).select("grp", "best.island")
    packed = (
        done.join(best, ["grp", "island"])
        .select("grp", F.explode(F.arrays_zip("items", "elite")).alias("x"))
        .select((F.col("grp") * (1 << 32) + F.col("x.elite")).alias("bin"), "x.items.*")
        .groupBy("bin")
        .agg(F.sort_array(F.collect_list(F.struct("length", "id", "piece", "start", "ids_crc32"))).alias("xs"))
        .select("bin", F.posexplode(F.transform("xs", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice("xs", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))).alias("at", "y"))
        .select(F.col("y.x.id").alias(id_col), "y.x.piece", "y.x.start", "y.x.length", "y.x.ids_crc32", (F.col("bin") * 2).alias("sequence_id"), "y.offset")
    )
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, piece, start, length, ids_crc32, sequence_id, offset``: all documents in sequences.

    A null or empty text is one end id. Rows that repeat an id, and null ids, are packed like others. An
    empty table gives no rows; other columns are not read.
    """
    return pack(pieces(docs, tokenizer, length, id_col, text_col), length, id_col=id_col)
