"""N-gram Jaccard join over count vectors: group signatures, packed R-trees, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import LEAST_TASKS, TASKS_A_CORE
from . import words as W
from .common import columns, discard, forget_tokenizers, hinted, release, slices, stored
from .components import components

#: Words in a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Groups that shingles are hashed into for the count vector, the point that is indexed.
DIMS = 128
#: Points in a leaf of an R-tree, nodes in a node, points in a tree, and bytes of sets in a tree that holds the sets too.
LEAF, FAN, PART, PART_BYTES = 64, 8, 4096, 16 << 20
#: Pairs that trees hand over at once.
ROWS = 1 << 20
#: Buckets of a set that its points name, the first ones.
NAMED = 16
#: Width of the size classes of signatures.
RATIO = 1.4
U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and their offsets.

    Words are what stands between white space, A-Z lower-cased. A text with fewer words is one shingle;
    one without words has none.
    """
    data = W.LOWER[data]
    start, end, of = W.spans(data, offsets, W.SPACE)
    h = W.hashes(data, start, end)
    n_words = np.bincount(of, minlength=len(offsets) - 1)
    m = len(h) - words + 1
    sh = np.zeros(max(0, m), np.uint64)
    for j in range(words if m > 0 else 0):
        sh = sh * U(0xD6E8FEB86659FD93) + h[j : j + m]
    inside = of[:m] == of[words - 1 :] if m > 0 else np.zeros(0, bool)
    sh, row = W.mix(sh)[inside], of[:m][inside] if m > 0 else np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        first = np.searchsorted(of, few)
        alone = np.array([_sequence(h[a : a + n]) for a, n in zip(first.tolist(), n_words[few].tolist(), strict=True)], np.uint64)
        at = np.searchsorted(row, few)
        sh, row = np.insert(sh, at, alone), np.insert(row, at, few)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            sh[a:b].sort()
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(offsets) - 1))))


def _sequence(h: np.ndarray) -> np.uint64:
    x = np.array([len(h)], np.uint64)
    for w in h:
        x = W.mix(x * U(0xA24BAED4963EE407) + w)
    return x[0]


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit integers by group, modulo 2 ** 64, in parts that floating point adds exactly."""
    out = np.zeros(n, np.uint64)
    for shift in (0, 22, 44):
        part = (values >> U(shift)) & U((1 << 22) - 1)
        out += np.bincount(of, part.astype(np.float64), n).astype(np.uint64) << U(shift)
    return out


def set_ids(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    return W.mix(_sums(of, W.mix(sh ^ U(0x5851F42D4C957F2D)), len(n)) + n.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def count_vectors(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shingles of each set by group: (sets, DIMS). A set with too many for 16 bits has the largest number throughout, which bounds nothing."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    group = (sh >> U(64 - DIMS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(of * DIMS + group, minlength=len(n) * DIMS).reshape(-1, DIMS)
    counts[(counts > 0xFFFF).any(1)] = 0xFFFF
    return counts.astype("<u2")


def _points(vecs: bytes, n: np.ndarray) -> np.ndarray:
    """Count vectors of sets of ``n`` shingles; one with the largest number throughout may have all its shingles in any group."""
    x = np.frombuffer(vecs, "<u2").reshape(-1, DIMS)
    full = (x == 0xFFFF).all(1)
    return np.where(full[:, None], n[:, None], x) if full.any() else x


def fine_vector(sh: np.ndarray) -> bytes:
    """Shingles of one set by group, in single bytes, for as many groups as the set has shingles, rounded down to a power of two.

    A set with too many for a byte in any group has the largest number throughout, which bounds nothing.
    """
    bits = max(7, len(sh).bit_length() - 1)
    counts = np.bincount((sh >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (counts if counts.max() < 0xFF else np.full(1 << bits, 0xFF)).astype(np.uint8).tobytes()


def fine_bound(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the summed minima of two fine vectors leave room for the similarity; the one with more groups is folded."""
    u, v = sorted((np.frombuffer(z, np.uint8) for z in (x, y)), key=len)
    if (u == 0xFF).all() or (v == 0xFF).all():
        return True
    v = v.reshape(len(u), -1).sum(1, dtype=np.int64)
    return (percent + 100) * int(np.minimum(u, v).sum(dtype=np.int64)) >= percent * (int(u.sum(dtype=np.int64)) + int(v.sum()))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, each sorted, share ``percent`` of their union."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


class Classes:
    """Size classes and how many groups of a set can differ at most from those of a similar one.

    Sets of sizes a and b that share at least p percent of their union differ in at most
    (100 - p) / (100 + p) * (a + b) shingles.
    """

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.low = np.array(low, np.int64)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, n: np.ndarray) -> np.ndarray:
        """Size of the largest set that can be similar."""
        return 100 * n // self.percent

    def emitted(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, class, groups of the class, most groups that differ): of the set's own class, and the next ones that a larger similar set can be in."""
        own = np.searchsorted(self.low, n, side="right") - 1
        rows, step = np.flatnonzero(n > 0), 0
        while len(rows):
            c = own[rows] + step
            high = self.low[c + 1] - 1
            groups = self.differ(high, high) * 5 // 4 + 3
            most = self.differ(n[rows], np.minimum(high, self.largest(n[rows])))
            yield rows, c, groups, most
            rows, step = rows[self.largest(n[rows]) > high], step + 1


def signatures(sh: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): similar sets have at least one signature in common.

    The shingles of a set are hashed into the groups of its size class. If at most d groups of similar
    sets differ, one of the first d + 1 groups that have shingles is the same in both; its content is a
    signature. A set with fewer such groups gives them all, and a mark for each empty group.
    """
    n = np.diff(bounds)
    out_row, out_sig = [], []
    mixed = W.mix(sh + U(0x2545F4914F6CDD1D))
    for rows, c, groups, most in Classes(percent).emitted(n):
        take = np.zeros(len(n), bool)
        take[rows] = True
        of_all = np.repeat(np.arange(len(n)), n)
        chosen = take[of_all]
        local = (np.cumsum(take) - 1)[of_all[chosen]]
        base = np.cumsum(groups) - groups
        g = (((mixed[chosen] >> U(32)) * groups[local].astype(np.uint64)) >> U(32)).astype(np.int64)
        at, total = base[local] + g, int(groups.sum())
        filled = np.bincount(at, minlength=total) > 0
        content = _sums(at, W.mix(sh[chosen] ^ U(0x94D049BB133111EB)), total)
        owner = np.repeat(np.arange(len(rows)), groups)
        place = np.arange(total) - base[owner]
        upto = np.cumsum(filled)
        nth = upto - np.concatenate(([0], upto))[base][owner]
        n_filled = np.bincount(owner, filled, len(rows)).astype(np.int64)
        keep = np.where(filled, nth <= most[owner] + 1, (n_filled <= most)[owner])
        sig = W.mix(content + W.mix((c[owner].astype(np.uint64) << U(40)) + place.astype(np.uint64)))
        out_row.append(rows[owner[keep]])
        out_sig.append(sig[keep])
    return np.concatenate(out_row) if out_row else np.zeros(0, np.int64), np.concatenate(out_sig).view(np.int64) if out_sig else np.zeros(0, np.int64)


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        for batch in batches:
            ids, text, key = columns(batch, "id", "text", "key")
            for row, end, data, offsets in slices(text):
                sh, bounds = shingles(data, offsets, words)
                vec = [v.tobytes() for v in count_vectors(sh, bounds)]
                yield pa.record_batch([ids.slice(row, end - row), key.slice(row, end - row), pa.array(np.diff(bounds)), pa.array(set_ids(sh, bounds)), pa.array(vec, pa.binary())], ["id", "key", "n", "set", "vec"])
        release()

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, key long, n long, set long, vec binary")


def _signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        seen: set[int] = set()  # copies within a task give their signatures once
        for batch in batches:
            for _, _, data, offsets in slices(columns(batch, "text")[0]):
                sh, bounds = shingles(data, offsets, words)
                ids = set_ids(sh, bounds)
                fresh = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                n = np.diff(bounds)
                sh, n, ids = sh[np.repeat(fresh, n)], n[fresh], ids[fresh]
                row, sig = signatures(sh, np.concatenate(([0], np.cumsum(n))), percent)
                yield pa.record_batch([pa.array(sig), pa.array(ids[row])], ["sig", "set"])
        release()

    return docs.select("text").mapInArrow(run, "sig long, set long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of the rows ``sig, set`` each distinct one whose signature another set has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_set = None
        shared = True  # whether the last row has been given out
        for batch in batches:
            sig, ids = (x.to_numpy() for x in columns(batch, "sig", "set"))
            if not len(sig):
                continue
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            fresh[0] = sig[0] != last_sig or ids[0] != last_set
            sig, ids = sig[fresh], ids[fresh]
            if not len(sig):
                continue
            again = np.concatenate(([sig[0] == last_sig], sig[1:] == sig[:-1]))
            keep = again.copy()
            keep[:-1] |= again[1:]
            if again[0] and not shared:
                yield pa.record_batch([pa.array([last_sig]), pa.array([last_set])], ["sig", "set"])
            last_sig, last_set, shared = sig[-1], ids[-1], bool(keep[-1])
            if keep.any():
                yield pa.record_batch([pa.array(sig[keep]), pa.array(ids[keep])], ["sig", "set"])
        release()

    return rows.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(run, "sig long, set long")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs whose count vectors leave room for the similarity: the sum of the smaller coordinates bounds the overlap."""
    p = percent + 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, va, vb = columns(batch, "a", "b", "na", "nb", "va", "vb")
            x, y = (_points(b"".join(v.to_pylist()), n.to_numpy()) for v, n in ((va, na), (vb, nb)))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            ok = pa.array(p * most >= percent * (na.to_numpy() + nb.to_numpy()))
            yield pa.record_batch([a, b], ["a", "b"]).filter(ok)
        release()

    left = points.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = points.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    joined = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return joined.mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()


def _contents(sets: DataFrame, docs: DataFrame, points: DataFrame, words: int, content: Callable[[np.ndarray], object], kind: str, name: str) -> DataFrame:
    """``set, items``: ``content`` of the shingles of each of the sets, read again from the texts; sets may repeat."""
    needed = stored(sets.join(points.select("set", "key"), "set"), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            text, want = columns(batch, "text", "set")
            want = want.to_numpy()
            for row, end, data, offsets in slices(text):
                sh, bounds = shingles(data, offsets, words)
                ids = set_ids(sh, bounds)
                good = [i for i in np.flatnonzero(ids == want[row:end]).tolist() if ids[i] not in done and not done.add(ids[i])]
                items = [content(sh[bounds[i] : bounds[i + 1]]) for i in good]
                if len(done) > 1_000_000:
                    done.clear()
                yield pa.record_batch([pa.array(ids[good]), pa.array(items, pa.binary() if kind == "binary" else pa.list_(pa.int64()))], ["set", "items"])
        done.clear()
        release()

    # All texts stay where they are if the keys are few enough to be sent to them.
    found = docs.join(hinted(needed, needed.count(), 24), "key").select("text", "set").mapInArrow(run, f"set long, items {kind}")
    found = stored(found, name)
    discard(needed)
    return found


def _passing(pairs: DataFrame, contents: DataFrame, passes: Callable[[pa.Scalar, pa.Scalar], bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = columns(batch, "a", "b", "x", "y")
            ok = [passes(x[i], y[i]) for i in range(len(batch))]
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    once = contents.dropDuplicates(["set"])
    left, right = (once.select(F.col("set").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose sets are similar, by the sets themselves, read again from the texts.

    Count vectors as fine as the sets are large, a byte a group, bound the overlap once more; only pairs
    that they leave move their sets.
    """

    fine = _contents(_ends(pairs), docs, points, words, fine_vector, "binary", "fine")
    close = stored(_passing(pairs, fine, lambda x, y: fine_bound(x.as_py(), y.as_py(), percent)), "close")
    discard(fine)
    sets = _contents(_ends(close), docs, points, words, lambda sh: sh.view(np.int64), "array<long>", "sets")
    out = stored(_passing(close, sets, lambda x, y: similar(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), percent)), "similar")
    discard(sets, close)
    return out


def _different(members: DataFrame) -> DataFrame:
    """Of buckets with the same members one; similar documents meet in many."""
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "set")).alias(f"m{seed}") for seed in (1, 2)]
    kinds = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *marks)
    kept = stored(kinds.groupBy("size", "m1", "m2").agg(F.min("sig").alias("sig")).select("sig"), "kept-buckets")
    return members.join(hinted(kept, kept.count(), 8), "sig")


class RTree:
    """A packed R-tree of count vectors: leaves of ``LEAF`` points in order, nodes of ``FAN`` nodes above, one root.

    A node has the largest coordinate of its points in each dimension, the least set size, and the least
    and largest component. Two nodes can hold a similar pair only if the sum of the smaller of their
    coordinates allows it for the least sizes. ``items`` are the sets themselves, as bytes, if the tree holds them;
    ``named`` has ``NAMED`` buckets of each point's set, the first ones, if the tree is of the bucket ``sig``.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, component: np.ndarray, items: pa.Array | None = None, named: np.ndarray | None = None, sig: int = 0):
        self.points, self.n, self.component, self.items, self.named, self.sig, self.levels = points, n, component, items, named, sig, []
        node, size = (points, n, component, component), LEAF
        while not self.levels or len(node[1]) > 1:
            at = np.arange(0, len(node[1]), size)
            node = tuple(f.reduceat(x, at, 0) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum), node, strict=True))
            self.levels.append(node)
            size = FAN

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, min((i + 1) * LEAF, len(self.n)))

    def meet(self, other: RTree, percent: int) -> Iterator[tuple[int, int]]:
        """Leaves of this tree and of another (or itself) that the bounds leave, from the roots down."""
        i, j, x, y = len(self.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            (top, least, low, high), (top2, least2, low2, high2) = self.levels[i], other.levels[j]
            ok = (low[x] != high2[y]) | (high[x] != low2[y])
            x, y = x[ok], y[ok]
            most = np.concatenate([np.zeros(0, np.int64)] + [np.minimum(top[x[k : k + 4096]], top2[y[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(x), 4096)])
            ok = (percent + 100) * most >= percent * (least[x] + least2[y])
            x, y = x[ok], y[ok]
            if not i and not j:
                break
            down, down2 = i >= j, j >= i
            i, j = i - down, j - down2
            for k, (go, side) in enumerate(((down, self.levels[i]), (down2, other.levels[j]))):
                if go:
                    at = (x, y)[k]
                    each = np.minimum((at + 1) * FAN, len(side[1])) - at * FAN
                    child = np.repeat(at * FAN - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                    x, y = (child, np.repeat(y, each)) if k == 0 else (np.repeat(x, each), child)
            if self is other:
                x, y = x[x <= y], y[x <= y]
        same = x == y if self is other else np.zeros(len(x), bool)
        order = np.lexsort((y, x, ~same))  # a leaf with itself first
        yield from zip(x[order].tolist(), y[order].tolist(), strict=True)

    def item(self, i: int) -> np.ndarray:
        return np.frombuffer(self.items[i].as_buffer(), np.uint64)

    def pairs(self, other: RTree, percent: int, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places (in this tree, in the other) of pairs of different components that the bound leaves; ``spanning``: only so many that they join all points that these pairs join.

        Of trees that hold their sets, the pairs are those whose sets are similar. Of trees that name buckets, pairs that both name an
        earlier bucket are left to that one, where the same bound leaves them.
        """
        return tuple(np.concatenate([np.zeros((2, 0), np.int64), *self.blocks(other, percent, spanning)], 1))

    def blocks(self, other: RTree, percent: int, spanning: bool) -> Iterator[np.ndarray]:
        """All ``pairs`` as arrays of two rows; one ends once it has ``ROWS`` pairs, after those of the leaves at hand."""
        exact = self.items is not None
        out, rows = [], 0
        _, label = np.unique(np.concatenate((self.component, other.component)), return_inverse=True)
        mine, its = label[: len(self.n)], label[len(self.n) :]
        for u, v in self.meet(other, percent):
            if rows >= ROWS:
                yield np.concatenate(out, 1)
                out, rows = [], 0
            a, b = self.leaf(u), other.leaf(v)
            mask = mine[a, None] != its[None, b]
            if self is other and u == v:
                mask &= np.tri(*mask.shape, -1, bool).T
            if not mask.any():
                continue
            most = np.minimum(self.points[a, None], other.points[None, b]).sum(2, dtype=np.int64)
            mask &= (percent + 100) * most >= percent * (self.n[a, None] + other.n[None, b])
            if not spanning:
                i, j = np.nonzero(mask)
                if self.named is not None:
                    x, y = self.named[a][i], other.named[b][j]
                    new = ~((x[:, :, None] == y[:, None]) & (x < self.sig)[:, :, None]).any((1, 2))
                    i, j = i[new], j[new]
                out.append(np.stack((i, j)) + [[a.start], [b.start]])
                rows += out[-1].shape[1]
                continue
            while mask.any():
                i, j = divmod(int(mask.argmax()), mask.shape[1])
                if exact and not similar(self.item(a.start + i), other.item(b.start + j), percent):
                    mask[i, j] = False
                    continue
                out.append(np.array([[a.start + i], [b.start + j]]))
                rows += 1
                label[label == its[b.start + j]] = mine[a.start + i]
                if self is other:
                    its[:] = mine
                mask &= mine[a, None] != its[None, b]
        if out:
            yield np.concatenate(out, 1)


def _whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All the rows of many small batches, or of large ones, in batches of up to ``ROWS``."""

    def joined() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)

    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += len(batch)
        if n >= ROWS:
            yield from joined()
            held, n = [], 0
    if n:
        yield from joined()


def _lists(values: np.ndarray | pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _cuts(sig: np.ndarray, size: np.ndarray, points: int, most: int) -> np.ndarray:
    """Where trees begin among points in order of their bucket: up to ``points`` of them, fewer if their sizes sum up to more than ``most``."""
    weight = np.maximum(1, size * points // most)
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    before = np.cumsum(weight) - weight
    part = (before - before[np.flatnonzero(new)][np.cumsum(new) - 1]) // points
    new[1:] |= part[1:] != part[:-1]
    return np.flatnonzero(new)


def _tree_pairs(points: DataFrame, percent: int, spanning: bool = False, used: list[DataFrame] | None = None, wide: list[DataFrame] | None = None) -> DataFrame:
    """Pairs ``a, b`` from different components within a bucket that the R-trees' bounds leave.

    The points ``sig, set, component, n, vec`` of a bucket are packed into trees of up to ``PART`` points, in
    order of component and leading coordinates; a bucket with very many points has several trees in several
    tasks. Trees meet from the roots down: two trees, nodes, leaves or points meet only if the sum of the
    smaller of their largest coordinates allows a similar pair. With ``spanning``, each tree gives no more pairs
    than it takes to join what the bounds leave, and trees of one bucket meet by their first points; links that join
    all points of such a bucket are stored and added to ``wide``. The tables that the result reads are added to ``used``.

    Without both, each point names the first buckets of its set, and two sets that both name an earlier bucket give their pair there only.
    If the points have ``items``, the sorted shingles as bytes, trees hold them, and the pairs are links between similar sets, from
    each tree and each two trees no more than it takes to join their points.
    """
    exact = "items" in points.columns
    once = not spanning and not exact

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 32, None

        def cuts(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
            return _cuts(sig, n * 8 * exact, PART, PART_BYTES)

        def packed(sig: np.ndarray, ids: np.ndarray, comps: np.ndarray, n: np.ndarray, vec: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
            nonlocal part
            at = cuts(sig, n)
            numbers = part + np.arange(len(at))
            part += len(at)
            top = np.maximum.reduceat(_points(vec.tobytes(), n), at, 0).astype(np.int64)
            width = np.diff(np.append(at, len(sig))) * 2 * DIMS
            raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), pa.py_buffer(vec.tobytes())])
            tops = _lists(top.ravel(), np.arange(len(at)) * DIMS)
            more = [_lists(pa.array(x, pa.binary()), at) if exact else _lists(x.ravel(), at * NAMED) for x in more]
            return pa.record_batch(
                [pa.array(sig[at]), pa.array(numbers), pa.array(ids[at]), pa.array(np.minimum.reduceat(comps, at)), pa.array(np.maximum.reduceat(comps, at)), pa.array(np.minimum.reduceat(n, at)), tops]
                + [_lists(ids, at), _lists(comps, at), _lists(n, at), raw, *more],
                ["sig", "part", "head", "low", "high", "least", "top", *inner],
            )

        for batch in batches:
            if not len(batch):
                continue
            *rest, vec = columns(batch, "sig", "set", "component", "n", "vec")
            now = [*(x.to_numpy() for x in rest), np.frombuffer(b"".join(vec.to_pylist()), "<u2").reshape(-1, DIMS)]
            now += [np.array(x.to_pylist(), object) for x in columns(batch, *["items"] * exact)]
            now += [np.array(x.to_pylist(), np.int64) for x in columns(batch, *["named"] * once)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(cuts(held[0], held[3])[-1])
            if last:
                yield packed(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield packed(*held)
        held = None
        release()

    def trees(batch: pa.RecordBatch, side: str = "") -> Iterator[tuple[np.ndarray, RTree]]:
        ids, comps, ns, vecs, *more = columns(batch, *(c + side for c in inner))
        sig = columns(batch, "sig")[0].to_pylist()
        at = ids.offsets.to_numpy()
        ids, comps, ns = (x.values.to_numpy() for x in (ids, comps, ns))
        for i, (a, b, vec) in enumerate(zip(at.tolist(), at[1:].tolist(), vecs, strict=False)):
            items, named = more[0][i].values if exact else None, more[0][i].values.to_numpy().reshape(-1, NAMED) if once else None
            yield ids[a:b], RTree(_points(vec.as_py(), ns[a:b]), ns[a:b], comps[a:b], items, named, sig[i])

    def found(ids: np.ndarray, tree: RTree, other: np.ndarray, it: RTree, few: bool) -> Iterator[pa.RecordBatch]:
        for x, y in tree.blocks(it, percent, few):
            yield pa.record_batch([pa.array(np.minimum(ids[x], other[y])), pa.array(np.maximum(ids[x], other[y]))], ["a", "b"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _whole(x for ids, tree in trees(batch) for x in found(ids, tree, ids, tree, spanning or exact))
        release()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (ids, tree), (other, it) = (next(trees(batch.slice(i, 1), side)) for side in ("_x", "_y"))
                yield from _whole(found(ids, tree, other, it, exact))
        release()

    more = ["items"] * exact + ["named"] * once
    inner = ["sets", "components", "ns", "vecs", *more]
    if once:
        first = F.slice(F.concat(F.array_sort(F.collect_set("sig")), F.array_repeat(F.lit((1 << 63) - 1), NAMED)), 1, NAMED)
        points = points.join(points.groupBy("set").agg(first.alias("named")), "set")
    points = stored(points.select("sig", "set", "component", "n", "vec", *more), "points")
    order = ["sig", "component", "front", "set"]
    if spanning:
        order.remove("component")  # there are as many as points, or nearly
    front = F.base64(F.substring("vec", 1, 16))
    kinds = "sig long, part long, head long, low long, high long, least long, top array<long>, sets array<long>, components array<long>, ns array<long>, vecs binary"
    kinds += ", items array<binary>" * exact + ", named array<long>" * once
    if exact:  # few bytes, but work that is quadratic in a bucket
        dealt = points.withColumn("front", front).repartition(max(TASKS_A_CORE * points.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS), "sig")
    else:
        dealt = points.withColumn("front", front).repartitionByRange(*order)
    packed = stored(dealt.sortWithinPartitions(*order).mapInArrow(pack, kinds), "trees")
    pairs = packed.filter("low < high").select("sig", *inner).mapInArrow(inside, "a long, b long")
    several = stored(packed.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig"), "several")
    n_several, used = several.count(), [] if used is None else used
    used += [points, packed, several]
    if not n_several:
        return pairs.distinct()
    parts = stored(packed.join(hinted(several, n_several, 8), "sig"), "parts")
    used.append(parts)
    if spanning:
        before = F.lag("head").over(Window.partitionBy("sig").orderBy("part"))
        if wide is not None:
            first = parts.groupBy("sig").agg(F.min("head").alias("a"))
            wide.append(stored(parts.select("sig", F.explode("sets").alias("b")).join(first, "sig").select("a", "b"), "wide"))
        heads = parts.select(before.alias("a"), F.col("head").alias("b")).filter("a IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return pairs.unionByName(_bounded(heads, points.dropDuplicates(["set"]), percent)).distinct()
    x, y = (parts.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in parts.columns if c != "sig"]) for s in "xy")
    bound = F.aggregate(F.zip_with("top_x", "top_y", lambda u, v: F.least(u, v)), F.lit(0).cast("long"), lambda s, v: s + v)
    one = (F.col("low_x") == F.col("high_y")) & (F.col("high_x") == F.col("low_y"))
    met = x.join(y, "sig").filter((F.col("part_x") < F.col("part_y")) & ~one & ((percent + 100) * bound >= percent * (F.col("least_x") + F.col("least_y"))))
    return pairs.unionByName(met.mapInArrow(across, "a long, b long")).distinct()


def _unjoined(members: DataFrame, linked: DataFrame | None, classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Points ``sig, set, component, n, vec`` of the buckets that hold several components and ``least`` sets at least, and the table of these buckets."""
    if linked is not None:
        members = members.join(hinted(linked, linked.count(), 16), F.col("set") == F.col("node"), "left")
    some = members.select("sig", "set", F.coalesce("component", "set").alias("component") if linked is not None else F.col("set").alias("component"))
    mixed = some.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("k"))
    mixed = stored(mixed.filter((F.col("low") < F.col("high")) & (F.col("k") >= least)).select("sig"), "mixed")
    return some.join(hinted(mixed, mixed.count(), 8), "sig").join(classes.select("set", "n", "vec"), "set"), mixed


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_shingles, component_id, key, kept``: documents joined by shingle sets that share ``percent`` of their union.

    Equal sets are one class. Classes meet in buckets of one group signature, which no similar pair
    misses; each bucket's count vectors are packed into R-trees, whose self-joins give all candidate pairs.
    Pairs that finer count vectors leave are verified by the sets. What verified links join needs no more comparing, so the trees are joined
    three times: over one bucket of each class, giving a spanning forest of what the bounds leave; over all
    buckets that still have several components, the same. What both forests join is a family: a similar pair that
    is left has both ends in one. Last, the classes of each family with several components are packed once, with their sets,
    into a tree that gives verified links only, and of these a spanning forest; rows of such pairs grow with the
    classes, not with their squares. Families too large for a tree with sets meet in the buckets, all pairs of each.

    ``component_id`` is the smallest id that links reach. A text that is null or has no words has no
    shingles and stands alone, as its own component. Rows that share an id are rows of their own; a null
    id is not smaller than another and is the component only of null ids. ``key`` is the text's xxhash64.
    ``kept`` holds for one id and key of each component, the smallest; rows that repeat both share it.
    Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = stored(_features(docs, words), "features")
    classes = stored(rows.filter("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("keep"), F.min("key").alias("key"), F.max("n").alias("n"), F.max("vec").alias("vec")), "classes")
    shared = stored(_shared(_signature_rows(docs, words, percent)), "members")
    members = stored(_different(shared), "buckets")
    discard(shared)
    good, tested, linked, wide = None, None, None, []
    for home in (True, False):
        some = members.groupBy("set").agg(F.min("sig").alias("sig")) if home else members
        points, mixed = _unjoined(some, linked, classes, 2)
        used = [mixed]
        pairs = _tree_pairs(points, percent, True, used, wide)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "tree-pairs")
        discard(*used)
        if pairs.limit(1).count():
            found = _verified(pairs, docs, classes, words, percent)
            good, tested = (found, pairs) if good is None else (good.unionByName(found), tested.unionByName(pairs))
            linked = stored(components(good), "linked")
    joined = [*wide, *([] if tested is None else [tested])]
    if joined:
        families = stored(components(reduce(DataFrame.unionByName, joined)).select(F.col("component").alias("sig"), F.col("node").alias("set")), "families")
        # Two classes that are a family of their own have been compared.
        points, mixed = _unjoined(families, linked, classes, 3)
        points = stored(points, "unjoined")
        sizes = points.groupBy("sig").agg(((F.count(F.lit(1)) <= PART) & (F.sum("n") * 8 <= PART_BYTES)).alias("fits"))
        sizes = stored(sizes, "sizes")
        of_a_tree, larger = (points.join(hinted(some, some.count(), 8), "sig") for some in (sizes.filter("fits").select("sig"), sizes.filter("NOT fits").select("sig")))
        used = [mixed, points, sizes]
        if of_a_tree.limit(1).count():
            sets = _contents(of_a_tree.select("set"), docs, classes, words, lambda sh: sh.tobytes(), "binary", "sets")
            used.append(sets)
            found = stored(_tree_pairs(of_a_tree.join(sets.dropDuplicates(["set"]), "set"), percent, used=used), "links")
            good = found if good is None else good.unionByName(found)
        if larger.limit(1).count():
            points, mixed = _unjoined(members.join(larger.select("set"), "set", "left_semi"), linked, classes, 3)
            used.append(mixed)
            pairs = _tree_pairs(points, percent, False, used)
            pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "tree-pairs")
            if pairs.limit(1).count():
                found = _verified(pairs, docs, classes, words, percent)
                good = found if good is None else good.unionByName(found)
        discard(*used)
        linked = linked if good is None else stored(components(good), "linked")
    if linked is None:
        linked = docs.sparkSession.createDataFrame([], "node long, component long")
    whole = classes.select("set", "keep").join(linked, F.col("set") == F.col("node"), "left").select("set", "keep", F.coalesce("component", "set").alias("component"))
    least = whole.groupBy("component").agg(F.min("keep").alias("least"))
    names = stored(whole.join(least, "component").select(F.col("set").alias("s"), "least"), "names")
    out = rows.select("id", "n", "set", "key").join(names, (F.col("set") == F.col("s")) & (F.col("n") > 0), "left")
    kept = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id"),
        "key",
        F.when(F.col("n") > 0, kept).otherwise(True).alias("kept"),
    )
