"""Token ids by a public tokenizer file: encoding, and grammar-compressed files of ids."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import columns, hinted, new_table, release, slices

END_ID = 2
#: Distinct text pieces whose ids a worker remembers; beyond that it forgets those that did not come again.
REMEMBERED = 600_000
#: Text looked up at once, and new pieces encoded at once; both bound a worker's memory.
SLICE, PIECES = 3 << 20, 16_384

_SOLID = np.zeros(256, bool)  # visible ASCII
_SOLID[0x21:0x7F] = True
_WORDLIKE = _SOLID.copy()  # also the first bytes of scripts that have no white space
_WORDLIKE[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123]] = True
#: First bytes of characters of two and three bytes, and of any, among which no white space is.
_TWO, _THREE, _BEGINS = np.zeros(256, bool), np.zeros(256, bool), _SOLID.copy()
_TWO[0xC3:0xE0] = True
_THREE[0xE4:0xED] = True
_BEGINS |= _TWO | _THREE
U = np.uint64


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that the tokenizer treats alone, whatever stands around them.

    Texts are cut before a blank with a visible character after it, after an ASCII letter that another
    ASCII character follows, and after a single line break. The tokenizer's splitting pattern cuts there too.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 1:
        solid, letter = _SOLID[data], _LETTER[data]
        at[: n - 1] |= (data[:-1] == 32) & _WORDLIKE[data[1:]]
        at[1:n] |= letter[:-1] & ~letter[1:] & (data[1:] < 128)
        at[2:n] |= (data[1:-1] == 10) & solid[2:] & solid[:-2]
        # A blank at a text's end stays with what stands before it.
        ends = offsets[1:-1] - 1
        ends = ends[(ends >= 0)]
        lone = ends[data[ends] == 32]
        at[lone] = (lone > 0) & letter[lone - 1]
    at[offsets] = True
    at[n] = False
    return np.flatnonzero(at)


def _eight(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one integer."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))[start] & W._LOW[np.minimum(length, 8)]


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + length`` of each stretch, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """Numbers for pieces of text, found again by their bytes: a table with open addressing, probed for many at once.

    A piece of up to 16 bytes is its length with its first and its last eight bytes, so that equal keys are
    equal pieces. Longer ones are kept in a dictionary of their bytes.
    """

    def __init__(self, bits: int = 18):
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        self.keys, self.n, self.long = np.zeros((0, 3), U), 0, {}

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = W.mix(keys[:, 0] ^ W.mix(keys[:, 1] + keys[:, 2]))
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those not in the table."""
        out, open_, mask = np.full(len(keys), -1, np.int64), np.arange(len(keys)), len(self.slots) - 1
        while len(open_):
            got = self.slots[at[open_]]
            there = got >= 0
            open_, got = open_[there], got[there]
            known = self.keys[got]
            mine = keys[open_] if len(open_) < len(keys) else keys
            same = (known[:, 0] == mine[:, 0]) & (known[:, 1] == mine[:, 1]) & (known[:, 2] == mine[:, 2])
            out[open_[same]] = got[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number different keys that are not in the table, from ``n`` on; those of length 0 stand for longer pieces."""
        if self.n + len(keys) > len(self.slots) // 2:
            self.bits = max(self.bits + 1, (2 * (self.n + len(keys))).bit_length())
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._put(np.flatnonzero(self.keys[: self.n, 2]))
        if self.n + len(keys) > len(self.keys):
            self.keys = np.concatenate((self.keys, np.zeros((self.n + 2 * len(keys), 3), U)))
        self.keys[self.n : self.n + len(keys)] = keys
        self.n += len(keys)
        self._put(self.n - len(keys) + np.flatnonzero(keys[:, 2]))

    def skip(self, n: int) -> None:
        """Take the next numbers for longer pieces, which are found in the dictionary."""
        if self.n + n > len(self.keys):
            self.keys = np.concatenate((self.keys, np.zeros((self.n + 2 * n, 3), U)))
        self.keys[self.n : self.n + n] = 0
        self.n += n

    def _put(self, numbers: np.ndarray) -> None:
        at, mask = self.place(self.keys[numbers]), len(self.slots) - 1
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & mask


class Encoder:
    """Encodes many texts with a tokenizers file; a piece of text that came before is looked up.

    The file must be a byte-level BPE whose splitting pattern keeps a blank with the word after it
    (contractions, letters, digits, other signs, white space), as the public 50k vocabularies do.
    Pieces are found again by their bytes. The file's added tokens are one id each wherever their strings
    stand; they must not take blanks or ask for word bounds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"added tokens that take blanks or ask for word bounds: {path}")
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.any_added = re.compile(b"|".join(map(re.escape, self.added)))  # the longest at a place
        self._keep(None)

    def _keep(self, numbers: np.ndarray | None) -> None:
        """Remember only the pieces of these numbers."""
        if numbers is None:
            self.pieces, self.ids, self.start = Pieces(), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        else:
            old, bounds, ids = self.pieces, self.start, self.ids
            count = (bounds[1:] - bounds[:-1])[numbers]
            self.pieces, self.ids, self.start = Pieces(), ids[_ragged(bounds[numbers], count)], np.concatenate(([0], np.cumsum(count)))
            new = np.full(old.n, -1)
            new[numbers] = np.arange(len(numbers))
            self.pieces.add(old.keys[numbers])
            self.pieces.long = {x: int(new[i]) for x, i in old.long.items() if new[i] >= 0}
        self.again = np.zeros(self.pieces.n, bool)

    def _has_added(self, text: bytes) -> bool:
        return any(t in text for t in self.added)

    def _sections(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each added token in the texts. What stands before and after one is encoded like a text of its own."""
        raw = data.tobytes()
        found = [m.span() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False) for m in self.any_added.finditer(raw, a, b)] if self._has_added(raw) else []
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def _encode_at(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has. Most are encoded together as one text, kept apart by blanks or line breaks."""
        counts, end = np.zeros(len(start), np.int64), start + length
        at = lambda i: data[np.clip(i, 0, len(data) - 1)]
        first, last = at(start), at(end - 1)
        blank = first == 32
        # No piece begins or ends by white space of any script.
        solid = _BEGINS[np.where(blank & (length > 1), at(start + 1), first)] & ~(blank & (length == 1))
        solid &= _SOLID[last] | (last >= 128) & (length > 2 + blank) & (_TWO[at(end - 2)] | _THREE[at(end - 3)] & (at(end - 2) >= 128))
        joined = np.flatnonzero(solid & (length > 0)) if not alone else np.zeros(0, np.int64)
        ids = np.zeros(0, np.uint32)
        if len(joined):
            gap = ~blank[joined]
            width = length[joined] + gap
            stop = np.cumsum(width)
            text = np.full(int(stop[-1]), 10, np.uint8)
            text[_ragged(stop - length[joined], length[joined])] = data[_ragged(start[joined], length[joined])]
            raw = text.tobytes()
            if not self._has_added(raw):
                ids = np.array(self.tokenizer.encode_batch_fast([raw.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
                upto = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
                a, b = np.searchsorted(upto, stop - length[joined]), np.searchsorted(upto, stop)
                if upto[-1] != len(text) or (upto[a] != stop - length[joined]).any() or (upto[b] != stop).any():
                    ids = np.zeros(0, np.uint32)
            if len(ids):
                counts[joined] = b - a
                ids = ids[_ragged(a, b - a)]
            else:
                joined = joined[:0]
        rest = np.ones(len(start), bool)
        rest[joined] = False
        rest = np.flatnonzero(rest)
        if not len(rest):
            return ids, counts
        made = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)], add_special_tokens=False)]
        counts[rest] = [len(x) for x in made]
        bounds = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[_ragged(bounds[joined], counts[joined])] = ids
        out[_ragged(bounds[rest], counts[rest])] = [i for x in made for i in x]
        return out, counts

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a list of pieces, without the memory."""
        data, length = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces], np.int64)
        return self._encode_at(data, np.cumsum(length) - length, length, self._has_added(data.tobytes()))

    def _remember(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, alone: bool) -> None:
        """Encode pieces that are not known; their numbers are the next ones."""
        parts = [self._encode_at(data, start[i : i + PIECES], length[i : i + PIECES], alone) for i in range(0, len(start), PIECES)]
        self.ids = np.concatenate((self.ids, *(x for x, _ in parts)))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate([n for _, n in parts]))))
        self.again = np.concatenate((self.again, np.zeros(len(start), bool)))

    def _numbers(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, alone: bool) -> np.ndarray:
        """Number of each piece; new pieces are encoded."""
        keys = np.stack((_eight(data, start, length), _eight(data, np.maximum(start, start + length - 8), length), length.astype(U)), 1)
        long = np.flatnonzero(length > 16)
        out = self.pieces.find(keys, self.pieces.place(keys))
        out[long] = -1
        self.again[out[out >= 0]] = True
        while len(new := np.flatnonzero((out < 0) & (length <= 16))):
            at = self.pieces.place(keys[new])
            _, some = np.unique(at, return_index=True)  # one of each place; others that are different come in the next round
            self.pieces.add(keys[new[some]])
            self._remember(data, start[new[some]], length[new[some]], alone)
            out[new] = self.pieces.find(keys[new], self.pieces.place(keys[new]))
        if len(long):
            raw = [data[a : a + n].tobytes() for a, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
            first: dict[bytes, int] = {}
            for i, x in zip(long.tolist(), raw, strict=True):
                if x not in self.pieces.long:
                    first.setdefault(x, i)
            if first:
                self.pieces.long.update(zip(first, range(self.pieces.n, self.pieces.n + len(first)), strict=True))
                fresh = np.fromiter(first.values(), np.int64)
                self.pieces.skip(len(first))
                self._remember(data, start[fresh], length[fresh], alone)
            out[long] = [self.pieces.long[x] for x in raw]
            self.again[out[long]] = length[long] <= 64
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets) in one array, each text's followed by ``end_id``, and their offsets."""
        if self.pieces.n > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            kept = np.flatnonzero(self.again)
            self._keep(kept if len(kept) < REMEMBERED // 2 else None)
        first, last = self._sections(data, offsets)
        start = cuts(data, np.sort(np.concatenate((offsets, first, last))))
        if len(first):
            token = np.searchsorted(first, start, side="right") - 1
            start = start[(token < 0) | (start == first[token]) | (start >= last[token])]
        length = np.append(start[1:], len(data))[: len(start)] - start
        place = self._numbers(data, start, length, alone=len(first) > 0)
        count = (self.start[1:] - self.start[:-1])[place]
        ends = np.cumsum(count)
        out = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        ids = self.ids[_ragged(self.start[place], count)]
        if end_id is None:
            return ids, out
        whole = np.full(len(ids) + len(offsets) - 1, end_id, np.uint32)
        texts = np.diff(out)
        whole[np.repeat(np.arange(len(texts)), texts) + np.arange(len(ids))] = ids
        return whole, out + np.arange(len(out))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def encoded(column: pa.Array, path: str, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a text column, of about ``limit`` bytes of text, as (first row, end row, ids, offsets)."""
    enc = encoder(path)
    for row, end, data, offsets in slices(column, limit):
        yield row, end, *enc.encode(data, offsets)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


# Grammar compression: a shard's ids as a shorter sequence over ids and rules, each rule a pair of symbols.

#: Ids in a shard, about; a longer document makes a longer shard.
SHARD = 400_000
PAIRS, LEAST = 1024, 16


def _replace(seq: np.ndarray, at: np.ndarray, rank: np.ndarray, base: int) -> np.ndarray:
    """Replace the pairs that start ``at`` by the symbols ``base + rank``; where pairs overlap, the more frequent (first) one goes in."""
    near = np.diff(at) == 1
    if near.any():
        # In a run of overlapping pairs keep local minima of (rank, place); equal neighbours alternate.
        keep = np.ones(len(at), bool)
        keep[1:] &= ~(near & (rank[:-1] < rank[1:]))
        keep[:-1] &= ~(near & (rank[1:] < rank[:-1]))
        same = np.concatenate(([False], near & (rank[:-1] == rank[1:])))
        if same.any():
            begin = np.flatnonzero(~same)
            keep &= (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
        at, rank = at[keep], rank[keep]
        free = np.ones(len(at), bool)
        free[1:] = np.diff(at) > 1
        at, rank = at[free], rank[free]
    seq[at] = base + rank
    rest = np.ones(len(seq), bool)
    rest[at + 1] = False
    return seq[rest]


def _hits(seq: np.ndarray, at: np.ndarray | None, left: np.ndarray, right: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, rank) of the pairs ``left, right`` in the sequence, looked for at the places ``at`` or everywhere."""
    row, col = np.full(n_symbols, -1, np.int32), np.full(n_symbols, -1, np.int32)
    us, vs = np.unique(left), np.unique(right)
    row[us], col[vs] = np.arange(len(us)) * len(vs), np.arange(len(vs))
    table = np.full(len(us) * len(vs), -1, np.int16)
    table[row[left] + col[right]] = np.arange(len(left))
    r, c = (row[seq[:-1]], col[seq[1:]]) if at is None else (row[seq[at]], col[seq[at + 1]])
    some = np.flatnonzero((r >= 0) & (c >= 0))
    rank = table[r[some] + c[some]]
    hit = np.flatnonzero(rank >= 0)
    return some[hit] if at is None else at[some[hit]], rank[hit].astype(np.int32)


def compress(ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one shard: (sequence, rules as pairs of symbols, expansion length of each rule).

    Each round counts neighbouring pairs and replaces the most frequent ones by new symbols, from
    ``n_ids`` on, until no pair is frequent. Pairs without a symbol of the last round are counted again
    where that left some aside, and at the end.
    """
    seq, rules, lengths = ids.astype(np.int32), [np.zeros((0, 2), np.int64)], np.ones(n_ids, np.int64)
    fresh = 0
    while len(seq) > LEAST:
        at = None
        if fresh:
            new = np.flatnonzero(seq >= fresh)
            at = np.union1d(new[new < len(seq) - 1], new[new > 0] - 1)
            pairs = seq[at].astype(np.int64) << 32 | seq[at + 1]
        else:
            pairs = seq[:-1].astype(np.int64) << 32 | seq[1:]
        pairs.sort()
        start = np.concatenate(([0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)) if len(pairs) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(pairs)))
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            if not fresh:
                break
            fresh = 0
            continue
        best = often[np.lexsort((often, -count[often]))[:PAIRS]]
        left, right = pairs[start[best]] >> 32, pairs[start[best]] & 0xFFFFFFFF
        base = len(lengths)
        fresh = base if len(often) <= PAIRS else 0
        seq = _replace(seq, *_hits(seq, at, left, right, base), base)
        rules.append(np.stack((left, right), 1))
        lengths = np.concatenate((lengths, lengths[left] + lengths[right]))
    return seq, np.concatenate(rules), lengths[n_ids:]


#: Rules that stand for more ids than this are undone step by step, so that their expansions take no room.
WRITTEN_OUT = 64


def expand(seq: np.ndarray, rules: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of a sequence of symbols: longer rules are undone one step for all at once, the others are written out once and looked up."""
    parts: list[list[int] | None] = []
    of = lambda x: [x] if x < n_ids else parts[x - n_ids]
    for left, right in rules.tolist():
        x, y = of(left), of(right)
        parts.append(x + y if x and y and len(x) + len(y) <= WRITTEN_OUT else None)
    length = np.array([len(x) if x else 0 for x in parts], np.int64)
    flat = np.fromiter(chain.from_iterable(x for x in parts if x), np.int64)
    begin = np.cumsum(length) - length
    seq = seq.astype(np.int64)
    long = np.concatenate((np.zeros(n_ids, bool), length == 0))
    while len(hit := np.flatnonzero(long[seq])):
        place = np.zeros(len(seq), bool)
        place[hit] = True
        at = hit + np.arange(len(hit))
        out = np.empty(len(seq) + len(hit), np.int64)
        alone = np.ones(len(out), bool)
        alone[at] = alone[at + 1] = False
        out[alone] = seq[~place]
        out[at], out[at + 1] = rules[seq[hit] - n_ids].T
        seq = out
    hit = np.flatnonzero(seq >= n_ids)
    if not len(hit):
        return seq
    width = np.ones(len(seq), np.int64)
    width[hit] = length[seq[hit] - n_ids]
    end = np.cumsum(width)
    out = np.empty(int(end[-1]), np.int64)
    out[end - width] = seq
    out[_ragged((end - width)[hit], width[hit])] = flat[_ragged(begin[seq[hit] - n_ids], width[hit])]
    return out


def expand_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, n_ids: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a shard: only the symbols that hold them are expanded."""
    width = np.concatenate((np.ones(n_ids, np.int64), lengths))[seq]
    end = np.cumsum(width)
    a, b = int(np.searchsorted(end, start, side="right")), int(np.searchsorted(end, start + n))
    skip = start - int(end[a] - width[a]) if a < len(seq) else 0
    return expand(seq[a : b + 1], rules, n_ids)[skip : skip + n]


_SHARD = "part int, shard int, n_ids int, doc_ids array<{}>, doc_tokens array<long>, n_tokens long, wide boolean, sequence binary, rules binary, lengths binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all ids in ascending order of the document id, of whatever type, each document ended by id 2.

    The files are Parquet. A row is a shard: its documents' ids and token counts, the compressed sequence
    (16 or 32 bits a symbol), the rules and their expansion lengths. A null text counts as empty, a null
    id comes first; rows that share an id stand side by side, in the order of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n_ids = TaskContext.get().partitionId(), encoder(tokenizer).tokenizer.get_vocab_size()
        held_ids, held, tokens, shard = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            seq, rules, lengths = compress(ids, n_ids)
            wide = n_ids + len(rules) > 1 << 16
            row = [[part], [shard], [n_ids], [held_ids], [tokens], [len(ids)], [wide], [seq.astype("<u4" if wide else "<u2").tobytes()], [rules.astype("<u4").tobytes()], [lengths.astype("<u4").tobytes()]]
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            doc_ids, text = columns(batch, "id", "text")
            doc_ids = doc_ids.to_pylist()
            for row, end, ids, offsets in encoded(text, tokenizer):
                n = np.diff(offsets)
                at = row
                while at < end:
                    room = max(1, int(np.searchsorted(np.cumsum(n[at - row :]), SHARD - sum(map(len, held)), side="right")))
                    to = min(end, at + room)
                    held.append(ids[offsets[at - row] : offsets[to - row]])
                    held_ids += doc_ids[at:to]
                    tokens += n[at - row : to - row].tolist()
                    at = to
                    if sum(map(len, held)) >= SHARD or at < end:
                        yield flush()
                        held_ids, held, tokens, shard = [], [], [], shard + 1
        if held_ids:
            yield flush()
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("wide", pa.bool_()), ("sequence", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary())]
    )
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, _SHARD.format(kind.simpleString())).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, doc_col: str = "doc_id") -> DataFrame:
    """``<doc_col>, start, n_tokens, ids_crc32`` of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                seq = np.frombuffer(s["sequence"], "<u4" if s["wide"] else "<u2").astype(np.int64)
                rules = np.frombuffer(s["rules"], "<u4").astype(np.int64).reshape(-1, 2)
                ids = expand(seq, rules, s["n_ids"]).astype("<u4")
                n = np.array(s["doc_tokens"], np.int64)
                end = np.cumsum(n)
                yield pa.record_batch(
                    [
                        pa.array([s["part"]] * len(n), pa.int32()),
                        pa.array([s["shard"]] * len(n), pa.int32()),
                        pa.array(s["doc_ids"], to_arrow_type(kind)),
                        pa.array(end - n),
                        pa.array(n),
                        pa.array([crc(ids[b - k : b]) for b, k in zip(end.tolist(), n.tolist(), strict=True)], pa.int64()),
                    ],
                    ["part", "shard", "id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    docs = files.mapInArrow(run, f"part int, shard int, id {kind.simpleString()}, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one number for each partition
    ends = np.cumsum([r["n"] for r in parts]).tolist()
    before = spark.createDataFrame([(r["part"], e - r["n"]) for r, e in zip(parts, ends, strict=True)], "part int, before long")
    whole = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    shards = sizes.withColumn("in_part", whole).join(F.broadcast(before), "part").select("part", "shard", (F.col("in_part") + F.col("before")).alias("first"))
    shards = hinted(shards, sizes.count(), 40)
    return docs.join(shards, ["part", "shard"]).select(F.col("id").alias(doc_col), (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to files, in the shared folder where no path is given, and read each document back."""
    path = path or new_table(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)
