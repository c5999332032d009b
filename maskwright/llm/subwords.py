"""Texts by two more encoders that remember units of text: a sentencepiece BPE, and a byte-level BPE without special tokens."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .tokens import Encoder, Pieces, _eight, _ragged

U = np.uint64
#: Units remembered by a worker, and their bytes of more than 16; beyond either all are forgotten.
REMEMBERED, LONG_BYTES = 1_000_000, 32 << 20
#: Units remembered where a worker remembers another vocabulary's pieces too.
BESIDE = 300_000
#: Pairs of tokens remembered; units up to so many characters go through their prefixes together, so many characters at once.
PAIRS, SHORT, BLOCK = 1_000_000, 48, 200_000


class Units:
    """Numbers for the distinct units of text that came so far; units are found again by their bytes."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.pieces, self.long_bytes = most, Pieces(), 0

    @property
    def full(self) -> bool:
        return self.pieces.n > self.most or self.long_bytes > LONG_BYTES

    def numbers(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Each unit's number, and for each new number, in order, the place in ``start`` of a unit that has it."""
        keys = np.stack((_eight(data, start, length), _eight(data, np.maximum(start, start + length - 8), length), length.astype(U)), 1)
        out, new = self.pieces.find(keys, self.pieces.place(keys)), []
        out[length > 16] = -1
        while len(open_ := np.flatnonzero((out < 0) & (length <= 16))):
            _, some = np.unique(self.pieces.place(keys[open_]), return_index=True)  # others that are different come in the next round
            self.pieces.add(keys[open_[some]])
            new += open_[some].tolist()
            out[open_] = self.pieces.find(keys[open_], self.pieces.place(keys[open_]))
        known, before = self.pieces.long, self.pieces.n
        for i in np.flatnonzero(length > 16).tolist():
            raw = data[start[i] : start[i] + length[i]].tobytes()
            got = known.get(raw)
            if got is None:
                got = known[raw] = before
                before += 1
                new.append(i)
                self.long_bytes += len(raw)
            out[i] = got
        self.pieces.skip(before - self.pieces.n)
        return out, new


class Ragged:
    """Arrays of different lengths, one for each number, one after the other."""

    def __init__(self, kind: type):
        self.values, self.start, self.used = np.zeros(0, kind), np.zeros(1, np.int64), 0

    def append(self, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.append_flat(np.fromiter(chain.from_iterable(lists), self.values.dtype, int(lengths.sum())), lengths)

    def append_flat(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n = len(values)
        if self.used + n > len(self.values):
            self.values = np.concatenate((self.values[: self.used], np.zeros(self.used + 2 * n, self.values.dtype)))
        self.values[self.used : self.used + n] = values
        self.start = np.concatenate((self.start, self.used + np.cumsum(lengths)))
        self.used += n

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.start[numbers + 1] - self.start[numbers]

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.values[_ragged(self.start[numbers], self.lengths(numbers))]


class PieceModel:
    """A sentencepiece BPE model and the rules that make its units.

    The model must leave texts as they are (identity normaliser, white space kept), put a blank before
    them, fall back to bytes, and have no piece with a line break. No merge crosses two characters that are
    neighbours in no piece, so texts can be cut between them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for i in range(len(pieces))]
        vocabulary = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
        if any(self.model.is_unused(i) for i in range(len(pieces))):
            raise ValueError(f"a vocabulary with pieces that are not used: {path}")
        self.longest = max(map(len, vocabulary))
        #: What each id stands for: its bytes, a blank for U+2581.
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        probe = "\n \tx  ﬁ "
        if b"".join(self.bytes[i] for i in self.model.encode(probe)) != f" {probe}".encode() or "\n" in vocabulary:
            raise ValueError(f"a model that changes texts or has no bytes to fall back to: {path}")
        self.n_bytes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.head = self.model.encode("\n")  # a blank and a line break, which merges with nothing
        self.pieces = [p.replace("▁", " ") for p in pieces]
        self._no_pairs()
        #: The last byte of one and the first byte of the next character of some piece, or two bytes of a character.
        self.together = np.zeros((256, 256), bool)
        self.together[128:, 128:192] = True
        same = lambda c: (c, "▁") if c == " " else (c,)
        for x, y in {x + y for p in self.pieces for x, y in zip(p, p[1:], strict=False)}:
            self.together[[a.encode()[-1] for a in same(x)], [[b.encode()[0]] for b in same(y)]] = True
        # A tree of the pieces' characters as sorted keys (state, character) with the states that they lead to.
        self.char_ids = np.zeros(0x110000, np.int64)
        letters = sorted({c for p in vocabulary for c in p})
        self.char_ids[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_chars = len(letters) + 1
        heads = {p[:n] for p in vocabulary for n in range(1, len(p) + 1)}
        state = {"": 0} | {h: i for i, h in enumerate(sorted(heads), 1)}
        keys = np.array([state[h[:-1]] * self.n_chars + int(self.char_ids[ord(h[-1])]) for h in state if h], np.int64)
        order = np.argsort(keys)
        self.edges, self.to_state = keys[order], np.array([i for h, i in state.items() if h], np.int64)[order]
        self.token_of = np.array([vocabulary.get(h, -1) for h in state], np.int64)
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units that begin with their own blank, or follow a line break."""
        own = [u[0] == " " and bool(u.strip(" ")) for u in units]
        made = self.model.encode([u[1:] if o else "\n" + u for u, o in zip(units, own, strict=True)], num_threads=1)
        return [ids if o else ids[len(self.head) :] for ids, o in zip(made, own, strict=True)]

    def stay(self, keys: np.ndarray) -> np.ndarray:
        """Whether tokens are how their joined text is encoded, for keys ``(a + 1) * vocabulary + b``; a is -1 where nothing merges with b."""
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        if (miss := self.pairs[at] != keys).any():
            new = np.unique(keys[miss])
            both = [[a - 1, b] if a else [b] for a, b in zip(*(x.tolist() for x in np.divmod(new, len(self.bytes))), strict=True)]
            names = self.pieces
            made = self.model.encode(["\n" + "".join([names[i] for i in x]) for x in both], num_threads=1)
            stays = np.fromiter((m[len(self.head) :] == x for m, x in zip(made, both, strict=True)), bool, len(both))
            if len(self.pairs) > PAIRS:
                self._no_pairs()
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.stays = np.insert(self.pairs, place, new), np.insert(self.stays, place, stays)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            if (self.pairs[at] != keys).any():  # some were forgotten on the way
                return self.stay(keys)
        return self.stays[at]

    def _no_pairs(self) -> None:
        self.pairs, self.stays = np.full(1, -1, np.int64), np.zeros(1, bool)

    def _tokens_from(self, chars: np.ndarray, start: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: which of the places have room for it, and the token of that length there or -1."""
        alive, state = np.arange(len(start)), np.zeros(len(start), np.int64)
        for step in range(self.longest):
            ok = room[alive] > step
            alive, state = alive[ok], state[ok]
            keys = state * self.n_chars + chars[start[alive] + step]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            ok = self.edges[at] == keys
            alive, state = alive[ok], self.to_state[at[ok]]
            if not len(alive):
                return
            yield alive, self.token_of[state]

    def long_steps(self, unit: str) -> np.ndarray:
        """The same for one unit of any length, character by character."""
        text, size, vocabulary, known = unit.replace(" ", "▁"), len(self.bytes), self.vocabulary, self.known
        last, count = array("q", [-1]), array("q", [0])
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                token = vocabulary.get(text[start:end])
                if token is None:
                    continue
                key = (last[start] + 1) * size + token
                good = known.get(key)
                if good is None:
                    if len(known) > PAIRS:
                        known.clear()
                    good = known[key] = bool(self.stay(np.array([key]))[0])
                if good:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                last.append(-1)
                count.append(count[end - 1] + len(text[end - 1].encode()))
        return np.diff(np.frombuffer(count, np.int64))

    def steps(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, characters of each unit) of units in their order, some thousand at a time."""
        out, lengths, held, room = [], [], [], 0
        for unit in [*units, None]:
            if held and (unit is None or len(unit) > SHORT or room > BLOCK):
                for kept, part in zip((out, lengths), self.prefix_steps(held), strict=True):
                    kept.append(part)
                held, room = [], 0
            if unit is not None and len(unit) > SHORT:
                out.append(self.long_steps(unit))
                lengths.append(np.array([len(unit)]))
            elif unit is not None:
                held.append(unit)
                room += len(unit)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *out]), np.concatenate([empty, *lengths])

    def prefix_steps(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, characters of each unit): by how much the exact token count of a unit's prefixes grows with each character.

        A prefix ends by the one token that stays beside the last token of what stands before it, and
        its count is that part's and one. All units go through their prefixes together, so that no prefix is encoded.
        """
        text = "".join(units).replace(" ", "▁")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(length) - length
        chars = self.char_ids[points]
        inside = np.arange(len(points)) - np.repeat(begin, length)
        room = np.repeat(length, length) - inside
        # tokens[k] is the token of k + 1 characters that ends at a place, or -1
        tokens = np.full((self.longest, len(points)), -1, np.int32)
        for k, (alive, token) in enumerate(self._tokens_from(chars, np.arange(len(points)), room)):
            tokens[k, alive + k] = token
        last, count = np.full(len(points) + len(units), -1, np.int64), np.zeros(len(points) + len(units), np.int64)
        # A unit's prefix of n characters is at its begin + its number + n.
        shift = np.repeat(np.arange(len(units)), length) + np.arange(len(points)) + 1
        order = np.argsort(inside, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(inside, minlength=1))))
        for end in range(len(bounds) - 1):
            place = order[bounds[end] : bounds[end + 1]]
            for k in range(min(self.longest, end + 1) - 1, -1, -1):
                token = tokens[k, place]
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                to = shift[place[some]]
                before = to - k - 1
                good = self.stay((last[before] + 1) * len(self.bytes) + token[some])
                last[to[good]], count[to[good]] = token[some[good]], count[before[good]] + 1
                left = np.ones(len(place), bool)
                left[some[good]] = False
                place = place[left]
            to = shift[place]  # characters that only bytes can say; nothing merges with them
            point = points[place]
            count[to] = count[to - 1] + 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        return count[shift] - count[shift - 1], length


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def unit_starts(data: np.ndarray, offsets: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Where texts can be cut for a ``PieceModel``: between two bytes that stand ``together`` in none of its pieces."""
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n:
        at[1:n] = ~together[data[:-1], data[1:]]
    at[offsets] = True
    at[n] = False
    return np.flatnonzero(at)


def with_blank(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with a blank before it; empty ones stay empty."""
    length = np.diff(offsets)
    some = length > 0
    ends = np.concatenate(([0], np.cumsum(length + some)))
    out = np.full(int(ends[-1]), 32, np.uint8)
    out[_ragged((ends[:-1] + 1)[some], length[some])] = data
    return out, ends


class PieceEncoder:
    """Ids of many texts by a ``PieceModel``; each distinct unit is encoded once."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.forget()

    def forget(self) -> None:
        self.units, self.ids, self.exact = Units(BESIDE), Ragged(np.uint16 if len(self.model.bytes) <= 1 << 16 else np.uint32), np.zeros(0, bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, exact) of texts that begin with a blank; ``exact`` where the tokens' bytes are the text."""
        if self.units.full:
            self.forget()
        start = unit_starts(data, offsets, self.model.together)
        length = np.append(start[1:], len(data))[: len(start)] - start
        numbers, new = self.units.numbers(data, start, length)
        if new:
            raw = [data[start[i] : start[i] + length[i]].tobytes() for i in new]
            made = self.model.encode([x.decode("utf-8", "replace") for x in raw])
            self.ids.append(made)
            of = self.model.bytes
            self.exact = np.concatenate((self.exact, [b"".join([of[i] for i in ids]) == x for ids, x in zip(made, raw, strict=True)]))
        upto = np.concatenate(([0], np.cumsum(self.ids.lengths(numbers))))
        rows = np.searchsorted(start, offsets)
        wrong = np.concatenate(([0], np.cumsum(~self.exact[numbers])))
        return self.ids.of(numbers).astype(np.uint32), upto[rows], np.diff(wrong[rows]) == 0


class PlainEncoder(Encoder):
    """An ``Encoder`` to which the strings of special tokens are text like any other."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(2)
def plain_encoder(path: str) -> PlainEncoder:
    return PlainEncoder(path)
