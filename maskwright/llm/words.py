"""Words and word hashes of many texts at once, on plain byte arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Masks that leave so many low bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but digits, letters and bytes of other scripts.
NOT_WORD = np.ones(256, bool)
NOT_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; ``gap`` flags the byte values between words."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words do not run on into the next text
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: Words up to this many bytes are hashed together, eight bytes of all at a time.
SHORT = 32


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, the same for equal words anywhere.

    Each eight bytes go through a bijective mix with what came before; longer words are hashed one by one.
    """
    length = end - start
    out = mix(length.astype(np.uint64) * _ODD)
    if not len(out):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    some = np.flatnonzero(length <= SHORT)
    for at in range(0, SHORT, 8):
        some = some[length[some] > at]
        out[some] = mix(out[some] ^ (eight[start[some] + at] & _LOW[np.minimum(length[some] - at, 8)])) * _ODD
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(out)
