"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def jaccard(rows: list[tuple], words: int, percent: int) -> dict:
    """id -> (number of shingles, smallest id reached)."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[find(i)].append(k)
    return {k: (len(sets[i]), min(low[find(i)])) for i, (k, _) in enumerate(rows)}


def repeats(texts: list, length: int) -> list[tuple]:
    """(bytes, removed bytes, removed runs, digest of what is left) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


SECRETS = [
    ("assign", re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secrets(text: str | None) -> tuple:
    spans, counts = [], []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        found = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(found))
        spans += [(m.start(), rank, m.end(), kind) for m in found]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


def random_strings(text: str, table: list[float], alphabet: str, least: int, in_all: float, per_char: float) -> list[str]:
    """``start:end`` of what base spans leave of the alphabet's runs and the table calls random."""
    covered = set()
    for span in filter(None, secrets(text)[-1].split(",")):
        _, a, b = span.split(":")
        covered |= set(range(int(a), int(b)))
    out, start = [], None
    for i in range(len(text) + 1):
        inside = i < len(text) and text[i] in alphabet and i not in covered
        if inside and start is None:
            start = i
        if not inside and start is not None:
            codes = [alphabet.index(c) for c in text[start:i]]
            ratio = sum(table[a * len(alphabet) + b] for a, b in zip(codes, codes[1:], strict=False))
            if i - start >= max(least, 1) and ratio >= max(in_all, per_char * (i - start)):
                out.append(f"{start}:{i}")
            start = None
    return out


def licenses(text: str | None, phrases: dict[str, str]) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def mix(rows: list[tuple], weights: tuple = (5, 2, 1), cap: int = 3, seed: int = 7, buckets: int = 1024) -> list[tuple]:
    """(id, source, size, target, repeats) of rows (id, text, source) with ids."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    size = Counter()
    for _, s, n in sized:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed, level = sum(size.values()), 0, 0.0
    left = sorted(order, key=lambda s: cap * size[s] / weight[s])  # those that reach their cap first
    while left:
        level = (total - fixed) / sum(weight[s] for s in left)
        if level * weight[left[0]] <= cap * size[left[0]]:
            break
        fixed += cap * size[left.pop(0)]
    target = {s: float(min(weight[s] * level if s in left else cap * size[s], cap * size[s])) for s in order}
    out = []
    for s in order:
        rate = min(target[s] / size[s], cap) if size[s] else 0.0
        want = (rate - int(rate)) * size[s]
        keyed = []
        for i, n in ((i, n) for i, of, n in sized if of == s):
            h = xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
            keyed.append(((h >> 20) % buckets, h - (1 << 64) if h >> 63 else h, i, n))
        keyed.sort()
        sums = Counter()
        for b, *_, n in keyed:
            sums[b] += n
        before, edge = 0, buckets
        for b in sorted(sums):
            if before + sums[b] > want:
                edge = b
                break
            before += sums[b]
        for b, _, i, n in keyed:
            before += n if b == edge else 0
            out.append((i, s, n, target[s], int(rate) + (b < edge or (b == edge and before - n / 2 <= want))))
    return out


def _grams(text: str | None) -> Counter:
    """N-grams of 1 to 3 letters as numbers, in base 2 ** 21; what is no letter is a 1."""
    s = "".join(c if c.isalpha() else "\x01" for c in text or "")
    s = re.sub("\x01+", "\x01", s).lstrip("\x01")
    s = "\x01" + "".join(low if len(low := c.lower()) == 1 else c for c in s) + "\x01"
    found = Counter()
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            if k > 1 or s[i] != "\x01":
                found[sum(ord(c) << 21 * (k - 1 - j) for j, c in enumerate(s[i : i + k]))] += 1
    return found if len(s) > 2 else Counter()


def languages(rows: list[tuple], top: int = 300) -> dict:
    """id -> (language, score) of rows (id, text, lang), learned from those outside fold 1."""
    best = lambda c: sorted(c, key=lambda g: (-c[g], g))[:top]
    sums = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 1:
            sums[lang].update(_grams(t))
    profiles = {lang: {g: r for r, g in enumerate(best(sums[lang]))} for lang in sorted(sums)}
    out = {}
    for i, t, _ in rows:
        mine = best(_grams(t))
        away = {lang: sum(abs(p[g] - r) if g in p else top for r, g in enumerate(mine)) for lang, p in profiles.items()}
        near = min(away, key=away.get, default=None) if mine else None
        out[i] = (near, max(0.0, 1 - away[near] / (top * len(mine)))) if near is not None else ("und", 0.0)
    return out
