"""License scans by template-markup matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import columns, slices

# Phrases whose places count, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common licenses and notices. [ ] marks wording that may be absent, {n} stands for
# up to n words of any kind.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [the license]",
    "gpl-2.0": "gnu general public license [as published by the free software foundation] [either] version 2 [of the license] [or at your option any later version]",
    "gpl-3.0": "gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]",
    "cc-by-4.0": "[creative commons attribution] cc by 4 0",
    "cc-by-sa-4.0": "[creative commons attribution sharealike] cc by sa 4 0",
    "cc-by-nc-4.0": "[creative commons attribution noncommercial] cc by nc 4 0",
    "cc-by-nd-4.0": "[creative commons attribution noderivatives] cc by nd 4 0",
    "mit-notice": "[released|licensed|distributed] under the [terms of the] mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
    "the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
    "shall {12} be liable for any claim damages or other liability",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution [3] "
    "[neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission] this software is provided by {12} as is",
}


@dataclass
class Automaton:
    """Token automaton of one template: word edges, and edges that any word or none takes."""

    label: str
    moves: list[dict[bytes | None, int]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def first(self) -> set[bytes]:
        return {w for s in self.closed({0}) for w in self.moves[s] if w}

    def longest(self, word, n: int) -> int:
        """Words of the longest match from the start of ``word(0), word(1), …``, 0 without one."""
        states, best, end = self.closed({0}), 0, len(self.moves) - 1
        for i in range(n):
            w = word(i)
            states = self.closed({m[k] for m in map(self.moves.__getitem__, states) for k in (w, None) if k in m})
            if not states:
                break
            if end in states:
                best = i + 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Automaton for words, ``[optional wording]`` (``a|b`` inside: one of them) and ``{n}``: up to n words of any kind."""
    out = Automaton(label)
    at, opened = 0, []
    for token in re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", markup):
        if token == "[":
            opened.append((at, []))
        elif token == "|":
            opened[-1][1].append(at)
            at = opened[-1][0]
        elif token == "]":
            start, ends = opened.pop()
            join = out._state()
            for s in (start, at, *ends):
                out.free[s].add(join)
            at = join
        elif token[0] == "{":
            stops = [at]
            for _ in range(int(token[1:-1])):
                to = out._state()
                out.moves[at][None] = to
                at = to
                stops.append(at)
            end = out._state()
            for s in stops:
                out.free[s].add(end)
            at = end
        else:
            to = out._state()
            out.moves[at][token.encode()] = to
            at = to
    end = out._state()
    out.free[at].add(end)
    return out


def _hash(word: str | bytes) -> np.uint64:
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return W.hashes(data, np.array([0]), np.array([len(data)]))[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Phrases and license templates in whole texts.

    Words are runs of digits, letters and other scripts after lower-casing A-Z. Returns for each row
    ``<id_col>, n_words, n_base`` (places of all phrases), ``first_word, last_word`` (smallest and largest
    start of a phrase, else null), ``base_labels, labels`` (distinct, sorted, comma-joined; ``labels`` has the
    templates' too), ``score`` (share of the words that templates cover) and ``matches`` (label, first word,
    number of words). Matches of one template do not overlap: the first, as long as possible, counts.
    A null or empty text gives zeros, nulls and empty strings. Other columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [([_hash(w) for w in p.split()], label) for p, label in phrases.items()]
        automata = [compile_template(*x) for x in templates.items()]
        starts_with: dict[bytes, list[Automaton]] = {}
        for a in automata:
            for w in a.first():
                starts_with.setdefault(w, []).append(a)
        first_hashes = np.array(sorted(_hash(w) for w in starts_with), np.uint64)
        for batch in batches:
            ids, text = columns(batch, "id", "text")
            for row, end, data, offsets in slices(text):
                data, rows = W.LOWER[data], end - row
                start, stop, of = W.spans(data, offsets, W.NOT_WORD)
                h = W.hashes(data, start, stop)
                from_word = np.searchsorted(start, offsets)
                n_words, n_base = np.diff(from_word), np.zeros(rows, np.int64)
                low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                labels: list[set[str]] = [set() for _ in range(rows)]
                for parts, label in wanted:
                    m = len(parts)
                    if len(h) < m:
                        continue
                    hit = of[: len(h) - m + 1] == of[m - 1 :]
                    for j, x in enumerate(parts):
                        hit &= h[j : len(h) - m + 1 + j] == x
                    at = np.flatnonzero(hit)
                    np.add.at(n_base, of[at], 1)
                    np.minimum.at(low, of[at], at - from_word[of[at]])
                    np.maximum.at(high, of[at], at - from_word[of[at]])
                    for i in set(of[at].tolist()):
                        labels[i].add(label)
                base = [",".join(sorted(x)) for x in labels]
                covered, matches, upto = np.zeros(rows, np.int64), [[] for _ in range(rows)], {}
                reach = np.zeros(rows, np.int64)  # words up to here are covered already
                place = np.minimum(np.searchsorted(first_hashes, h), max(0, len(first_hashes) - 1))
                for i in np.flatnonzero(first_hashes[place] == h).tolist() if len(first_hashes) else ():
                    r = int(of[i])
                    word = lambda j, i=i: data[start[i + j] : stop[i + j]].tobytes()
                    for a in starts_with.get(word(0), ()):
                        if i >= upto.get((r, a.label), 0) and (n := a.longest(word, int(from_word[r + 1]) - i)):
                            upto[r, a.label] = i + n
                            labels[r].add(a.label)
                            matches[r].append((a.label, i - int(from_word[r]), n))
                            covered[r] += max(0, i + n - max(i, int(reach[r])))
                            reach[r] = max(reach[r], i + n)
                yield pa.record_batch(
                    [
                        ids.slice(row, rows),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(low, pa.int64(), mask=n_base == 0),
                        pa.array(high, pa.int64(), mask=n_base == 0),
                        pa.array(base, pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array(covered / np.maximum(1, n_words), pa.float64()),
                        pa.array([[{"label": k, "word": w, "n": n} for k, w, n in x] for x in matches], match),
                    ],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n", pa.int64())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, word: long, n: long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
