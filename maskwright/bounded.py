"""Patterns that can't exhaust a thread's stack.

A group that is repeated and whose own length or branches vary is matched by recursion, one level for each
repetition. Such repetitions are bounded here; ``overruns`` are patterns of the texts on which a bound cuts a
match short.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Repetitions of a group that are matched; nested ones share them.
REPEATS = 150
_TOKEN = re.compile(r"(?s)\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\[:[a-z^]+:\]|\\.|[^\]\\])*\]|\(\?[imsxuUdJ-]+\)|\(|\)|\||[^\\\[()|]")
_QUANTIFIER = re.compile(r"(?:\*|\+|\?|\{(\d+)(,?)(\d*)\})([+?]?)")


@lru_cache(512)
def bounded(pattern: str) -> tuple[str, tuple[str, ...]]:
    """(pattern with bounds, patterns of overruns); without such groups the pattern itself and none."""
    return _bound(pattern, REPEATS)


def _bound(pattern: str, repeats: int) -> tuple[str, tuple[str, ...]]:
    out, overruns, at, starts, varies = "", [], 0, [], [False]
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        piece = token[0] if token else pattern[at]
        at += len(piece)
        if piece == "(":
            starts.append(len(out))
            varies.append(False)
        elif piece == "|":
            varies[-1] = True
        quantified = None if piece in ("(", "|") else _QUANTIFIER.match(pattern, at)
        if piece == ")" and starts:
            start, own = starts.pop(), varies.pop()
            group = out[start:] + ")"
            varies[-1] |= own
            if quantified and own:
                low, high = _limits(quantified)
                if quantified[4] != "+" and (high is None or high > repeats):
                    inner, more = _bound(group[1:-1], max(2, repeats // 10))
                    group = "(" + inner + ")"
                    overruns += [*more, group + "{" + str(max(low, repeats)) + "}"]
                    out = out[:start] + group + "{" + f"{low},{max(low, repeats)}" + "}" + quantified[4]
                    at = quantified.end()
                    varies[-1] = True
                    continue
        out += piece
        if quantified:
            at = quantified.end()
            out += quantified[0]
            low, high = _limits(quantified)
            varies[-1] |= low != high and quantified[4] != "+"
    return out, tuple(overruns)


def _limits(quantifier: re.Match) -> tuple[int, int | None]:
    if quantifier[0][0] in "*+?":
        return {"*": (0, None), "+": (1, None), "?": (0, 1)}[quantifier[0][0]]
    low = int(quantifier[1])
    return low, (int(quantifier[3]) if quantifier[3] else None) if quantifier[2] else low

