"""Original characters for what masking left alone in a width-folded text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """Shortest edits from a to b as (op, place in a, place in b); op is ``=``, ``-`` or ``+``.

    Of several shortest scripts, the one in which the furthest point of a diagonal (place in a less place
    in b) comes by an insertion if the diagonal above reached further than the one below, else by a
    deletion. Each point links to the steps that led to it, so that diagonals share what they have in common.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rest_a, rest_b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(rest_a), reversed(rest_b), strict=False)) if x != y), min(len(rest_a), len(rest_b)))
    rest_a, rest_b = rest_a[: len(rest_a) - tail], rest_b[: len(rest_b) - tail]
    goal, cost = len(rest_a) - len(rest_b), 0

    def along(place: int, diagonal: int, steps: tuple | None) -> tuple[int, tuple | None]:
        """From a place on as far as both agree."""
        upto = place
        while upto < len(rest_a) and upto - diagonal < len(rest_b) and rest_a[upto] == rest_b[upto - diagonal]:
            upto += 1
        return upto, (steps, "=", place, diagonal, upto - place) if upto > place else steps

    furthest = {0: along(0, 0, None)}
    while furthest.get(goal, (-1,))[0] < len(rest_a):
        cost += 1
        for diagonal in range(-cost, cost + 1, 2):
            above, below = furthest.get(diagonal + 1), furthest.get(diagonal - 1)
            if below is None or (above is not None and above[0] > below[0]):
                place, steps = above
                furthest[diagonal] = along(place, diagonal, (steps, "+", place, diagonal + 1, 1))
            else:
                place, steps = below
                furthest[diagonal] = along(place + 1, diagonal, (steps, "-", place, diagonal - 1, 1))
    runs, steps = [], furthest[goal][1]
    while steps:
        steps, *run = steps
        runs.append(run)
    middle = [(op, head + place + i, head + place + i - diagonal) for op, place, diagonal, n in reversed(runs) for i in range(n)]
    ends = [("=", len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    return [("=", i, i) for i in range(head)] + middle + ends


def _taken(old: list[str], new: list[str], out: list[str], between: Callable[..., str]) -> str:
    """``out`` with its stretches that equal ``new`` taken from ``old``; ``between`` makes those that differ.

    Items of ``old`` and ``new`` belong together by their places; where their numbers differ, ``out`` stays.
    """
    if len(old) != len(new):
        return "".join(out)
    parts = []
    for same, run in groupby(edit_script(new, out), key=lambda step: step[0] == "="):
        steps = list(run)
        gone, put = [i for op, i, _ in steps if op != "+"], [j for op, _, j in steps if op != "-"]
        kept = [old[i] for i in gone]
        parts.append("".join(kept) if same else between(kept, [new[i] for i in gone], [out[j] for j in put]))
    return "".join(parts)


def restored(original: str, normal: str, masked: str) -> str:
    """The masked text with original characters where it equals the folded one: whole lines, and characters of lines that differ."""
    lines = lambda text: re.findall(r"[^\n]*\n|[^\n]+", text)
    of_lines = lambda *stretches: _taken(*(list("".join(x)) for x in stretches), lambda old, new, out: "".join(out))
    return _taken(lines(original), lines(normal), lines(masked), of_lines)


@F.pandas_udf(T.StringType())
def restore_width(original: pd.Series, normal: pd.Series, masked: pd.Series) -> pd.Series:
    """Only for texts that folding and masking both changed; null for the others, which are passed as null."""
    return pd.Series([restored(o, n, m) if o is not None else None for o, n, m in zip(original, normal, masked, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def restore_widths(original: pd.Series, normal: pd.Series, masked: pd.Series) -> pd.Series:
    """The same for arrays of texts."""
    each = lambda o, n, m: [a if c == b else restored(a, b, c) for a, b, c in zip(o, n, m, strict=True)]
    return pd.Series([each(o, n, m) if o is not None else None for o, n, m in zip(original, normal, masked, strict=True)], dtype=object)


# Spark is not to move them into the expressions that use what they give.
restore_width = restore_width.asNondeterministic()
restore_widths = restore_widths.asNondeterministic()
