"""Custom patterns from the dialect that they are written in to the one that Spark runs."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .bounded import bounded
from .patterns import java

#: Constructs without a counterpart: recursion, calls of groups, branch resets, conditions, verbs, \\K, callouts.
_ABSENT = re.compile(r"\(\?(?:R|[+-]?\d+\)|&|P>|\||\(|C)|\(\*[A-Z]")
_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s", "blank": r"\h", "punct": r"\p{IsPunctuation}", "xdigit": "0-9A-Fa-f", "word": r"\w", "cntrl": r"\p{Cntrl}"}
_PART = re.compile(
    r"""(?sx)
    \\Q.*?(?:\\E|$)                                   # quoted
    | \\g\{?(?P<number>-?\d+)\}? | \\[gk][{<'](?P<back>\w+)[}>']  # references
    | (?P<escape>\\.)
    | (?P<set>\[\^?\]?(?:\[:\^?[a-z]+:\]|\\.|[^\]\\])*\])
    | \(\?(?:P?<|')(?P<name>[A-Za-z_]\w*)[>'] | \(\?P=(?P<named>\w+)\)
    | (?P<other>.)
    """
)


def _group(name: str) -> str:
    """A group's name in letters and digits; underscores become a sequence that keeps names apart."""
    return "g" + name.replace("x", "xx").replace("_", "xu")


def _set(text: str) -> str:
    """A character class: names of classes, and signs that would nest or cut classes."""
    head = re.match(r"\[\^?\]?", text)[0]
    body, out = text[len(head) : -1], head.replace("]", r"\]")
    for part in re.finditer(r"(?s)\[:(\^?)([a-z]+):\]|\\.|&&|.", body):
        if part[2]:
            if part[2] not in _POSIX or part[1]:
                raise ValueError(text)
            out += _POSIX[part[2]]
        else:
            out += {"[": r"\[", "&&": r"&\&"}.get(part[0], part[0])
    return out + "]"


def translated(pattern: str) -> str | None:
    """Java form of a custom pattern with its repetitions bounded; None where it has none."""
    made = unbounded(pattern)
    return made and bounded(made)[0]


@lru_cache(512)
def unbounded(pattern: str) -> str | None:
    """Java form of a custom pattern, with its Unicode classes; None where it has none.

    Named groups may be written in any of their ways; a reference to a group by a relative number is made absolute.
    Whether the form compiles is for the engine to say (``compiles``).
    """
    if _ABSENT.search(re.sub(r"(?s)\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", " ", pattern)) or re.search(r"(?<!\\)(?:\\\\)*\\(?:K|C|o\{|N\{)", pattern):
        return None
    out, groups, names = "", 0, set()
    try:
        for m in _PART.finditer(pattern):
            if m["number"]:
                n = int(m["number"])
                out += rf"\{n if n > 0 else groups + 1 + n}(?:)"
            elif m["back"] or m["named"]:
                out += rf"\k<{_group(m['back'] or m['named'])}>"
            elif m["set"]:
                out += _set(m["set"])
            elif m["name"]:
                groups += 1
                if m["name"] in names:
                    return None
                names.add(m["name"])
                out += f"(?<{_group(m['name'])}>"
            else:
                groups += m[0] == "(" and pattern[m.end() : m.end() + 1] != "?"
                out += m[0]
    except ValueError:
        return None
    return java(out, "u")


def overruns(pattern: str) -> tuple[str, ...]:
    """Patterns of texts that a custom pattern leaves alone, as a repetition could exhaust a stack on them."""
    made = unbounded(pattern)
    return tuple(java("", "u") + x for x in bounded(made)[1]) if made else ()


@lru_cache(512)
def compiles(pattern: str) -> bool:
    """Whether Spark's engine takes the pattern; asked of the session, which folds it before any job."""
    try:
        SparkSession.active().range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True
