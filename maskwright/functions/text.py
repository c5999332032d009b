"""Normalisation of text and consent, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P

_WIDE = {"　": " "} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0) not in P.FULL_WIDTH_KEPT}


def fold_width(text: Column) -> Column:
    """Full-width letters, digits and signs as ASCII, but for those with a meaning in HTML."""
    return F.translate(text, "".join(_WIDE), "".join(_WIDE.values()))


def normalize(text: Column) -> Column:
    """Width folded, and dashes of all kinds between letters or digits as ``-``; the length stays."""
    folded = F.regexp_replace(fold_width(text), f"(?<=[0-9A-Za-z])[{P.DASHES}](?=[0-9A-Za-z])", "-")
    # ASCII texts, most of the rest too, have nothing to fold.
    return F.when((F.length(text) != F.octet_length(text)) & text.rlike(f"[　！-～{P.DASHES}]"), folded).otherwise(text)


def has_consent(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in the text as written, in any case."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.lower(text).contains(phrase.lower())
    return F.coalesce(out, F.lit(False))


#: Stands for a match; no character of any text, or else the text is split in the slow way.
_MARK = "\uffff"


def split_at(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches. Spark compiles a split's pattern anew for each text, a replacement's once."""
    return F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1))
