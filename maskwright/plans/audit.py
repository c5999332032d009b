"""What was masked, without what it was: audit rows, and metrics that a query gathers while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Settings
from ..frames import free_prefix
from ..functions.text import has_consent
from ..operators.masking import Hooks, detections, mask_text
from ..rules import registry


def _counts(text: Column, settings: Settings) -> Column:
    """Array of (type, n): how often each type is found in a text, in order of finding."""
    kinds = F.transform(detections(text, settings), lambda d: d["type"])
    return F.transform(F.array_distinct(kinds), lambda t: F.struct(t.alias("type"), F.size(F.filter(kinds, lambda x: x == t)).alias("n")))


def audit(df: DataFrame, id_col: str, fields: list[str], settings: Settings | None = None) -> DataFrame:
    """Rows ``id, field, type, n, action``: how often a type is in a field, and what became of it. Never a value.

    ``action`` is ``consent_bypass`` where the text holds a consent phrase, ``off`` where the type is not masked, ``url`` for
    addresses, which no rule masks, and ``masked`` otherwise. Null and empty texts give no rows; repeated ids stay apart.
    """
    settings = settings or Settings()
    kept = [r for r in {r.type for r in registry()} | {"custom"} if not (r == "custom" or settings.masked(r))]
    masked_urls = any(r.type == "url" for r in registry())

    def of(field: str) -> Column:
        return F.struct(F.lit(field).alias("field"), has_consent(F.col(field), settings.consent_phrases).alias("consent"), _counts(F.col(field), settings).alias("found"))

    each = df.select(F.col(id_col).alias("id"), F.explode(F.array(*map(of, fields))).alias("x"))
    rows = each.select("id", "x.field", "x.consent", F.inline("x.found"))
    action = F.when(F.col("type") == "url", "masked" if masked_urls else "url").when(F.col("type").isin(*kept) if kept else F.lit(False), "off").when(F.col("consent"), "consent_bypass").otherwise("masked")
    return rows.select("id", "field", "type", "n", action.alias("action"))


def mask_observed(df: DataFrame, columns: list[str], observation: Observation | str, settings: Settings | None = None, hooks: Hooks | None = None, consent: bool = True) -> DataFrame:
    """``mask_text`` with metrics on the way: ``rows``, ``changed``, ``consent_bypassed``, and ``found_<type>`` for each type.

    With an ``Observation`` they are there once an action has run; with a name, streams report them in their progress under it. The
    metrics come with the job itself: nothing is read twice and nothing but the sums reaches the driver.
    """
    settings, at = settings or Settings(), free_prefix(df)
    before = {f"{at}was_{i}": F.col(c) for i, c in enumerate(columns)}
    found = F.flatten(F.array(*[F.transform(detections(F.col(c), settings), lambda d: d["type"]) for c in columns]))
    out = mask_text(df.withColumns(before | {f"{at}found": found}), columns, settings, hooks, consent=consent)
    changed = [~F.col(c).eqNullSafe(F.col(w)) for c, w in zip(columns, before, strict=True)]
    held = [has_consent(F.col(w), settings.consent_phrases) for w in before]
    some = lambda flags: F.exists(F.array(*flags), lambda x: x)
    kinds = dict.fromkeys([*(r.type for r in registry()), "url", "custom"])
    count = lambda kind: F.size(F.filter(f"{at}found", lambda x: x == kind))
    out = out.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(some(changed), 1)).alias("changed"),
        F.count(F.when(some(held), 1)).alias("consent_bypassed"),
        *[F.coalesce(F.sum(count(k)), F.lit(0)).alias(f"found_{k}") for k in kinds],
    )
    return out.drop(*before, f"{at}found")
