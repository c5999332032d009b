"""Scans of stored tables: what would be masked, reports, pages and writing back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..frames import free_prefix
from ..functions.maskers import excerpt
from ..functions.text import has_consent
from ..functions.validators import any_of
from ..operators.masking import Hooks, confidence, detections, mask_text
from ..rules import Rule, registry

PAGE_LIMIT = 100
TEXT_LIMIT = 10_000
#: Partition values that are sent to all tasks at most.
PARTITIONS = 100_000
POST_STATUSES = ("publish", "pending", "draft", "future", "private")


def types_of(found: Column) -> Column:
    """Distinct types of detections in order of finding, URLs left out."""
    return F.array_distinct(F.transform(F.filter(found, lambda d: d["type"] != "url"), lambda d: d["type"]))


def examine(df: DataFrame, fields: list[str], settings: Settings | None = None, hooks: Hooks | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Adds masked forms of text columns and what was found in them.

    ``<field>_masked`` for each field, ``detected_types`` over all fields in order of finding,
    ``would_change`` and ``consent_bypassed``. A field with a consent phrase stays, what it holds is
    reported all the same. Null fields count as empty.
    """
    settings = settings or Settings()
    texts = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}
    at = free_prefix(df)
    seen = f"{at}found"
    found = F.array(*[types_of(detections(t, settings, rules)) for t in texts.values()])
    # A row of its own for what was found keeps Spark from finding it again in each filter.
    df = df.select("*", F.explode(F.array(found)).alias(seen))
    # Without hooks, only a text in which something was found can change; URLs count where a rule masks them.
    always = hooks or settings.customs or rules is not None or any(r.type == "url" for r in registry())
    can_change = lambda i: F.lit(True) if always else F.size(F.get(seen, F.lit(i))) > 0
    df = df.withColumns({f"{f}_masked": F.when(can_change(i), t) for i, (f, t) in enumerate(texts.items())})
    df = mask_text(df, [f"{f}_masked" for f in fields], settings, hooks, consent=True)
    df = df.withColumns({f"{f}_masked": F.coalesce(f"{f}_masked", t) for f, t in texts.items()})
    return df.withColumns(
        {
            "detected_types": F.array_distinct(F.flatten(seen)),
            "would_change": any_of([F.col(f"{f}_masked") != t for f, t in texts.items()]),
            "consent_bypassed": any_of([has_consent(t, settings.consent_phrases) for t in texts.values()]),
        }
    ).drop(seen)


def status(item: Column | None = None, applied: Column | None = None, applying: bool = False) -> Column:
    """A row's outcome from its flags: masked, consent-skipped, would-mask (update-failed), detected-only."""
    applied = F.lit(False) if applied is None else applied
    return (
        F.when(applied, "masked")
        .when(F.col("consent_bypassed"), "consent-skipped")
        .when(F.col("would_change"), "update-failed" if applying else "would-mask")
        .otherwise("detected-only")
    )


def report(df: DataFrame, target: str, id_col: str, fields: list[str], label: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """One row for each item that has detections or would change: target, id, types, status, excerpt, flags."""
    seen = examine(df, fields, settings).filter((F.size("detected_types") > 0) | F.col("would_change"))
    return seen.select(
        F.lit(target).alias("target"),
        F.col(id_col).cast("long").alias("id"),
        "detected_types",
        F.array_join("detected_types", ",").alias("types"),
        status().alias("status"),
        excerpt(F.coalesce(F.col(fields[0]) if label is None else label, F.lit(""))).alias("excerpt"),
        "would_change",
        "consent_bypassed",
    )


def report_all(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def scannable_posts(posts: DataFrame, kind: str) -> DataFrame:
    return posts.where((F.col("type") == kind) & F.col("status").isin(*POST_STATUSES))


def targets(requested: str, post_types: list[str]) -> list[str]:
    """The targets of a scan: ``all``, or names separated by commas."""
    if requested == "all":
        return ["comments", "images", *post_types]
    names = [t for t in map(str.strip, requested.split(",")) if t]
    if unknown := set(names) - {"comments", "images", *post_types}:
        raise ValueError(f"unknown scan target: {sorted(unknown)[0]}")
    return names


def page(df: DataFrame, id_col: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by id, with the next page's offset where this one is full."""
    if offset < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"offset from 0, limit from 1 to {PAGE_LIMIT}")
    return df.orderBy(id_col).offset(offset).limit(limit)


def next_offset(offset: int, limit: int, rows: int) -> int | None:
    return offset + rows if rows == limit else None


def count_items(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each target."""
    return report_all([df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(t).alias("target"), "items") for t, df in tables.items()])


def mask_result(df: DataFrame, column: str, settings: Settings | None = None, keep_long: bool = False) -> DataFrame:
    """For texts of up to 10,000 characters: masked, changed, detected_types, consent_bypassed, masking_enabled.

    A null text counts as empty. With ``keep_long`` longer texts are rows too: ``error`` says why, and the
    other results are null.
    """
    settings = settings or Settings()
    long_ = F.coalesce(F.length(column), F.lit(0)) > TEXT_LIMIT
    if keep_long:
        done = mask_result(df, column, settings).withColumn("error", F.lit(None).cast("string"))
        return done.unionByName(df.where(long_).withColumn("error", F.lit(f"Text is limited to {TEXT_LIMIT} characters.")), allowMissingColumns=True)
    seen = examine(df.where(~long_), [column], settings)
    enabled = any(settings.masked(t) for t in ("email", "phone", "card", "ssn", "ip", "token", "password", "contact", "address"))
    return seen.withColumnsRenamed({f"{column}_masked": "masked", "would_change": "changed"}).withColumn("masking_enabled", F.lit(enabled))


def preview_text(df: DataFrame, column: str, settings: Settings | None = None) -> DataFrame:
    """Adds ``preview``: each distinct detection with its confidence and whether its type is on and its value went."""
    settings = settings or Settings()
    df = df.withColumn("masked", F.col(column))
    df = mask_text(df, "masked", settings).withColumn("found", F.array_distinct(detections(F.col(column), settings)))
    off = [t for t in settings.masks if not settings.masked(t)] + [t for t in ("name_text",) if not settings.masked(t)]
    one = lambda d: F.struct(
        d["type"].alias("type"),
        d["value"].alias("value"),
        d["provider"].alias("provider"),
        confidence(d["type"]).alias("confidence"),
        (~d["type"].isin(*off) if off else F.lit(True)).alias("enabled"),
        (d["type"] != "url").alias("maskable"),
        (~F.contains(F.col("masked"), d["value"])).alias("was_masked"),
    )
    return df.withColumn("preview", F.transform("found", one)).drop("found")


def apply(df: DataFrame, fields: list[str], path: str, settings: Settings | None = None) -> DataFrame:
    """Write the table with its masked columns to a new path and return it; rows without changes stay as they are."""
    seen = examine(df, fields, settings)
    for f in fields:
        seen = seen.withColumn(f, F.when(F.coalesce(F.col(f), F.lit("")) != F.col(f"{f}_masked"), F.col(f"{f}_masked")).otherwise(F.col(f)))
    seen.select(df.columns).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def changes(df: DataFrame, id_col: str, fields: list[str], settings: Settings | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The change table: id, a hash of the fields as they are, their masked forms, and ``keep``; only rows that change.

    Rows that repeat an id are told apart by what their fields hold; equal rows change alike and are one row here.
    """
    seen = examine(df, fields, settings).filter("would_change")
    return seen.select(F.col(id_col).alias("id"), F.xxhash64(*fields).alias("was"), *keep, *[F.col(f"{f}_masked").alias(f) for f in fields]).dropDuplicates(["id", "was", *keep])


def apply_partitions(spark: SparkSession, path: str, id_col: str, fields: list[str], partition_col: str, work: str, settings: Settings | None = None) -> DataFrame:
    """Mask a partitioned Parquet table in place and return the change table; partitions without changes keep their files.

    The changes are written under ``work``, then the partitions that they touch, and only these replace the
    table's: a failure on the way leaves either old or new partitions, and running it again finishes the rest, as masked
    texts no longer change. Nulls stay null unless masking made a text of them.
    """
    table = spark.read.parquet(path)
    found = changes(table, id_col, fields, settings, (partition_col,))
    found.write.parquet(f"{work}/changes")
    found = spark.read.parquet(f"{work}/changes")
    at = free_prefix(table)
    touched = found.select(F.col(partition_col).alias(f"{at}part")).distinct()
    # As many rows as partitions: the readers skip the others' files.
    rows = table.join(F.broadcast(touched) if touched.count() <= PARTITIONS else touched, F.col(partition_col).eqNullSafe(F.col(f"{at}part")), "left_semi")
    side = found.select(F.col("id").alias(f"{at}id"), F.col("was").alias(f"{at}was"), F.col(partition_col).alias(f"{at}part"), F.struct(*fields).alias(f"{at}new"))
    same = F.col(id_col).eqNullSafe(F.col(f"{at}id")) & (F.xxhash64(*fields) == F.col(f"{at}was")) & F.col(partition_col).eqNullSafe(F.col(f"{at}part"))
    new = lambda f: F.when(F.col(f"{at}new").isNull() | (F.col(f).isNull() & (F.col(f"{at}new")[f] == "")), F.col(f)).otherwise(F.col(f"{at}new")[f])
    rows.join(side, same, "left").withColumns({f: new(f) for f in fields}).select(table.columns).write.partitionBy(partition_col).parquet(f"{work}/partitions")
    if not touched.isEmpty():
        spark.read.schema(table.schema).parquet(f"{work}/partitions").select(table.columns).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition_col).parquet(path)
    return found


def page_by_key(df: DataFrame, target: str, id_col: str, fields: list[str], after: int | None = None, offset: int = 0, limit: int = 50, label: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """One page of a scan as one row: target, processed, next_offset, next_after, items.

    The page is the ``limit`` rows with the smallest ids above ``after``, which readers find by their files'
    statistics and no sort of the table; ``offset`` only counts on. ``items`` has id, masked label,
    detected_types, would_change and consent_bypassed of those that the report would list; labels are excerpts with what they hold masked. Where the page
    is full, ``next_after`` and ``next_offset`` begin the next one. Ids must be distinct; null ids come on no page.
    """
    if offset < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"offset from 0, limit from 1 to {PAGE_LIMIT}")
    left = df.filter(F.col(id_col).isNotNull() if after is None else F.col(id_col) > after)
    rows = left.orderBy(id_col).limit(limit)
    seen = examine(rows, fields, settings).withColumn("label", F.coalesce(F.col(fields[0]) if label is None else label, F.lit("")))
    seen = mask_text(seen.withColumn("label", excerpt(F.col("label"))), "label", settings, html=False)  # an excerpt has no tags
    item = F.struct(F.col(id_col).cast("long").alias("id"), "label", "detected_types", "would_change", "consent_bypassed")
    listed = F.when((F.size("detected_types") > 0) | F.col("would_change"), item)
    out = seen.agg(F.count(F.lit(1)).alias("processed"), F.max(F.col(id_col).cast("long")).alias("last"), F.array_sort(F.collect_list(listed)).alias("items"))
    full = F.col("processed") == limit
    return out.select(F.lit(target).alias("target"), "processed", F.when(full, F.col("processed") + offset).alias("next_offset"), F.when(full, F.col("last")).alias("next_after"), "items")


def write_report(rows: DataFrame, path: str, form: str = "json") -> int | None:
    """A report as JSON or CSV files, or just its number of rows."""
    if form == "count":
        return rows.count()
    flat = rows.select("target", "id", "types", "status", "excerpt")
    (flat.write.csv(path, header=True) if form == "csv" else flat.write.json(path))
    return None
