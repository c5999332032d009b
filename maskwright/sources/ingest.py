"""Tables that are masked when rows come in: which columns, of which rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings, load, migrate
from ..frames import free_prefix
from ..functions.maskers import anonymize_ip
from ..operators.masking import mask_text, mask_texts


@dataclass(frozen=True)
class TableSpec:
    """Text columns of a kind of table."""

    name: str
    columns: tuple[str, ...]


SPECS = {
    s.name: s
    for s in (
        TableSpec("comments", ("content", "author", "author_url")),
        TableSpec("activity", ("content",)),
        TableSpec("profile_fields", ("value",)),
        TableSpec("messages", ("subject", "content")),
        TableSpec("groups", ("description",)),
        TableSpec("topics", ("title", "content")),
        TableSpec("replies", ("content",)),
        TableSpec("forums", ("content",)),
        TableSpec("board_topics", ("title", "body")),
        TableSpec("board_posts", ("body",)),
        TableSpec("board_profiles", ("signature", "about", "occupation", "location")),
        TableSpec("board_messages", ("title", "body")),
        TableSpec("users", ("display_name", "nickname", "description")),
    )
}


def register_table(spec: TableSpec) -> None:
    SPECS[spec.name] = spec


@dataclass(frozen=True)
class Integration:
    """Tables that are masked together, if they are there and the setting ``integration_<name>`` is on.

    ``available`` says of the tables at hand, by name, whether what they belong to is there; without it, every table of the
    integration has to be there with one of its text columns at least.
    """

    name: str
    tables: tuple[str, ...]
    available: Callable[[dict[str, DataFrame]], bool] | None = None

    def is_available(self, tables: dict[str, DataFrame]) -> bool:
        if self.available:
            return bool(self.available(tables))
        return all(t in tables and t in SPECS and set(SPECS[t].columns) & set(tables[t].columns) for t in self.tables)


INTEGRATIONS = (
    Integration("wpforo", ("board_topics", "board_posts")),
    Integration("buddypress", ("activity", "messages")),
    Integration("bbpress", ("topics", "replies")),
    Integration("comments", ("comments",)),
    Integration("users", ("users",)),
)


def active_integrations(tables: dict[str, DataFrame], settings: dict, integrations: tuple[Integration, ...] = INTEGRATIONS) -> list[Integration]:
    """Integrations that are on and whose tables are there; none while ``enable_masking`` is off."""
    if not settings.get("enable_masking"):
        return []
    return [i for i in integrations if settings.get(f"integration_{i.name}") and i.is_available(tables)]


def mask_tables(tables: dict[str, DataFrame], settings: dict, integrations: tuple[Integration, ...] = INTEGRATIONS) -> dict[str, DataFrame]:
    """All tables; those of active integrations masked, the others as they are. ``settings`` is the stored flat map."""
    on = {t for i in active_integrations(tables, migrate(settings), integrations) for t in i.tables}
    chosen = load(settings)
    mask = lambda name, df: mask_comments(df, chosen) if name == "comments" else mask_table(df, name, chosen)
    return {name: mask(name, df) if name in on else df for name, df in tables.items()}


def comment_group(kind: Column) -> Column:
    """The group that a comment's type belongs to; an empty type is a comment."""
    kind = F.coalesce(F.when(kind == "", None).otherwise(kind), F.lit("comment"))
    return F.when(kind.isin("comment", "review", "note"), kind).otherwise("other")


def mask_table(df: DataFrame, spec: TableSpec | str, settings: Settings | None = None, only: Column | None = None) -> DataFrame:
    """Mask a table's text columns, in rows where ``only`` holds; texts with a consent phrase stay."""
    spec = SPECS[spec] if isinstance(spec, str) else spec
    columns, at = [c for c in spec.columns if c in df.columns], free_prefix(df)
    out = mask_text(df.withColumns({f"{at}kept_{c}": F.col(c) for c in columns}), columns, settings, consent=True)
    if only is not None:
        out = out.withColumns({c: F.when(only, F.col(c)).otherwise(F.col(f"{at}kept_{c}")) for c in columns})
    return out.select(df.columns)


def mask_comments(df: DataFrame, settings: Settings | None = None, anonymize: bool = False) -> DataFrame:
    """New comments: content, author and author's URL, if the type's group is on; the address too where asked for."""
    settings = settings or Settings()
    on = [g for g, yes in settings.comment_groups.items() if yes]
    df = mask_table(df, "comments", settings, comment_group(F.col("type")).isin(*on) if on else F.lit(False))
    return df.withColumn("author_ip", anonymize_ip(F.col("author_ip"))) if anonymize else df


def mask_edits(edits: DataFrame, stored: DataFrame, key: str, spec: TableSpec | str, settings: Settings | None = None) -> DataFrame:
    """Edited rows: only columns that differ from the stored row are masked. Rows that aren't stored are new in all columns.

    Of stored rows that share a key the smallest by its columns counts, so that no edit becomes several rows.
    """
    spec = SPECS[spec] if isinstance(spec, str) else spec
    columns, at = [c for c in spec.columns if c in edits.columns], free_prefix(edits)
    old = stored.groupBy(F.col(key).alias(f"{at}key")).agg(F.min(F.struct(*columns)).alias(f"{at}was"))
    both = edits.join(old, F.col(key) == F.col(f"{at}key"), "left")
    both = mask_text(both.withColumns({f"{at}new_{c}": F.col(c) for c in columns}), columns, settings, consent=True)
    kept = {c: F.when(F.col(f"{at}was").isNotNull() & F.col(f"{at}new_{c}").eqNullSafe(F.col(f"{at}was")[c]), F.col(f"{at}new_{c}")).otherwise(F.col(c)) for c in columns}
    both = both.withColumns(kept)
    return both.select(edits.columns)


def mask_form(fields: DataFrame, types: DataFrame, settings: Settings | None = None, maskable: tuple[str, ...] = ("textarea",), before: Callable[[Column], Column] | None = None, after: Callable[[Column], Column] | None = None) -> DataFrame:
    """Form fields ``form_id, name, values``: values of free-text fields by their type, but for names with ``_`` in front.

    ``types`` has ``form_id, name, basetype``; of repeated ones the first by name counts. Values are an array;
    each is masked alone, nulls stay. Rows that repeat a form and name are rows of their own, and other columns
    stay. ``before`` and ``after`` change the whole array ahead of and behind masking.
    """
    kinds = types.groupBy(F.col("form_id").alias("__form"), F.col("name").alias("__name")).agg(F.min("basetype").alias("__kind"))
    known = fields.join(kinds, (F.col("form_id") == F.col("__form")) & (F.col("name") == F.col("__name")), "left")
    if before:
        known = known.withColumn("values", before(F.col("values")))
    out = mask_texts(known, "values", settings, F.col("__kind").isin(*maskable) & ~F.col("name").startswith("_"))
    if after:
        out = out.withColumn("values", after(F.col("values")))
    return out.select(fields.columns)


def image_files(spark, path: str, limit: int = 100 << 20) -> DataFrame:
    """Image files under a path. Those above ``limit`` bytes are not read: their ``content`` is null and ``too_large`` is true."""
    files = spark.read.format("binaryFile").load(path)
    read = files.where(F.col("length") <= limit).withColumn("too_large", F.lit(False))
    unread = files.where(F.col("length") > limit).select(*[F.lit(None).cast("binary").alias(c) if c == "content" else F.col(c) for c in files.columns], F.lit(True).alias("too_large"))
    return read.unionByName(unread)
