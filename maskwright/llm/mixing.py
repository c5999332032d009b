"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents are sampled in so many hash buckets; only the bucket on the edge is ordered row by row.
BUCKETS = 1024


def size_of(text_col: str):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(keys: DataFrame, order: list, out: str) -> DataFrame:
    """Position of each row in the whole order, without one task for all: range partitions, then offsets."""
    parts = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one number for each partition
    before, start = 0, []
    for p in sorted(counts):
        start.append((p, before))
        before += counts[p]
    starts = keys.sparkSession.createDataFrame(start, "_part int, _before long")
    return parts.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1).drop("_part", "_at", "_before")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Targets for rows ``source, size, weight``: shares of the total by weight, at most ``max_epochs`` times the size.

    Each round clamps every source above its maximum and shares what is left among the others by weight,
    until none is above. Only three sums come to the driver in a round.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = None
    clamped = F.lit(False)
    seen = -1
    while True:
        cap = F.col("size") * F.lit(float(max_epochs))
        fixed, weight, n = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight").cast("double"))), F.count(F.when(clamped, 1))
        ).first()
        if n == seen or not weight:
            break
        level, seen = max(total - fixed, 0.0) / weight, n
        clamped = F.col("weight") * F.lit(level) > cap
    target = F.least(F.col("weight") * F.lit(level), F.col("size") * F.lit(float(max_epochs))) if level is not None else F.lit(0.0)
    return sources.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken, so that sources come to their target sizes.

    Sources in code-point order (null last) get ``weights`` in turn. A document's size is its number of
    words; a null or empty text has size 0 and is taken with 0 words. A source with repetition r is taken
    floor(r) times whole; the rest is a seeded sample of its documents, in the order of a seeded hash of
    the id, up to the fraction of its size. Ties in the hash (also repeated ids) are ordered by size, and
    equal rows share one decision as a block. Reruns agree. An empty table gives no rows; texts of any length
    are counted whole; other columns are not read.

    Returns for each row ``<id_col>, <source_col>, size, source_size, target, repeats, taken``.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size")), "sizes")
    u = F.xxhash64(F.lit(seed), F.col("id"))
    rows = rows.withColumn("hash", u).withColumn("bucket", F.pmod(F.shiftrightunsigned(u, 20), F.lit(BUCKETS)).cast("int"))
    buckets = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    sums = buckets.groupBy("source").agg(F.sum("size").alias("size"))
    order = [F.col("source").isNull(), F.col("source")]
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(water_fill(stored(ranked(sums, order, "rank").withColumn("weight", cycle), "weights"), max_epochs), "targets")
    rate = sources.select(
        F.col("source").alias("s"),
        F.col("size").alias("source_size"),
        "target",
        F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(float(max_epochs)))).otherwise(0.0).alias("rate"),
    )
    same = F.col("source").eqNullSafe(F.col("s"))
    # Where in the order of hash buckets each source's fraction ends.
    edge = (
        buckets.join(rate, same)
        .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        .withColumn("want", (F.col("rate") - F.floor("rate")) * F.col("source_size"))
        .groupBy("source", "rate", "source_size", "target", "want")
        .agg(
            F.coalesce(F.min(F.when(F.col("upto") > F.col("want"), F.col("bucket"))), F.lit(BUCKETS)).alias("edge"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("want"), F.col("upto"))), F.lit(0)).alias("before"),
        )
        .withColumnRenamed("source", "s")
    )
    edge = stored(edge, "edges")
    joined = rows.join(hinted(edge, edge.count(), 200), same)
    inside = joined.filter("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("int"))
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("hash", "id", "size")) + F.col("before")
    # The next document is taken too if that comes nearer to the wanted size.
    on_edge = joined.filter("bucket = edge").withColumn("extra", (so_far - F.col("size") / 2 <= F.col("want")).cast("int"))
    out = inside.unionByName(on_edge)
    # A source at its cap is taken whole so many times and no more; its empty texts lie at any edge.
    repeats = F.least(F.floor("rate") + F.col("extra"), F.lit(max_epochs)).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
