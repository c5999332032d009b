"""Names for working columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def free_prefix(df: DataFrame) -> str:
    """A beginning that no column of the frame has, so that working columns never meet given ones."""
    taken, prefix = [c.lower() for c in df.columns], "__mw_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix


#: Tasks for each core of the cluster, and in all at least, that spread rows go to.
TASKS_A_CORE, LEAST_TASKS = 4, 32


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to a few tasks a core. One task reads a whole row group of a file, and a narrow table of a million rows may be no more."""
    return df.repartition(max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS), key)


#: Bytes of a function up to which HotSpot compiles it.
COMPILED_BYTES = "8000"


def small_functions(spark: SparkSession) -> None:
    """Long expressions are generated as many functions, not as one of a whole stage that the JVM only interprets. A limit that someone set stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":
        spark.conf.set(limit, COMPILED_BYTES)
