"""The same masking on streams of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import images
from ..plans.scan import report
from ..sources.ingest import TableSpec, mask_table


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def mask_stream(rows: DataFrame, spec: TableSpec | str, settings: Settings | None = None) -> DataFrame:
    """Masked rows of a stream; every row stands alone, so there is no state and no watermark."""
    return mask_table(rows, spec, settings)


def write_masked(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    out = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def report_stream(rows: DataFrame, target: str, id_col: str, fields: list[str], path: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """A scan report of each batch, appended to a table of reports; a batch that is run again writes its own folder again."""

    def one(batch: DataFrame, number: int) -> None:
        report(batch, target, id_col, fields, settings=settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What Spark gives for each file.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, path: str, limit: int = 100 << 20) -> DataFrame:
    """Files that arrive under a path; the content of those above ``limit`` bytes is null and ``too_large`` is true."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)
    large = F.col("length") > limit
    return files.withColumns({"too_large": large, "content": F.when(~large, F.col("content"))})


def scrub_stream(rows: DataFrame, path: str, checkpoint: str, content: str = "content", settings: Settings | None = None, allow: Column | None = None) -> StreamingQuery:
    """Scrub the images of a stream as they come in, and append them with their ``result`` to a table.

    Rows are independent, so there is no state. A batch that is run again after a failure writes its own folder again. Null
    contents have failed; what ``allow`` refuses comes through as it is.
    """

    def one(batch: DataFrame, number: int) -> None:
        images.scrub(batch, content, settings, allow=allow).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_statuses(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """``<key>, status``: the worst that a key's images got when they came in; for ``images.carried_status``."""
    return images.status_of(spark.read.parquet(path), key)
