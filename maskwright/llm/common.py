"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables up to this many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Text handled at once by the array code inside a task; a longer single document stands alone.
SLICE_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows of long texts go to Python in small batches; every batch is held by the JVM and by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def forget_tokenizers() -> None:
    """Drop what earlier tasks in this worker remembered for encoding; for tasks that don't encode."""
    known = sys.modules.get(f"{__package__}.tokens")
    if known:
        known.encoder.cache_clear()
        release()


def release() -> None:
    """Give memory that a task no longer uses back to the machine; Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster must set it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="maskwright-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave. Everything made from them must have been written before."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a counted side as small enough to broadcast; beyond the bound it is left to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a text column: (first row, end row, bytes, offsets); nulls are empty.

    Bytes is one array for all rows of the part, offsets has one entry more than rows.
    """
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
