"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, scratch_root, settle, visible_to_workers

__all__ = ["drop_settled", "id_hash", "per_slice", "read", "scratch", "settle", "slices", "text_or_empty", "tidy", "trim"]

#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 1_500_000


#: Rows that go to Python at once: whole texts are long, and both sides hold a batch.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Sends at most BATCH_ROWS rows at once to Python, unless the session has its own setting."""
    if int(spark.conf.get(_ROWS)) == 10_000:  # Spark's default
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(visible_to_workers(spark)).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def drop_settled(df: DataFrame) -> None:
    """Deletes what settle() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not name.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            continue
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_hash(col: str) -> Column:
    """crc32 of the id as text, which the folds are made of."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_or_empty(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about limit bytes of text each; a longer text stands alone. Texts become Python's a part at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                part = batch.slice(start, i - start)
                yield part, text_or_empty(part.column(column))
                start, size = i, 0
            size += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, text_or_empty(part.column(column))


def trim() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn for mapInArrow, with trim() after each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def per_slice(fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES, after: Callable[[], None] | None = None):
    """A function for mapInArrow that applies fn to each slice; after, if there is one, ends each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column, limit):
            out = fn(batch, texts)
            if out is not None and out.num_rows:
                yield out
        if after is not None:
            after()

    return tidy(run)
