"""Small helpers of the operators: settings, shared files, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.plans.runtime import configure, discard, materialized, scratch_folder

__all__ = ["configure", "discard", "map_rows", "materialized", "new_folder", "open_store", "release", "slices_of", "table"]

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of a fresh folder in the shared scratch space, as a URI that executors can open.

    A path without a scheme is on Spark's default file system, as Spark itself takes it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/simloom-{kind}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def open_store(uri: str):
    """``(file system, path)`` of a shared folder, for tasks that read or write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``rows`` rows, cut where their texts exceed ``SLICE_BYTES``; a longer text is a slice of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        full = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
        stop = min(max(full, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def release() -> None:
    """Give freed memory back at the end of a task: workers are used again, and would keep the most that any task before took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(
    df: DataFrame,
    work: Callable[[Iterator[list[tuple]]], Iterable[dict]],
    schema: str,
    rows: int = 256,
) -> DataFrame:
    """Run ``work`` in every task over slices of at most ``rows`` rows and about ``SLICE_BYTES``; it yields dicts of columns.

    Slices keep a task's memory bounded by about a megabyte of text, or by one row where a text is longer, whatever the partition holds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for batch in batches:
                for part in slices_of(batch, rows):
                    yield list(zip(*[column.to_pylist() for column in part.columns]))

        for columns in work(slices()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[field.name], type=field.type) for field in target], schema=target
            )
        release()

    return df.mapInArrow(run, schema)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
