"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime-settable only: a session handed in by the caller keeps its own cluster sizing.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Small inputs of costly Python stages still use all cores; large ones are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Batches for Python tasks end after some megabytes, not only after ten thousand rows of any length.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # A table dealt by some of the join keys is not dealt again (:func:`simloom.plans.pairs.with_ends`).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings the operators rely on."""
    for key, value in ADAPTIVE_CONF.items():
        spark.conf.set(key, value)
    return spark


def computed_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Keep some columns and add costly ones that are evaluated exactly once per row.

    Filters and projections on plain derived columns are merged into their definition, which
    repeats it for every reference. A generator is a boundary for both.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = _LOCAL_SCRATCH.setdefault("folder", tempfile.mkdtemp(prefix="simloom-"))
    return folder.rstrip("/")


_LOCAL_SCRATCH: dict[str, str] = {}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are removed as soon as each ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialized(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder once and reading them back.

    Unlike a checkpoint this computes the rows once, keeps them columnar (later readers prune
    columns and push filters) and gives the planner their true size. A lost executor only
    rereads files. Nothing reads the shuffles behind the rows again, so they go at once.
    """
    path = f"{scratch_folder(df.sparkSession)}/simloom-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialized`` once nothing will read it again."""
    session = df.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def materialized_with(df: DataFrame, **totals: Column) -> tuple[DataFrame, dict]:
    """:func:`materialized`, with aggregates collected during the same write.

    Iterations get their stop criterion this way without another job over the new state.
    """
    seen = Observation()
    written = materialized(df.observe(seen, *[total.alias(name) for name, total in totals.items()]))
    return written, seen.get
