"""Stable row identities and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.streaming.guards import require_batch

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="scour-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder the session names.

    Without the setting only a local session gets a temporary folder: on a cluster other machines
    could not read it.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"Set {CHECKPOINT_DIR} to a folder all executors can reach")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write the table once and read it back: a short plan that survives lost executors, and keeps
    column pruning and filter pushdown, unlike an RDD checkpoint."""
    require_batch(df, "stage")
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete what `stage` wrote for this table. Only for tables that nothing will read again."""
    spark = staged.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Add a unique row identity that follows the scan order, and pin it by staging.

    The generated number depends on how the scan is split, so it must not be computed twice.
    """
    if row_id in df.columns:
        raise ValueError(f"Column {row_id!r} exists already")
    numbered = df.select(F.monotonically_increasing_id().alias(row_id), "*")
    return stage(numbered, "row-ids")
