"""Positions in a global order, without a window that has no partition key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scour.sources.staging import stage


def with_positions(df: DataFrame, order: str, position: str = "position") -> DataFrame:
    """Number the rows from 0 in ascending order of a column whose values are distinct.

    The rows are dealt by range and written once, as the borders of the ranges come from a sample
    and must not be drawn twice. Rows are then numbered within their range; each range starts after
    the rows of the ranges before it. What meets in one task, and is broadcast, is a row per range:
    as many as there are shuffle partitions. Nulls come first.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        df.repartitionByRange(ranges, F.col(order).asc_nulls_first()).withColumn(
            "__range", F.spark_partition_id()
        ),
        "positions",
    )
    starts = (
        dealt.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn(
            "__start",
            F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("__range", F.coalesce("__start", F.lit(0)).alias("__start"))
    )
    within = F.row_number().over(
        Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_first())
    )
    return (
        dealt.withColumn("__within", within)
        .join(F.broadcast(starts), "__range")
        .withColumn(position, F.col("__start") + F.col("__within") - 1)
        .drop("__range", "__start", "__within")
    )
