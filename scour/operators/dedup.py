"""Duplicate rows: keep the first row per key.

No form sends all rows of one key to one task. Keys meet in hash aggregates with a map-side
partial, or in a rank filter that Spark also applies before the shuffle; removed rows are found by
an anti-join on the unique row identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scour.operators.changes import known_columns, removal_log
from scour.schema import (
    data_columns,
    ref,
    require_columns,
    require_row_id,
)
from scour.streaming.guards import require_batch

# What the change log says.
DUPLICATE_ROW = "Duplicate row"
DUPLICATE_REASON = "Removed duplicate row"


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    row_id: str = "row_id",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Keep the first row per key in row order (or in `order`); missing equals missing."""
    require_batch(df, "drop_duplicates")
    columns = list(subset) if subset is not None else data_columns(df, row_id)
    if not columns:
        raise ValueError("drop_duplicates needs at least one column to tell rows apart by")
    require_columns(df, columns)
    if order is None:
        order = [ref(require_row_id(df, row_id, "drop_duplicates")).asc()]
    window = Window.partitionBy(*known_columns(df, columns)).orderBy(*order)
    # `= 1` on a row number becomes a group limit on both sides of the shuffle.
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def _first_rows(df: DataFrame, row_id: str) -> DataFrame:
    """The data columns of each distinct row with its first row identity."""
    keys = known_columns(df, data_columns(df, row_id))
    return df.groupBy(*keys).agg(F.min(ref(row_id)).alias(row_id))


def remove_duplicates(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Whole-row duplicates, keep the first. NaN comes back as NULL: both mean missing."""
    require_batch(df, "remove_duplicates")
    if row_id is None or row_id not in df.columns:
        return df.select(*known_columns(df, df.columns)).distinct()
    return _first_rows(df, row_id).select(*map(ref, df.columns))


def duplicate_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The row identities that `remove_duplicates` drops.

    The anti-join runs on the unique identity, so a value that fills a third of the table does not
    end up in one task.
    """
    require_batch(df, "duplicate_rows")
    require_row_id(df, row_id, "duplicate_rows")
    kept = _first_rows(df, row_id).select(ref(row_id))
    return df.select(ref(row_id)).join(kept, row_id, "left_anti")


def remove_duplicates_log(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return removal_log(duplicate_rows(df, row_id), row_id, DUPLICATE_ROW, DUPLICATE_REASON)


def duplicate_count(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row: all rows, distinct rows, and the rows beyond the first of each kind."""
    require_batch(df, "duplicate_count")
    keys = known_columns(df, data_columns(df, row_id))
    return df.groupBy(*keys).agg(F.expr("count(1) AS __n")).agg(
        F.expr("coalesce(sum(__n), 0) AS rows"),
        F.expr("count(1) AS distinct_rows"),
        F.expr("coalesce(sum(__n), 0) - count(1) AS duplicate_rows"),
    )
