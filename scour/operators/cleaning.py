"""The combined cleaning pass: missing values, then duplicates, then units, then text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions.missing import is_missing
from scour.operators import columns as column_ops
from scour.operators import dedup, missing
from scour.operators.changes import (
    apply_edits,
    edit_log,
    empty_log,
    known_columns,
    union_logs,
)
from scour.schema import column_types, data_columns, require_row_id
from scour.streaming.guards import require_batch


class Cleaned(NamedTuple):
    """Three lazy tables: the result, its change log, and a one-row summary."""

    data: DataFrame
    log: DataFrame
    stats: DataFrame


def clean(
    df: DataFrame,
    *,
    remove_duplicates: bool = False,
    drop_missing: bool = False,
    fill_numeric: str | None = None,
    fill_categorical: str | None = None,
    numeric_column: str | None = None,
    categorical_column: str | None = None,
    remove_units: tuple[str, str] | None = None,
    standardize_text: tuple[str, str] | None = None,
    row_id: str = "row_id",
) -> Cleaned:
    """Apply the chosen actions in their fixed order.

    `remove_units` is `(column, unit)`, `standardize_text` is `(column, style)`.
    """
    require_batch(df, "clean")
    require_row_id(df, row_id, "clean")
    if not any(
        (remove_duplicates, drop_missing, fill_numeric, fill_categorical, remove_units,
         standardize_text)
    ):
        raise ValueError("No cleaning action was asked for")
    if drop_missing and (fill_numeric or fill_categorical):
        raise ValueError("Missing values can be dropped or filled, not both")

    logs = []
    present = df
    if drop_missing:
        logs.append(missing.drop_missing_log(df, row_id))
        present = missing.drop_missing(df, row_id)
    fills = []
    if fill_numeric:
        fills += missing.numeric_edits(df, fill_numeric, numeric_column, row_id)
    if fill_categorical:
        fills += missing.categorical_edits(df, fill_categorical, categorical_column, row_id)
    if fills:
        logs.append(edit_log(df, fills, row_id))
        present = apply_edits(df, fills)

    unique = present
    if remove_duplicates:
        logs.append(dedup.remove_duplicates_log(present, row_id))
        unique = dedup.remove_duplicates(present, row_id)

    result = unique
    if remove_units:
        edits = column_ops.remove_units_edits(result, *remove_units)
        logs.append(edit_log(result, edits, row_id))
        result = apply_edits(result, edits)
    if standardize_text:
        edits = column_ops.standardize_text_edits(result, *standardize_text)
        logs.append(edit_log(result, edits, row_id))
        result = apply_edits(result, edits)

    log = union_logs(logs) if logs else empty_log(df, row_id)
    return Cleaned(result, log, clean_stats(df, present, remove_duplicates, row_id))


def clean_stats(
    df: DataFrame, present: DataFrame, remove_duplicates: bool, row_id: str
) -> DataFrame:
    """Rows before and after, rows dropped, duplicates removed and missing cells left.

    `present` is the table after the missing-value step. One grouping answers everything about the
    duplicates: the group count is the number of rows kept.
    """
    names = data_columns(present, row_id)
    types = column_types(present.schema)
    kept = "count(1)"
    if remove_duplicates:
        present = present.groupBy(*known_columns(present, names)).agg(F.expr("count(1) AS __n"))
        kept = "coalesce(sum(__n), 0)"
    gaps = " + ".join(f"CAST({is_missing(name, types[name])} AS BIGINT)" for name in names) or "0"
    after = present.agg(
        F.expr("CAST(0 AS BIGINT) AS before"),
        F.expr(f"{kept} AS kept"),
        F.expr("count(1) AS after"),
        F.expr(f"coalesce(sum({gaps}), 0) AS gaps"),
    )
    before = df.agg(
        F.expr("count(1) AS before"),
        *[F.expr(f"CAST(0 AS BIGINT) AS {name}") for name in ("kept", "after", "gaps")],
    )
    return before.unionByName(after).agg(
        F.expr("sum(before) AS rows_before"),
        F.expr("sum(after) AS rows_after"),
        F.expr("sum(before) - sum(kept) AS missing_rows_dropped"),
        F.expr("sum(kept) - sum(after) AS duplicate_rows_removed"),
        F.expr("sum(gaps) AS remaining_missing"),
    )
