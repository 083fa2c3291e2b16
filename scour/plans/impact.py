"""The impact of a pipeline: rows, columns and cells, as a one-row table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.operators.changes import cells_differ
from scour.schema import column_types, data_columns, literal, quoted

ORIGINALS = "__originals"


def changed_cells(before_types: dict[str, T.DataType], after: DataFrame, names: Sequence[str]) -> str:
    """Changed cells of one row: the originals travel along in a hidden struct."""
    after_types = column_types(after.schema)
    tests = [
        cells_differ(f"{ORIGINALS}.{quoted(name)}", before_types[name], name, after_types[name])
        for name in names
    ]
    return " + ".join(f"CAST({test} AS BIGINT)" for test in tests) or "CAST(0 AS BIGINT)"


def impact(
    before: DataFrame, after: DataFrame, touched: Sequence[str], row_id: str
) -> DataFrame:
    """Both counts and the changed cells in one aggregate over two scans.

    `after` still carries the hidden originals of the `touched` columns, the only ones that can
    differ; columns that no step writes are never compared.
    """
    names_before = data_columns(before, row_id)
    names_after = [name for name in data_columns(after, row_id) if name != ORIGINALS]
    compared = [name for name in touched if name in names_after]
    changed = changed_cells(column_types(before.schema), after, compared)
    old = before.agg(
        F.expr("count(1) AS b"), F.expr("CAST(0 AS BIGINT) AS a"), F.expr("CAST(0 AS BIGINT) AS v")
    )
    new = after.agg(
        F.expr("CAST(0 AS BIGINT) AS b"),
        F.expr("count(1) AS a"),
        F.expr(f"coalesce(sum({changed}), 0) AS v"),
    )
    return old.unionByName(new).agg(
        F.expr("sum(b) AS rows_before"),
        F.expr("sum(a) AS rows_after"),
        F.expr("greatest(sum(b) - sum(a), 0) AS rows_removed"),
        _names([name for name in names_after if name not in names_before], "columns_added"),
        _names([name for name in names_before if name not in names_after], "columns_removed"),
        F.expr("sum(v) AS values_changed"),
    )


def _names(names: Sequence[str], alias: str) -> Column:
    return F.expr(f"CAST(array({', '.join(map(literal, names))}) AS ARRAY<STRING>) AS {alias}")
