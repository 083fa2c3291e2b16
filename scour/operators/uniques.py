"""Approximate unique counts from sketches that can be kept and merged.

The exact count (`column_statistics`) shuffles every distinct value. A sketch is a few kilobytes a
column and task, so this is a plain aggregate of one row a task, and the sketches of several loads
of a table merge into those of the whole without reading it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions.missing import as_text, is_missing
from scour.operators.profile import inline_rows
from scour.schema import column_types, data_columns, literal
from scour.streaming.guards import require_batch

LG_K = 12
_TALLIES = ("rows", "missing")


def relative_error(lg_k: int = LG_K) -> float:
    """The relative standard error of an estimate: 1.3 % for the default of 2^12 registers."""
    return 0.83 / 2 ** (lg_k / 2)


def unique_sketches(df: DataFrame, row_id: str | None = "row_id", lg_k: int = LG_K) -> DataFrame:
    """One row per column: `(column, rows, missing, sketch)`; one scan, no distinct values shuffled.

    Values are told apart as in the exact count: by their text, NaN is missing, -0.0 is 0.0. The
    sketch is a HyperLogLog sketch with 2^`lg_k` registers (4 to 21) as binary, to be stored with the
    table. An empty table has sketches of nothing.
    """
    require_batch(df, "unique_sketches")
    if not 4 <= lg_k <= 21:
        raise ValueError(f"lg_k must be from 4 to 21, not {lg_k}")
    types = column_types(df.schema)
    names = data_columns(df, row_id)
    aggregates, rows = ["count(1) AS rows"], []
    for i, name in enumerate(names):
        aggregates += [
            f"count_if({is_missing(name, types[name])}) AS m{i}",
            f"hll_sketch_agg({as_text(name, types[name])}, {lg_k}) AS s{i}",
        ]
        rows.append(
            f"named_struct('column', {literal(name)}, 'rows', rows, 'missing', m{i}, 'sketch', s{i})"
        )
    if not names:
        raise ValueError("The table has no data columns")
    return inline_rows(df.agg(*map(F.expr, aggregates)), rows)


def merge_sketches(*loads: DataFrame) -> DataFrame:
    """The sketches of the loads put together, as if they had been one table.

    Columns are matched by name; one that a load lacks counts nothing there. Sketches of different
    precision merge to the lower one.
    """
    if not loads:
        raise ValueError("There are no sketches to merge")
    merged = reduce(DataFrame.unionByName, loads)
    sums = [F.sum(name).alias(name) for name in _TALLIES]
    return merged.groupBy("column").agg(*sums, F.expr("hll_union_agg(sketch, true) AS sketch"))


def estimate_unique(sketches: DataFrame) -> DataFrame:
    """`(column, rows, missing, distinct_values)`; an estimate never exceeds the present values."""
    present = "least(hll_sketch_estimate(sketch), rows - missing)"
    return sketches.selectExpr("column", *_TALLIES, f"{present} AS distinct_values")


def approximate_unique(
    df: DataFrame, row_id: str | None = "row_id", lg_k: int = LG_K
) -> DataFrame:
    """`column_statistics` without its exact counts: estimates within `relative_error`, one scan."""
    return estimate_unique(unique_sketches(df, row_id, lg_k))
