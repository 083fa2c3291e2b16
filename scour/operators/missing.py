"""Missing values: drop rows, or fill with the mean, the median or the most frequent value.

A fill has two steps. `fit_*` computes one value per column with missing cells (a few scalars reach
the driver, never data); applying it is then a plain projection, so the cleaned table and its
change log do not compute the statistics twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions.missing import as_text, is_missing, known
from scour.operators.changes import Edit, any_missing, apply_edits, edit_log, removal_log
from scour.operators.quantiles import exact_medians
from scour.schema import (
    column_types,
    data_columns,
    is_numeric,
    literal,
    quoted,
    require_columns,
    unpivot,
)
from scour.streaming.guards import require_batch

NUMERIC_STRATEGIES = ("mean", "median")
CATEGORICAL_STRATEGIES = ("mode",)
# What the change log says.
MISSING_ROW = "Row contains missing value"
MISSING_REASON = "Dropped row containing missing value"
MISSING_MARK = "NaN"


def drop_missing(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Remove every row with a missing value in any data column."""
    return df.where(~any_missing(df, data_columns(df, row_id)))


def drop_missing_log(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    rows = df.where(any_missing(df, data_columns(df, row_id)))
    return removal_log(rows, row_id, MISSING_ROW, MISSING_REASON)


def _targets(df: DataFrame, column: str | None, row_id: str | None, numeric: bool) -> list[str]:
    types = column_types(df.schema)
    if column is None:
        return [name for name in data_columns(df, row_id) if is_numeric(types[name]) == numeric]
    require_columns(df, [column])
    if is_numeric(types[column]) != numeric:
        kind = "numeric" if is_numeric(types[column]) else "not numeric"
        raise ValueError(f"Column {column!r} is {kind} ({types[column].simpleString()})")
    return [column]


def _present_counts(df: DataFrame, columns: Sequence[str], extra=()) -> tuple[dict, dict, object]:
    """Present and missing cells per column in one scan, along with any further aggregates."""
    types = column_types(df.schema)
    present = [
        F.expr(f"count({known(name, types[name])}) AS p{i}") for i, name in enumerate(columns)
    ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *present, *extra).first()
    counts = {name: row[f"p{i}"] for i, name in enumerate(columns)}
    return counts, {name: row["rows"] - n for name, n in counts.items()}, row


def fit_numeric(
    df: DataFrame, strategy: str, column: str | None = None, row_id: str | None = "row_id"
) -> dict[str, float]:
    """The fill value of each numeric column that has both missing and present cells."""
    require_batch(df, "fill_numeric")
    if strategy not in NUMERIC_STRATEGIES:
        raise ValueError(
            f"Unknown strategy {strategy!r}; use one of {', '.join(NUMERIC_STRATEGIES)}"
        )
    columns = _targets(df, column, row_id, numeric=True)
    if not columns:
        return {}
    types = column_types(df.schema)
    means = []
    if strategy == "mean":
        means = [
            F.expr(f"avg(CAST({known(name, types[name])} AS DOUBLE)) AS m{i}")
            for i, name in enumerate(columns)
        ]
    counts, gaps, row = _present_counts(df, columns, means)
    fillable = [name for name in columns if gaps[name] and counts[name]]
    if strategy == "mean":
        return {name: row[f"m{columns.index(name)}"] for name in fillable}
    return exact_medians(df, {name: counts[name] for name in fillable}) if fillable else {}


def fit_categorical(
    df: DataFrame,
    strategy: str = "mode",
    column: str | None = None,
    row_id: str | None = "row_id",
) -> dict[str, str]:
    """The most frequent value (the smallest on ties) of each other column with missing cells."""
    require_batch(df, "fill_categorical")
    if strategy not in CATEGORICAL_STRATEGIES:
        raise ValueError(
            f"Unknown strategy {strategy!r}; use one of {', '.join(CATEGORICAL_STRATEGIES)}"
        )
    columns = _targets(df, column, row_id, numeric=False)
    if not columns:
        return {}
    counts, gaps, _ = _present_counts(df, columns)
    fillable = [name for name in columns if gaps[name] and counts[name]]
    if not fillable:
        return {}
    types = column_types(df.schema)
    counted = (
        unpivot(df, {name: as_text(name, types[name]) for name in fillable})
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.expr("count(1) AS n"))
    )
    best = counted.agg(
        *[
            F.expr(f"min(CASE WHEN column = {literal(name)} THEN struct(-n AS r, value) END) AS b{i}")
            for i, name in enumerate(fillable)
        ]
    ).first()
    return {name: best[f"b{i}"]["value"] for i, name in enumerate(fillable)}


def fill_edits(df: DataFrame, values: Mapping[str, object], strategy: str) -> list[Edit]:
    """Numeric columns become double once they are filled; other columns keep their type."""
    types = column_types(df.schema)
    edits = []
    for name, value in values.items():
        dtype = types[name]
        if is_numeric(dtype):
            shown = repr(float(value))
            filled = f"coalesce(CAST({known(name, dtype)} AS DOUBLE), double('{shown}'))"
        else:
            shown = value
            filled = f"coalesce({quoted(name)}, CAST({literal(value)} AS {dtype.simpleString()}))"
        edits.append(
            Edit(
                column=name,
                source=quoted(name),
                original=literal(MISSING_MARK),
                cleaned=f"CASE WHEN {is_missing(name, dtype)} THEN {literal(shown)} END",
                reason=literal(f"Filled missing value using {strategy}"),
                value=filled,
            )
        )
    return edits


def numeric_edits(
    df: DataFrame, strategy: str, column: str | None = None, row_id: str | None = "row_id"
) -> list[Edit]:
    return fill_edits(df, fit_numeric(df, strategy, column, row_id), strategy)


def categorical_edits(
    df: DataFrame,
    strategy: str = "mode",
    column: str | None = None,
    row_id: str | None = "row_id",
) -> list[Edit]:
    return fill_edits(df, fit_categorical(df, strategy, column, row_id), strategy)


def fill_numeric(
    df: DataFrame, strategy: str, column: str | None = None, row_id: str | None = "row_id"
) -> DataFrame:
    return apply_edits(df, numeric_edits(df, strategy, column, row_id))


def fill_categorical(
    df: DataFrame,
    strategy: str = "mode",
    column: str | None = None,
    row_id: str | None = "row_id",
) -> DataFrame:
    return apply_edits(df, categorical_edits(df, strategy, column, row_id))


def fill_numeric_log(
    df: DataFrame, strategy: str, column: str | None = None, row_id: str = "row_id"
) -> DataFrame:
    return edit_log(df, numeric_edits(df, strategy, column, row_id), row_id)


def fill_categorical_log(
    df: DataFrame, strategy: str = "mode", column: str | None = None, row_id: str = "row_id"
) -> DataFrame:
    return edit_log(df, categorical_edits(df, strategy, column, row_id), row_id)
