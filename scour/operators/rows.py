"""Row and column operators: filter, select, drop, mutate, sort and a sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.functions.arithmetic import build_expression
from scour.functions.missing import known
from scour.functions.predicates import build_condition
from scour.schema import column_types, data_columns, ref, require_columns
from scour.streaming.guards import require_batch


def filter_rows(df: DataFrame, condition: Mapping, remove: bool = False) -> DataFrame:
    """Keep the rows that meet the condition, or with `remove` exactly the others."""
    keep = build_condition(condition, df.schema, for_filter=True)
    return df.where(~keep if remove else keep)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*map(ref, columns))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def mutate(df: DataFrame, column: str, expression) -> DataFrame:
    """Add or overwrite one column from an arithmetic expression."""
    return df.withColumn(column, build_expression(expression, df.schema))


def sort_keys(
    df: DataFrame, by: Sequence[str], ascending: Sequence[bool] | None = None
) -> list[Column]:
    """Sort keys with missing values last in both directions."""
    require_columns(df, by)
    if ascending is not None and len(ascending) != len(by):
        raise ValueError("'ascending' needs one entry per sort column")
    types = column_types(df.schema)
    keys = [F.expr(known(name, types[name])) for name in by]
    return [
        key.asc_nulls_last() if up else key.desc_nulls_last()
        for key, up in zip(keys, ascending or [True] * len(by))
    ]


def sort_rows(
    df: DataFrame,
    by: Sequence[str],
    ascending: Sequence[bool] | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Sort by range partitioning; `row_id` settles ties."""
    require_batch(df, "sort")
    keys = sort_keys(df, by, ascending)
    if row_id is not None:
        keys.append(ref(row_id).asc())
    return df.orderBy(*keys)


def sample_rows(df: DataFrame, row_id: str, n: int = 3) -> DataFrame:
    """The first rows with missing values as NULL; numbers, booleans and text keep their type."""
    require_batch(df, "sample_rows")
    types = column_types(df.schema)
    shown = []
    for name in data_columns(df, row_id):
        simple = types[name].typeName() in (
            "byte", "short", "integer", "long", "float", "double", "boolean", "string"
        )
        value = F.expr(known(name, types[name]))
        shown.append((value if simple else value.cast("string")).alias(name))
    return df.orderBy(ref(row_id)).limit(n).select(ref(row_id), *shown)
