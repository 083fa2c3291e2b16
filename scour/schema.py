"""Schema helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGRAL_TYPES + FLOAT_TYPES + (T.DecimalType,)
TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT_TYPES)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL_TYPES)


def _in_backticks(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> str:
    """The column in SQL text; dots, spaces and backticks are part of the name.

    The parser would replace `${...}` by settings, and names know no escape, so such a name is
    refused.
    """
    if "${" in name:
        raise ValueError(f"The column name {name!r} contains '${{'; rename it")
    return _in_backticks(name)


def literal(text: str) -> str:
    """The text as a SQL string literal. The dollar sign is escaped: `${...}` is replaced in SQL."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return "'" + escaped + "'"


def ref(name: str) -> Column:
    """A reference to exactly this column."""
    return F.col(_in_backticks(name))


def column_types(schema: T.StructType) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in schema.fields}


def data_columns(df: DataFrame, row_id: str | None) -> list[str]:
    """All columns but the row identity, which labels rows and is not data."""
    return [name for name in df.columns if name != row_id]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(
            f"Unknown column(s) {', '.join(map(repr, missing))}; "
            f"the table has: {', '.join(df.columns)}"
        )


def require_row_id(df: DataFrame, row_id: str | None, what: str) -> str:
    if row_id is None or row_id not in df.columns:
        raise ValueError(f"{what} needs a row identity column; see scour.with_row_id")
    return row_id


def text_columns(schema: T.StructType, names: Sequence[str]) -> list[str]:
    types = column_types(schema)
    return [name for name in names if is_text(types[name])]


def unpivot(df: DataFrame, values: dict[str, str], **kept: str) -> DataFrame:
    """`(column, value)` rows, one per entry of `values`, after the kept columns; all SQL text.

    The values must have one type. They go through one array, not a projection each as in Spark's
    own unpivot, whose plan grows with the square of the columns.
    """
    names = ", ".join(map(literal, values))
    arrays = df.selectExpr(
        *[f"{sql} AS {name}" for name, sql in kept.items()],
        f"array({', '.join(values.values())}) AS cells",
    )
    return arrays.selectExpr(*kept, "posexplode(cells) AS (place, value)").selectExpr(
        *kept, f"element_at(array({names}), place + 1) AS column", "value"
    )
