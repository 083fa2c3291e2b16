"""Safe type inference for text columns: all columns decided by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scour.functions import dates, numbers, text
from scour.schema import data_columns, literal, quoted, ref, text_columns
from scour.streaming.guards import require_batch

# Texts that count as missing once a whole column converts.
EMPTY_TOKENS = ("", "nan", "NaN", "None", "null")
LEADING_ZERO = r"^-?0[0-9]+$"
MIN_DATE_LENGTH = 6

TEXT, INTEGER, DOUBLE, DATETIME, BOOLEAN = "string", "bigint", "double", "timestamp_ntz", "boolean"


SAFE_TESTS = ("present", "zeros", "odd", "not_int", "rounded", "short", "undated")


def flags(
    df: DataFrame, names: Sequence[str], tokens: Sequence[str], tests: Sequence[str], *more: str
) -> Row:
    """One row with the tests that decide on each text column, `<test><i>`, and further aggregates.

    The ends are stripped in a projection of their own, because every test needs that.
    """
    kept = [name for name in df.columns if name not in names]
    stripped = df.selectExpr(
        *map(quoted, kept), *[f"{text.strip(quoted(name))} AS s{i}" for i, name in enumerate(names)]
    )
    listed = ", ".join(map(literal, tokens))
    truths = "'True', 'False', 'TRUE', 'FALSE', 'true', 'false'"
    aggregates = list(more)
    for i in range(len(names)):
        value = f"s{i}"
        cell = f"({value} NOT IN ({listed}))" if listed else f"({value} IS NOT NULL)"
        conditions = {
            "present": f"{value} IS NOT NULL",
            "absent": f"{value} IS NULL",
            "zeros": text.matches(value, LEADING_ZERO),
            "odd": f"{cell} AND NOT {numbers.is_number(value)}",
            "not_int": f"NOT {numbers.is_integer(value)}",
            "rounded": numbers.loses_digits(value),
            "short": f"length({value}) < {MIN_DATE_LENGTH}",
            "undated": f"{cell} AND {dates.parse_date(value, day_first=False)} IS NULL",
            "not_bool": f"{cell} AND {value} NOT IN ({truths})",
        }
        aggregates += [f"coalesce(bool_or({conditions[key]}), false) AS {key}{i}" for key in tests]
    return stripped.agg(*map(F.expr, aggregates)).first()


def _decide(row, i: int) -> str:
    """Numbers first, then dates, otherwise text."""
    if not row[f"present{i}"]:
        return TEXT
    if not row[f"zeros{i}"] and not row[f"odd{i}"]:
        if not row[f"not_int{i}"]:
            return INTEGER
        # A number that a double would round stays as it is written.
        return TEXT if row[f"rounded{i}"] else DOUBLE
    if not row[f"short{i}"] and not row[f"undated{i}"]:
        return DATETIME
    return TEXT


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = EMPTY_TOKENS
) -> dict[str, str]:
    """The type each text column can take without losing a value.

    Numeric if no cell has leading zeros and every cell that is not empty is a number; integral if
    in addition no cell is empty and all fit 64 bits. A column stays text if a double would round
    one of its integers. Otherwise a timestamp if every cell has at least six characters
    and is a date. A column of empty cells alone becomes numeric, a column without cells stays text.
    """
    require_batch(df, "infer_types")
    names = list(columns) if columns is not None else text_columns(df.schema, df.columns)
    if not names:
        return {}
    row = flags(df.select(*map(ref, names)), names, tokens, SAFE_TESTS)
    return {name: _decide(row, i) for i, name in enumerate(names)}


def converted(name: str, dtype: str) -> str:
    """The text column in the inferred type, as SQL text."""
    value = quoted(name)
    if dtype == INTEGER:
        return f"CASE WHEN {numbers.is_integer(value)} THEN try_cast(trim({value}) AS BIGINT) END"
    if dtype == DOUBLE:
        return numbers.to_double(value)
    if dtype == DATETIME:
        return dates.parse_date(text.strip(value), day_first=False)
    if dtype == BOOLEAN:
        return f"try_cast({text.strip(value)} AS BOOLEAN)"
    return value


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    changed = {name: F.expr(converted(name, t)) for name, t in types.items() if t != TEXT}
    return df.withColumns(changed) if changed else df


def safe_infer(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Convert every text column that converts safely; the others stay exactly as they are."""
    names = text_columns(df.schema, data_columns(df, row_id))
    return apply_types(df, infer_types(df, names))
