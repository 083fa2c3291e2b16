"""Text, unit and date operators on single columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions import dates, numbers, text, units
from scour.operators.changes import Edit, apply_edits, edit_log, step_name
from scour.schema import (
    column_types,
    data_columns,
    is_text,
    literal,
    quoted,
    require_columns,
    text_columns,
)

ALL_TEXT = "all_string"

# The reasons written to the change log.
TEXT_REASONS = {
    "strip": "Standardized text by removing leading/trailing whitespace",
    "lower": "Standardized text using lowercase",
    "upper": "Standardized text using uppercase",
    "title": "Standardized text using title case",
}


def normalize_text(
    df: DataFrame,
    style: str,
    columns: Sequence[str] | str | None = None,
    row_id: str | None = "row_id",
) -> DataFrame:
    """One text style on the named columns, or on all text columns."""
    if columns is None or columns == ALL_TEXT:
        columns = text_columns(df.schema, data_columns(df, row_id))
    else:
        require_columns(df, columns)
    types = column_types(df.schema)
    for name in columns:
        if not is_text(types[name]):
            raise TypeError(
                f"normalize_text cannot change {name!r}: it is {types[name].simpleString()}, not text"
            )
    return df.withColumns(
        {name: F.expr(text.normalize(quoted(name), style)) for name in columns}
    )


def _source(df: DataFrame, column: str) -> str:
    require_columns(df, [column])
    is_plain_text = is_text(column_types(df.schema)[column])
    return quoted(column) if is_plain_text else f"CAST({quoted(column)} AS STRING)"


def standardize_text_edits(df: DataFrame, column: str, style: str) -> list[Edit]:
    require_columns(df, [column])
    dtype = column_types(df.schema)[column]
    if not is_text(dtype):
        raise TypeError(f"Column {column!r} is {dtype.simpleString()}, not text")
    cleaned = text.standardize(quoted(column), style)
    return [
        Edit(column, quoted(column), quoted(column), cleaned, literal(TEXT_REASONS[style]))
    ]


def remove_units_edits(df: DataFrame, column: str, unit: str) -> list[Edit]:
    """Cells that are a number and this unit become the number, in text form."""
    source = _source(df, column)
    stripped, value = step_name(df, "text", column), step_name(df, "number", column)
    # Quoted literally, whatever characters the unit has.
    pattern = r"(?iu)^([-+]?\d+(?:\.\d+)?)(?U:\s*)" + re.escape(unit) + r"(?U:\s*)$"
    number = f"try_cast(regexp_extract({stripped}, {literal(pattern)}, 1) AS DOUBLE)"
    reason = literal(f"Removed {unit} unit")
    steps = ((stripped, text.strip(source)), (value, number))
    return [Edit(column, source, stripped, numbers.render_number(value), reason, steps=steps)]


def standardize_units_edits(df: DataFrame, column: str, target_unit: str) -> list[Edit]:
    """Quantities in a unit of the target's category are rewritten as `<number> <target unit>`."""
    source = _source(df, column)
    stripped, value = step_name(df, "text", column), step_name(df, "number", column)
    unit = units.quantity_unit(stripped)
    number = f"try_cast({units.quantity_number(stripped)} AS DOUBLE)"
    converted = units.convert_value(number, unit, target_unit)
    steps = ((stripped, text.strip(source)), (value, converted))
    cleaned = f"concat({numbers.render_rounded(value)}, {literal(' ' + target_unit)})"
    reason = f"concat('Converted from ', {unit}, {literal(' to ' + target_unit)})"
    return [Edit(column, source, stripped, cleaned, reason, steps=steps)]


def date_format_edits(
    df: DataFrame, column: str, interpretation: str, target_format: str
) -> list[Edit]:
    """Dates are rewritten in the target notation; texts that are no date stay as they are."""
    source = _source(df, column)
    stripped = step_name(df, "text", column)
    parsed = dates.parse_date(stripped, day_first=interpretation == dates.DAY_FIRST)
    cleaned = dates.render_date(parsed, target_format)
    reason = f"Converted date to {target_format} using user-selected interpretation"
    steps = ((stripped, text.strip(source)),)
    return [Edit(column, source, stripped, cleaned, literal(reason), steps=steps)]


def standardize_text(df: DataFrame, column: str, style: str) -> DataFrame:
    return apply_edits(df, standardize_text_edits(df, column, style))


def standardize_text_log(df: DataFrame, column: str, style: str, row_id: str = "row_id") -> DataFrame:
    return edit_log(df, standardize_text_edits(df, column, style), row_id)


def remove_units(df: DataFrame, column: str, unit: str, numeric: bool = False) -> DataFrame:
    """`numeric` turns the result into a double column; what is still no number becomes NULL."""
    cleaned = apply_edits(df, remove_units_edits(df, column, unit))
    if numeric:
        cleaned = cleaned.withColumn(column, F.expr(numbers.to_double(quoted(column))))
    return cleaned


def remove_units_log(df: DataFrame, column: str, unit: str, row_id: str = "row_id") -> DataFrame:
    return edit_log(df, remove_units_edits(df, column, unit), row_id)


def standardize_units(df: DataFrame, column: str, target_unit: str) -> DataFrame:
    return apply_edits(df, standardize_units_edits(df, column, target_unit))


def standardize_units_log(
    df: DataFrame, column: str, target_unit: str, row_id: str = "row_id"
) -> DataFrame:
    return edit_log(df, standardize_units_edits(df, column, target_unit), row_id)


def date_format(
    df: DataFrame, column: str, interpretation: str, target_format: str
) -> DataFrame:
    return apply_edits(df, date_format_edits(df, column, interpretation, target_format))


def date_format_log(
    df: DataFrame, column: str, interpretation: str, target_format: str, row_id: str = "row_id"
) -> DataFrame:
    return edit_log(
        df, date_format_edits(df, column, interpretation, target_format), row_id
    )
