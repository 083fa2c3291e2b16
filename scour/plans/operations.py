"""Single named operations with a checked request: `run_operation(df, name, column, parameters)`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from scour.functions.dates import TARGET_FORMATS
from scour.functions.text import STANDARDIZE_STYLES
from scour.operators import columns, dedup, missing
from scour.operators.changes import apply_edits, edit_log
from scour.schema import require_columns, require_row_id
from scour.streaming.guards import require_batch

NO_COLUMN, OPTIONAL_COLUMN, NEEDS_COLUMN = "none", "optional", "required"


class Operation(NamedTuple):
    column: str
    # Parameter name to its allowed values, None for any.
    parameters: Mapping[str, Sequence[str] | None]


OPERATIONS = {
    "remove_duplicates": Operation(NO_COLUMN, {}),
    "drop_missing": Operation(NO_COLUMN, {}),
    "fill_numeric": Operation(OPTIONAL_COLUMN, {"strategy": missing.NUMERIC_STRATEGIES}),
    "fill_categorical": Operation(OPTIONAL_COLUMN, {"strategy": missing.CATEGORICAL_STRATEGIES}),
    "remove_units": Operation(NEEDS_COLUMN, {"unit": None}),
    "standardize_units": Operation(NEEDS_COLUMN, {"target_unit": None}),
    "standardize_text": Operation(NEEDS_COLUMN, {"style": STANDARDIZE_STYLES}),
    "date_format": Operation(
        NEEDS_COLUMN, {"interpretation": None, "format": tuple(TARGET_FORMATS)}
    ),
}


class OperationResult(NamedTuple):
    """Two lazy tables: the result and its change log. Looking at the log alone is the preview."""

    data: DataFrame
    log: DataFrame


def check_operation(
    operation: str, column: str | None = None, parameters: Mapping | None = None
) -> None:
    """Raise ValueError unless the request is complete and allowed."""
    if operation not in OPERATIONS:
        raise ValueError(f"Unknown operation {operation!r}; use one of {', '.join(OPERATIONS)}")
    definition = OPERATIONS[operation]
    if definition.column == NEEDS_COLUMN and not column:
        raise ValueError(f"Operation {operation!r} needs a column")
    if definition.column == NO_COLUMN and column:
        raise ValueError(f"Operation {operation!r} takes no column")
    given = parameters or {}
    for name, allowed in definition.parameters.items():
        if name not in given:
            raise ValueError(f"Operation {operation!r} needs the parameter {name!r}")
        if allowed is not None and given[name] not in allowed:
            raise ValueError(
                f"Parameter {name!r} of {operation!r} cannot be {given[name]!r}; "
                f"use one of {', '.join(map(repr, allowed))}"
            )


def run_operation(
    df: DataFrame,
    operation: str,
    column: str | None = None,
    parameters: Mapping | None = None,
    row_id: str = "row_id",
) -> OperationResult:
    check_operation(operation, column, parameters)
    require_row_id(df, row_id, "run_operation")
    if column is not None:
        require_columns(df, [column])
    given = parameters or {}
    if operation == "remove_duplicates":
        require_batch(df, operation)
        return OperationResult(
            dedup.remove_duplicates(df, row_id), dedup.remove_duplicates_log(df, row_id)
        )
    if operation == "drop_missing":
        return OperationResult(
            missing.drop_missing(df, row_id), missing.drop_missing_log(df, row_id)
        )
    makers = {
        "fill_numeric": lambda: missing.numeric_edits(df, given["strategy"], column, row_id),
        "fill_categorical": lambda: missing.categorical_edits(df, given["strategy"], column, row_id),
        "remove_units": lambda: columns.remove_units_edits(df, column, given["unit"]),
        "standardize_units": lambda: columns.standardize_units_edits(
            df, column, given["target_unit"]
        ),
        "standardize_text": lambda: columns.standardize_text_edits(df, column, given["style"]),
        "date_format": lambda: columns.date_format_edits(
            df, column, given["interpretation"], given["format"]
        ),
    }
    edits = makers[operation]()
    return OperationResult(apply_edits(df, edits), edit_log(df, edits, row_id))
