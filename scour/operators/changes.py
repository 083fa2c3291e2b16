"""Cell edits: the cleaned table and its change log come from the same expressions.

An operator describes what it does as a list of `Edit`s. `apply_edits` turns them into the cleaned
table, `edit_log` into one log row per changed cell, both from a single pass over the source and
without joining the two versions. Cleaned values get a projection of their own, because they are
compared, written and logged but should be computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.missing import is_missing, known
from scour.schema import column_types, is_float, is_numeric, literal, quoted, ref, require_row_id

WHOLE_ROW = "*"
REMOVED = "Removed"


def step_name(df: DataFrame, kind: str, column: str) -> str:
    """A name for an intermediate result of a column, which no column of the table has."""
    name = f"__{kind}_{df.columns.index(column)}"
    taken = {other.lower() for other in df.columns}
    while name in taken:
        name = "_" + name
    return name


@dataclass(frozen=True)
class Edit:
    """How one column changes; everything is SQL text over the source columns.

    A cell changes where `cleaned` is not NULL and differs from `original`. `source` is what stays
    in unchanged cells, `value` the new column if it is not just the cleaned text. `steps` are
    named intermediate results, computed once per row in this order; `step_name` gives names.
    """

    column: str
    source: str
    original: str
    cleaned: str
    reason: str
    value: str | None = None
    steps: tuple[tuple[str, str], ...] = ()

    def staged(self, df: DataFrame) -> Edit:
        """The edit with the cleaned value as the last step."""
        name = step_name(df, "cleaned", self.column)
        return replace(self, cleaned=name, steps=(*self.steps, (name, self.cleaned)))

    @property
    def changed(self) -> str:
        return f"({self.cleaned} <> {self.original})"


def _staged(df: DataFrame, edits: Sequence[Edit]) -> tuple[DataFrame, list[Edit]]:
    """The table with all steps next to the source columns, and the edits that refer to them."""
    numbered = [edit.staged(df) for edit in edits]
    for level in range(max(len(edit.steps) for edit in numbered)):
        steps = [edit.steps[level] for edit in numbered if level < len(edit.steps)]
        df = df.select("*", *[F.expr(sql).alias(name) for name, sql in steps])
    return df, numbered


def apply_edits(df: DataFrame, edits: Sequence[Edit]) -> DataFrame:
    if not edits:
        return df
    staged, numbered = _staged(df, edits)
    values = {
        edit.column: edit.value
        or f"CASE WHEN {edit.changed} THEN {edit.cleaned} ELSE {edit.source} END"
        for edit in numbered
    }
    return staged.select(
        *[F.expr(values.get(name, quoted(name))).alias(name) for name in df.columns]
    )


def edit_log(df: DataFrame, edits: Sequence[Edit], row_id: str) -> DataFrame:
    """One row per changed cell."""
    require_row_id(df, row_id, "A change log")
    if not edits:
        return empty_log(df, row_id)
    staged, numbered = _staged(df, edits)
    entries = ", ".join(
        f"CASE WHEN {edit.changed} THEN named_struct('column', {literal(edit.column)}, "
        f"'original_value', {edit.original}, 'cleaned_value', {edit.cleaned}, "
        f"'reason', {edit.reason}) END"
        for edit in numbered
    )
    return (
        staged.select(
            ref(row_id).alias("row_id"), F.expr(f"explode(array({entries}))").alias("entry")
        )
        .where("entry IS NOT NULL")
        .select("row_id", "entry.*")
    )


def removal_log(rows: DataFrame, row_id: str, what: str, reason: str) -> DataFrame:
    """One log row for each removed row."""
    return rows.select(
        ref(row_id).alias("row_id"),
        F.expr(f"'{WHOLE_ROW}' AS `column`"),
        F.expr(f"{literal(what)} AS original_value"),
        F.expr(f"'{REMOVED}' AS cleaned_value"),
        F.expr(f"{literal(reason)} AS reason"),
    )


def empty_log(df: DataFrame, row_id: str) -> DataFrame:
    return removal_log(df.where("false"), row_id, "", "")


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, logs)


def cells_differ(before: str, before_type: T.DataType, after: str, after_type: T.DataType) -> str:
    """Whether a cell changed. Missing to missing is no change, and neither is 1 to 1.0.

    `before` is SQL text, `after` a column name.
    """
    old = f"nanvl({before}, NULL)" if is_float(before_type) else before
    new = known(after, after_type)
    if before_type == after_type or (is_numeric(before_type) and is_numeric(after_type)):
        return f"NOT ({old} <=> {new})"
    return f"({old} IS NOT NULL OR {new} IS NOT NULL)"


def any_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    types = column_types(df.schema)
    return F.expr(" OR ".join(is_missing(name, types[name]) for name in columns) or "false")


def known_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as grouping keys: missing values are one key."""
    types = column_types(df.schema)
    return [F.expr(f"{known(name, types[name])} AS {quoted(name)}") for name in columns]
