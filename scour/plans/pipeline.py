"""Pipelines: an ordered list of steps folded over one lazy table.

A step is a dict with the key `op`:

* `{"op": "filter", "condition": …, "remove": False}`
* `{"op": "sort", "by": [...], "ascending": [...]}`
* `{"op": "drop_duplicates", "subset": [...]}`
* `{"op": "mutate", "column": …, "expression": …}`
* `{"op": "normalize_text", "style": …, "columns": [...]}`
* `{"op": "select", "columns": [...]}` and `{"op": "drop", "columns": [...]}`
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.functions.arithmetic import build_expression, expression_errors
from scour.functions.missing import known
from scour.functions.predicates import build_condition, check_condition, condition_columns
from scour.functions.text import NORMALIZE_STYLES
from scour.operators.columns import ALL_TEXT, normalize_text
from scour.operators.dedup import drop_duplicates, remove_duplicates
from scour.operators.rows import sort_keys
from scour.plans.impact import ORIGINALS, impact
from scour.schema import column_types, data_columns, ref, require_row_id, text_columns
from scour.streaming.guards import require_batch

# Each step kind with the fields it must have.
STEP_FIELDS = {
    "filter": ("condition",),
    "sort": ("by",),
    "drop_duplicates": (),
    "mutate": ("column", "expression"),
    "normalize_text": ("style",),
    "select": ("columns",),
    "drop": ("columns",),
}
WHOLE_TABLE_STEPS = ("sort", "drop_duplicates")
_HIDDEN = "__order"


class PipelineResult(NamedTuple):
    """Two lazy tables."""

    data: DataFrame
    impact: DataFrame


def check_steps(steps: Sequence[Mapping]) -> None:
    """Raise ValueError unless every step has the right shape, whatever the table."""
    for step in steps:
        kind = step.get("op")
        if kind not in STEP_FIELDS:
            raise ValueError(f"Unknown pipeline step {kind!r}; use one of {', '.join(STEP_FIELDS)}")
        for field in STEP_FIELDS[kind]:
            if step.get(field) is None:
                raise ValueError(f"Step {kind!r} needs {field!r}")
        if kind == "filter":
            check_condition(step["condition"])
        if kind == "sort":
            ascending = step.get("ascending")
            if ascending is not None and len(ascending) != len(step["by"]):
                raise ValueError("'ascending' needs one entry per sort column")
        if kind == "normalize_text" and step["style"] not in NORMALIZE_STYLES:
            raise ValueError(f"Unknown text style {step['style']!r}")


def column_errors(steps: Sequence[Mapping], columns: Sequence[str]) -> list[str]:
    """Every reference to a column that does not exist at that point of the pipeline."""
    errors, current = [], list(columns)
    for position, step in enumerate(steps):
        kind = step["op"]
        used: Sequence[str] = ()
        if kind == "filter":
            used = condition_columns(step["condition"])
        elif kind == "sort":
            used = step["by"]
        elif kind == "drop_duplicates":
            used = step.get("subset") or ()
        elif kind in ("select", "drop"):
            used = step["columns"]
        elif kind == "normalize_text" and isinstance(step.get("columns"), (list, tuple)):
            used = step["columns"]
        elif kind == "mutate":
            found = expression_errors(step["expression"], current)
            errors += [f"Step {position} ({kind}): {error}" for error in found]
        unknown = [name for name in used if name not in current]
        errors += [f"Step {position} ({kind}): column {name!r} does not exist" for name in unknown]
        if kind == "mutate" and step["column"] not in current:
            current.append(step["column"])
        elif kind == "select" and not unknown:
            current = list(step["columns"])
        elif kind == "drop" and not unknown:
            current = [name for name in current if name not in step["columns"]]
    return errors


def check_pipeline(steps: Sequence[Mapping], columns: Sequence[str]) -> None:
    check_steps(steps)
    errors = column_errors(steps, columns)
    if errors:
        raise ValueError("; ".join(errors))


def touched_columns(steps: Sequence[Mapping], df: DataFrame, row_id: str | None) -> list[str]:
    """Source columns that some step writes to; only those can have changed cells."""
    names = data_columns(df, row_id)
    touched: set[str] = set()
    for step in steps:
        if step["op"] == "mutate":
            touched.add(step["column"])
        if step["op"] == "normalize_text":
            chosen = step.get("columns")
            everything = chosen is None or chosen == ALL_TEXT
            touched.update(text_columns(df.schema, names) if everything else chosen)
    return [name for name in names if name in touched]


class _Fold:
    """The table while steps are applied, with the hidden columns it needs.

    Row order only matters to keep-first deduplication and to the final output. A sort step
    therefore records its keys, and one sort at the end puts the rows in order.
    """

    def __init__(self, df: DataFrame, row_id: str | None):
        self.df = df
        self.row_id = row_id
        self.keys: list[tuple[str, bool]] = []

    def hidden(self) -> list[str]:
        kept = [self.row_id] if self.row_id else []
        if ORIGINALS in self.df.columns:
            kept.append(ORIGINALS)
        return kept + [name for name, _ in self.keys]

    def order(self) -> list[Column]:
        keys = [
            ref(name).asc_nulls_last() if up else ref(name).desc_nulls_last()
            for name, up in self.keys
        ]
        return keys + ([ref(self.row_id).asc()] if self.row_id else [])

    def apply(self, step: Mapping) -> None:
        getattr(self, f"_{step['op']}")(step)

    def _filter(self, step: Mapping) -> None:
        keep = build_condition(step["condition"], self.df.schema, for_filter=True)
        self.df = self.df.where(~keep if step.get("remove") else keep)

    def _sort(self, step: Mapping) -> None:
        sort_keys(self.df, step["by"], step.get("ascending"))
        types = column_types(self.df.schema)
        directions = step.get("ascending") or [True] * len(step["by"])
        start = len(self.keys)
        new = []
        for i, (name, up) in enumerate(zip(step["by"], directions)):
            alias = f"{_HIDDEN}_{start + i}"
            # A copy, because later steps may overwrite or drop the sort column.
            self.df = self.df.withColumn(alias, F.expr(known(name, types[name])))
            new.append((alias, up))
        self.keys = new + self.keys

    def _drop_duplicates(self, step: Mapping) -> None:
        hidden = self.hidden()
        names = [name for name in self.df.columns if name not in hidden]
        subset = step.get("subset") or names
        if not self.order():
            raise ValueError("drop_duplicates needs a row identity column to keep the first row")
        if set(subset) == set(names) and hidden == [self.row_id]:
            self.df = remove_duplicates(self.df, self.row_id)
        else:
            self.df = drop_duplicates(self.df, subset, self.row_id, self.order())

    def _mutate(self, step: Mapping) -> None:
        self.df = self.df.withColumn(
            step["column"], build_expression(step["expression"], self.df.schema)
        )

    def _normalize_text(self, step: Mapping) -> None:
        chosen = step.get("columns")
        if chosen is None or chosen == ALL_TEXT:
            hidden = self.hidden()
            names = [name for name in self.df.columns if name not in hidden]
            chosen = text_columns(self.df.schema, names)
        self.df = normalize_text(self.df, step["style"], chosen, self.row_id)

    def _select(self, step: Mapping) -> None:
        kept = [name for name in self.hidden() if name not in step["columns"]]
        self.df = self.df.select(*map(ref, [*kept, *step["columns"]]))

    def _drop(self, step: Mapping) -> None:
        self.df = self.df.drop(*step["columns"])

    def result(self) -> DataFrame:
        """The rows in final order without hidden columns (the row identity stays)."""
        df = self.df.orderBy(*self.order()) if self.keys else self.df
        drop = [name for name in self.hidden() if name != self.row_id]
        return df.drop(*drop) if drop else df


def _fold(df: DataFrame, steps: Sequence[Mapping], row_id: str | None) -> _Fold:
    fold = _Fold(df, row_id)
    for step in steps:
        fold.apply(step)
    return fold


def apply_pipeline(
    df: DataFrame, steps: Sequence[Mapping], row_id: str | None = "row_id"
) -> DataFrame:
    """The table after all steps. Pipelines of row-wise steps also run on a stream."""
    row_id = row_id if row_id in df.columns else None
    check_pipeline(steps, data_columns(df, row_id))
    for step in steps:
        if step["op"] in WHOLE_TABLE_STEPS:
            require_batch(df, step["op"])
    return _fold(df, steps, row_id).result()


def run_pipeline(
    df: DataFrame, steps: Sequence[Mapping], row_id: str = "row_id"
) -> PipelineResult:
    """The table after all steps, and the impact of the pipeline.

    For the impact the touched source columns travel along in a hidden struct, so nothing is joined
    back.
    """
    require_batch(df, "run_pipeline")
    require_row_id(df, row_id, "run_pipeline")
    result = apply_pipeline(df, steps, row_id)
    touched = touched_columns(steps, df, row_id)
    carried = df
    if touched:
        originals = F.struct(*[ref(name).alias(name) for name in touched])
        carried = df.withColumn(ORIGINALS, originals)
    # Order does not matter for the impact: the recorded sort keys only decide which rows stay.
    after = _fold(carried, steps, row_id)
    return PipelineResult(
        result, impact(df, after.df.drop(*[name for name, _ in after.keys]), touched, row_id)
    )
