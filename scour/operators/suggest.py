"""Rule-based fix suggestions from evidence in the data.

Each issue gets one outcome: `SAFE_FIX` (an operation that is safe to apply), `MIXED_NUMERIC`
(remove the unit first), `STANDARDIZATION_AVAILABLE` (pick a target unit) or `REVIEW_REQUIRED`.
An outside proposal can be passed as a hint; evidence overrules it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions import units
from scour.functions.missing import as_text
from scour.functions.numbers import is_number
from scour.functions.text import STANDARDIZE_STYLES
from scour.operators import profile
from scour.operators.profile import (
    DATE_INCONSISTENCY,
    DUPLICATE_ROWS,
    EMBEDDED_UNITS,
    HAS_DATE_ISSUE,
    HAS_UNIT_ISSUE,
    ISSUE_TYPES,
    MISSING_VALUES,
    MIXED_NUMERIC,
    STYLES,
    TEXT_INCONSISTENCY,
    inline_rows,
)
from scour.schema import column_types, data_columns, is_numeric, is_text, literal
from scour.streaming.guards import require_batch

# The outcome types.
SAFE_FIX = "SAFE_FIX"
REVIEW = "REVIEW_REQUIRED"
MIXED = "MIXED_NUMERIC"
STANDARDIZE = "STANDARDIZATION_AVAILABLE"
HANDLED_BY_MISSING = (
    "Review required: resolved as part of the missing-value issue of the same column."
)


def _outcome(
    resolution: str,
    operation: str | None = None,
    parameter: str = "NULL",
    message: str = "NULL",
    targets: str = "NULL",
    detected: str = "NULL",
) -> str:
    """SQL text of one outcome; all but the first two arguments are SQL text themselves."""
    shown = "NULL" if operation is None else literal(operation)
    return (
        f"named_struct('resolution_type', {literal(resolution)}, "
        f"'operation', CAST({shown} AS STRING), 'parameter', CAST({parameter} AS STRING), "
        f"'message', CAST({message} AS STRING), "
        f"'available_targets', CAST({targets} AS ARRAY<STRING>), "
        f"'detected_units', CAST({detected} AS ARRAY<STRING>))"
    )


def _review(message: str) -> str:
    return _outcome(REVIEW, message=literal(message))


def _choose(*branches: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {result}" for test, result in branches) + " END"


class _Hints:
    """Outside proposals: `{(issue type, column): {"operation": …, "parameters": {…}}}`."""

    def __init__(self, hints: Mapping | None, kind: str):
        self.entries = {
            column: hint for (issue, column), hint in (hints or {}).items() if issue == kind
        }

    def _lookup(self, read: Callable) -> str:
        """SQL text of `read(hint)` for the row's column, NULL without a hint."""
        found = {column: read(hint) for column, hint in self.entries.items()}
        cases = " ".join(
            f"WHEN column <=> {'NULL' if column is None else literal(column)} "
            f"THEN {literal(value)}"
            for column, value in found.items()
            if value is not None
        )
        return f"CASE {cases} END" if cases else "CAST(NULL AS STRING)"

    def operation(self) -> str:
        return self._lookup(lambda hint: hint.get("operation"))

    def parameter(self, name: str) -> str:
        return self._lookup(lambda hint: (hint.get("parameters") or {}).get(name))


# --- evidence ------------------------------------------------------------------------------------

# All, none or some of the present values are numbers.
CLASSIFICATION = _choose(
    ("present = 0", "'ambiguous'"),
    ("numbers = present", "'numeric'"),
    ("numbers = 0", "'categorical'"),
    ("true", "'ambiguous'"),
)


def classify_columns(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row per column: present values, how many are numbers, and the class; one aggregate."""
    require_batch(df, "classify_columns")
    types = column_types(df.schema)
    tallies, rows = [], []
    for i, name in enumerate(data_columns(df, row_id)):
        value, dtype = as_text(name, types[name]), types[name]
        numeric = is_number(value) if is_text(dtype) else str(is_numeric(dtype))
        tallies += [
            F.expr(f"count({value}) AS p{i}"),
            F.expr(f"count_if({value} IS NOT NULL AND {numeric}) AS n{i}"),
        ]
        rows.append(
            f"named_struct('column', {literal(name)}, 'present', p{i}, 'numbers', n{i})"
        )
    return inline_rows(df.agg(*tallies), rows).selectExpr(
        "*", f"{CLASSIFICATION} AS classification"
    )


def _column_table(df: DataFrame, row_id: str | None, counts: DataFrame) -> DataFrame:
    """One row per column that has cells: missing ones for all, the evidence of text columns."""
    types = column_types(df.schema)
    numeric = [literal(name) for name in data_columns(df, row_id) if is_numeric(types[name])]
    is_number_column = f"column IN ({', '.join(numeric)})" if numeric else "false"
    found = profile.text_evidence(counts).unionByName(
        profile.gaps_of_other_columns(df, row_id), allowMissingColumns=True
    )
    filled = found.withColumns(
        {
            "numbers": F.expr(
                f"coalesce(numbers, CASE WHEN {is_number_column} THEN present ELSE 0 END)"
            ),
            "with_unit": F.expr("coalesce(with_unit, 0)"),
            "one_unit": F.expr("coalesce(one_unit, false)"),
        }
    )
    return filled.selectExpr(
        "*",
        f"{CLASSIFICATION} AS classification",
        f"coalesce({MIXED_NUMERIC}, false) AS mixed_numeric",
    )


def _spelling_table(counts: DataFrame) -> DataFrame:
    """One row per text column with inconsistent spellings."""
    return (
        profile.spelling_groups(counts)
        .groupBy("column")
        .agg(F.expr("bool_and(stripped_alike) AS only_white_space"))
        .selectExpr("*", "false AS single_spelling")
    )


# --- one rule set per issue type, as SQL text over the evidence row ---------------------------------


def missing_outcome(hints: Mapping | None = None) -> str:
    strategy = _Hints(hints, MISSING_VALUES).parameter("strategy")
    message = (
        "concat('Some values carry ', first_unit, ', the others are plain numbers. "
        "Standardize numeric representation first?')"
    )
    return _choose(
        (
            "classification = 'numeric'",
            _outcome(SAFE_FIX, "fill_numeric", f"coalesce({strategy}, 'median')"),
        ),
        (
            "classification = 'categorical'",
            _outcome(SAFE_FIX, "fill_categorical", f"coalesce({strategy}, 'mode')"),
        ),
        ("mixed_numeric", _outcome(MIXED, "remove_units", "first_unit", message)),
        ("true", _review("Review required: numbers and other text are mixed in this column.")),
    )


def duplicates_outcome(hints: Mapping | None = None) -> str:
    proposed = _Hints(hints, DUPLICATE_ROWS).operation()
    return _choose(
        (
            f"{proposed} <> 'remove_duplicates'",
            _review("Review required: the proposal does not fit duplicate rows."),
        ),
        ("true", _outcome(SAFE_FIX, "remove_duplicates")),
    )


def text_outcome(hints: Mapping | None = None) -> str:
    """White space only, then the hint, then a style with half of the votes and more than others."""
    hint = _Hints(hints, TEXT_INCONSISTENCY)
    allowed = ", ".join(map(literal, STANDARDIZE_STYLES))
    total = " + ".join(f"style_{style}" for style in STYLES)
    votes = []
    for style in STYLES:
        more = [f"style_{style} > style_{other}" for other in STYLES if other != style]
        votes.append((" AND ".join([f"2 * style_{style} >= {total}", *more]), literal(style)))
    style = _choose(
        ("only_white_space", "'strip'"),
        (
            f"{hint.operation()} = 'standardize_text' AND {hint.parameter('style')} IN ({allowed})",
            hint.parameter("style"),
        ),
        *votes,
    )
    return _choose(
        (
            "single_spelling",
            _review("Review required: the values differ in more than their spelling."),
        ),
        (f"({style}) IS NOT NULL", _outcome(SAFE_FIX, "standardize_text", style)),
        ("true", _review("Review required: no casing is dominant enough.")),
    )


def units_outcome(hints: Mapping | None = None) -> str:
    hint = _Hints(hints, EMBEDDED_UNITS)
    targets = _choose(
        *[
            (f"categories[0] = '{category}'", f"array({', '.join(map(literal, factors))})")
            for category, factors in units.UNIT_FACTORS.items()
        ]
    )
    conflict = (
        "concat('Review required: the units belong to different categories: ', "
        "array_join(categories, ', '), '.')"
    )
    mixed_message = "concat('Some values carry ', first_unit, ', the others are plain numbers.')"
    contradicts = (
        f"{hint.operation()} IS NOT NULL AND ({hint.operation()} <> 'remove_units' "
        f"OR NOT ({hint.parameter('unit')} <=> first_unit))"
    )
    return _choose(
        ("with_unit = 0", _review("Review required: no unit was found.")),
        (
            "present > with_unit AND plain_numbers <> present - with_unit",
            _review("Review required: inconsistent text mixed with numbers."),
        ),
        (
            "present > with_unit AND NOT one_unit",
            _review("Review required: plain numbers mixed with several units."),
        ),
        ("present > with_unit AND missing > 0", _review(HANDLED_BY_MISSING)),
        ("present > with_unit", _outcome(MIXED, "remove_units", "first_unit", mixed_message)),
        (
            f"NOT one_unit AND size(categories) = 1 AND categories[0] <> '{units.UNKNOWN_CATEGORY}'",
            _outcome(STANDARDIZE, "standardize_units", targets=targets, detected="known_units"),
        ),
        ("NOT one_unit", _outcome(REVIEW, message=conflict)),
        (contradicts, _review("Review required: the proposal contradicts the unit in the data.")),
        ("true", _outcome(SAFE_FIX, "remove_units", "first_unit")),
    )


def dates_outcome() -> str:
    return _review("Review required: several date notations; the user has to choose the target.")


# --- public operators ------------------------------------------------------------------------------


def _entry(kind: str, outcome: str) -> str:
    return (
        f"named_struct('issue_rank', {ISSUE_TYPES.index(kind) + 1}, 'type', '{kind}', "
        f"'column', CAST(column AS STRING), 'outcome', {outcome})"
    )


def _report(rows: DataFrame, *entries: str) -> DataFrame:
    """The entries of every row that are not NULL, flat."""
    return (
        rows.selectExpr(f"explode(array({', '.join(entries)})) AS entry")
        .where("entry IS NOT NULL")
        .select("entry.*")
        .select("issue_rank", "type", "column", "outcome.*")
    )


def suggest_missing(
    df: DataFrame, row_id: str | None = "row_id", hints: Mapping | None = None
) -> DataFrame:
    """For each column with missing cells: fill it, remove its unit first, or review."""
    require_batch(df, "suggest_missing")
    rows = _column_table(df, row_id, profile.text_counts(df, row_id)).where("missing > 0")
    return _report(rows, _entry(MISSING_VALUES, missing_outcome(hints)))


def suggest_duplicates(
    df: DataFrame, row_id: str | None = "row_id", hints: Mapping | None = None
) -> DataFrame:
    require_batch(df, "suggest_duplicates")
    rows = profile.duplicate_count(df, row_id).where("duplicate_rows > 0")
    rows = rows.selectExpr("*", "CAST(NULL AS STRING) AS column")
    return _report(rows, _entry(DUPLICATE_ROWS, duplicates_outcome(hints)))


def suggest_text_style(
    df: DataFrame,
    row_id: str | None = "row_id",
    hints: Mapping | None = None,
    variants: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """For each column with several spellings of a value: the style to use, or review.

    `variants` replaces the spellings found in the data by the caller's own per column.
    """
    require_batch(df, "suggest_text_style")
    counts = profile.shared_counts(df, row_id)
    votes = profile.text_evidence(counts).select("column", *[f"style_{s}" for s in STYLES])
    if variants is None:
        groups = _spelling_table(counts)
    else:
        judged = [_judge_variants(name, given) for name, given in variants.items()]
        groups = inline_rows(df.sparkSession.range(1), judged)
    # One row per text column.
    rows = groups.join(F.broadcast(votes), "column")
    return _report(rows, _entry(TEXT_INCONSISTENCY, text_outcome(hints)))


def _judge_variants(column: str, given: Sequence[str]) -> str:
    groups: dict[str, set[str]] = {}
    for variant in given:
        groups.setdefault(variant.strip().lower(), set()).add(variant)
    stripped = {variant.strip() for variant in given}
    return (
        f"named_struct('column', {literal(column)}, "
        f"'only_white_space', {len(stripped) == len(groups)}, "
        f"'single_spelling', {any(len(group) == 1 for group in groups.values())})"
    )


def suggest_units(
    df: DataFrame,
    row_id: str | None = "row_id",
    hints: Mapping | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """For each column with an embedded-unit issue, or for the named columns without asking."""
    require_batch(df, "suggest_units")
    evidence = profile.text_evidence(profile.text_counts(df, row_id))
    if columns is None:
        rows = evidence.where(HAS_UNIT_ISSUE)
    else:
        rows = evidence.where(F.col("column").isin(*columns))
    return _report(rows, _entry(EMBEDDED_UNITS, units_outcome(hints)))


def suggest_dates(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    return _report(profile.date_formats(df, row_id), _entry(DATE_INCONSISTENCY, dates_outcome()))


def suggest(
    df: DataFrame, row_id: str | None = "row_id", hints: Mapping | None = None
) -> DataFrame:
    """One row per issue of the table with its outcome.

    All outcomes about columns are read off one table with a row per column, so the evidence is
    aggregated once.
    """
    require_batch(df, "suggest")
    counts = profile.shared_counts(df, row_id)
    # One row per text column.
    rows = _column_table(df, row_id, counts).join(
        F.broadcast(_spelling_table(counts)), "column", "left"
    )
    about_columns = _report(
        rows,
        _choose(("missing > 0", _entry(MISSING_VALUES, missing_outcome(hints)))),
        _choose(
            ("only_white_space IS NOT NULL", _entry(TEXT_INCONSISTENCY, text_outcome(hints)))
        ),
        _choose((HAS_DATE_ISSUE, _entry(DATE_INCONSISTENCY, dates_outcome()))),
        _choose((HAS_UNIT_ISSUE, _entry(EMBEDDED_UNITS, units_outcome(hints)))),
    )
    return about_columns.unionByName(suggest_duplicates(df, row_id, hints))
