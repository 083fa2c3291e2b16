"""Profiling and issue detection.

Most checks read one shared table: each distinct value of each column with its count. Regular
expressions and date parsing then run once per distinct value, and a value that fills a third of
the table is one row after the map-side aggregation.

Reports that can grow with the data (spellings, values with units) are long tables, one row per
value, and never arrays gathered in one group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions import dates, numbers, text, units
from scour.functions.missing import as_text, is_missing
from scour.operators.dedup import duplicate_count
from scour.schema import (
    column_types,
    data_columns,
    is_temporal,
    is_text,
    literal,
    quoted,
    ref,
    text_columns,
    unpivot,
)
from scour.sources.staging import stage
from scour.streaming.guards import require_batch

# The issue types in report order.
MISSING_VALUES = "missing_values"
DUPLICATE_ROWS = "duplicate_rows"
TEXT_INCONSISTENCY = "text_inconsistency"
DATE_INCONSISTENCY = "date_format_inconsistency"
EMBEDDED_UNITS = "embedded_units"
ISSUE_TYPES = (
    MISSING_VALUES, DUPLICATE_ROWS, TEXT_INCONSISTENCY, DATE_INCONSISTENCY, EMBEDDED_UNITS
)

DATE_SHARE = 0.8
STYLES = ("title", "lower", "upper")
LETTER = r"\p{L}"
_NOTATIONS = (*dates.DATE_FORMATS, dates.UNKNOWN_FORMAT)


def inline_rows(spark_row: DataFrame, rows: Sequence[str]) -> DataFrame:
    """One-row table to one row per entry; an entry is the SQL text of a struct."""
    return spark_row.select(F.expr(f"inline(array({', '.join(rows)}))"))


def value_counts(df: DataFrame, columns: Sequence[str], row_id: str | None = None) -> DataFrame:
    """`(column, value, n, first_row)`: distinct values as text; missing is one NULL value."""
    require_batch(df, "value_counts")
    types = column_types(df.schema)
    first = quoted(row_id) if row_id is not None else "CAST(NULL AS BIGINT)"
    values = {name: as_text(name, types[name]) for name in columns}
    if not values:
        df, values = df.where("false"), {"": "''"}
    return (
        unpivot(df, values, first_row=first)
        .groupBy("column", "value")
        .agg(F.expr("count(1) AS n"), F.expr("min(first_row) AS first_row"))
    )


# --- table and column reports ----------------------------------------------------------------


def missing_counts(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row per data column: rows and missing cells, from one aggregate."""
    require_batch(df, "missing_counts")
    types = column_types(df.schema)
    names = data_columns(df, row_id)
    if not names:
        columns = "0 AS position, '' AS column, '' AS dtype, 0L AS rows, 0L AS missing"
        return df.sparkSession.sql(f"SELECT {columns}").where("false")
    counts = [
        F.expr(f"count_if({is_missing(name, types[name])}) AS m{i}") for i, name in enumerate(names)
    ]
    rows = [
        f"named_struct('position', {i}, 'column', {literal(name)}, "
        f"'dtype', '{types[name].simpleString()}', 'rows', rows, 'missing', m{i})"
        for i, name in enumerate(names)
    ]
    return inline_rows(df.agg(F.expr("count(1) AS rows"), *counts), rows)


def inspect_columns(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Type, missing cells and missing percentage per column (0 for an empty table)."""
    share = "CASE WHEN rows > 0 THEN missing * 100D / rows ELSE 0D END AS missing_percent"
    return missing_counts(df, row_id).selectExpr("*", share)


def inspect_table(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row: rows, columns, duplicate rows."""
    columns = len(data_columns(df, row_id))
    return duplicate_count(df, row_id).selectExpr("rows", f"{columns} AS columns", "duplicate_rows")


# --- evidence per text column ----------------------------------------------------------------


def weighted(test: str) -> str:
    """Rows (not distinct values) for which the test holds."""
    return f"coalesce(sum(CASE WHEN {test} THEN n END), 0)"


def text_evidence(counts: DataFrame) -> DataFrame:
    """One row per column of a `value_counts` table with everything the checks and suggestions use.

    Units are summed up by their number (none, one, several) and by category, so the buffer stays
    small however many spellings there are.
    """
    # Each step uses the one before several times, so each is a projection of its own.
    stripped = counts.selectExpr(
        "column", "value", "n", "first_row", f"{text.strip('value')} AS stripped"
    )
    read = stripped.selectExpr(
        "column", "value", "n", "first_row", "stripped",
        f"{dates.parse_date('stripped', day_first=True)} IS NOT NULL AS is_date",
        f"{dates.detect_format('stripped')} AS notation",
        f"nullif({units.quantity_unit('stripped')}, '') AS spelled_unit",
        f"{numbers.is_number('stripped')} AS is_number",
        f"{numbers.is_plain_number('stripped')} AS is_plain",
        f"CASE WHEN {text.matches('stripped', LETTER)} THEN {text.title('stripped')} END AS titled",
    )
    judged = read.selectExpr(
        "column", "value", "n", "first_row", "is_date", "notation", "is_number", "is_plain",
        f"{units.normalize_unit('spelled_unit')} AS unit",
        "CASE WHEN titled IS NULL THEN NULL WHEN stripped = titled THEN 'title' "
        "WHEN stripped = lower(stripped) THEN 'lower' "
        "WHEN stripped = upper(stripped) THEN 'upper' END AS style",
    ).selectExpr("*", f"{units.unit_category('unit')} AS category")
    evidence = judged.groupBy("column").agg(
        *map(
            F.expr,
            [
                f"{weighted('value IS NULL')} AS missing",
                f"{weighted('value IS NOT NULL')} AS present",
                "count(value) AS distinct_values",
                f"{weighted('is_date')} AS dates",
                f"{weighted('is_number')} AS numbers",
                f"{weighted('unit IS NOT NULL')} AS with_unit",
                "count(unit) AS distinct_with_unit",
                f"{weighted('unit IS NULL AND is_plain')} AS plain_numbers",
                "min(unit) AS first_unit",
                "max(unit) AS last_unit",
                # Both sets are bounded by the registry, not by the data.
                f"array_sort(collect_set(CASE WHEN category <> '{units.UNKNOWN_CATEGORY}' "
                "THEN unit END)) AS known_units",
                "array_sort(collect_set(category)) AS categories",
                *[f"{weighted(f'style = {literal(s)}')} AS style_{s}" for s in STYLES],
                *[f"bool_or(notation = '{f}') AS has_{i}" for i, f in enumerate(_NOTATIONS)],
                *[
                    f"min(CASE WHEN notation = '{f}' THEN first_row END) AS seen_{i}"
                    for i, f in enumerate(_NOTATIONS)
                ],
            ],
        )
    )

    seen = ", ".join(
        f"CASE WHEN has_{i} THEN struct(seen_{i} AS seen, '{name}' AS name) END"
        for i, name in enumerate(_NOTATIONS)
    )
    return evidence.selectExpr(
        "column", "missing", "present", "distinct_values", "dates", "numbers", "with_unit",
        "distinct_with_unit", "plain_numbers", "first_unit",
        # Reading a set as well keeps the aggregate on hashing: text minima alone mean sorting.
        "coalesce(first_unit = last_unit AND size(categories) = 1, false) AS one_unit",
        "known_units",
        "categories",
        *[f"style_{style}" for style in STYLES],
        # Notations in order of first appearance.
        f"array_sort(array_compact(array({seen}))).name AS formats",
    )


# Conditions over `text_evidence`.
IS_DATE_COLUMN = f"(present > 0 AND dates >= {DATE_SHARE}D * present)"
HAS_DATE_ISSUE = f"({IS_DATE_COLUMN} AND size(formats) > 1)"
# Some cells carry a unit, unless all of them carry the same one.
HAS_UNIT_ISSUE = "(with_unit > 0 AND NOT (with_unit = present AND one_unit))"
# Some values carry the one unit, all others are plain numbers.
MIXED_NUMERIC = (
    "(with_unit > 0 AND present > with_unit AND plain_numbers = present - with_unit AND one_unit)"
)


def text_counts(df: DataFrame, row_id: str | None) -> DataFrame:
    return value_counts(df, text_columns(df.schema, data_columns(df, row_id)), row_id)


def shared_counts(df: DataFrame, row_id: str | None) -> DataFrame:
    """`text_counts`, written once: several branches read them, and each would count again."""
    return stage(text_counts(df, row_id), "value-counts")


def spelling_groups(counts: DataFrame) -> DataFrame:
    """Keys with more than one spelling: `(column, key, spellings, stripped_alike)`."""
    return (
        counts.selectExpr("column", "n", "first_row", f"{text.strip('value')} AS stripped")
        .groupBy("column", "stripped")
        .agg(F.expr("count(1) AS spellings"), F.expr("sum(n) AS n"), F.expr("min(first_row) AS first_row"))
        .groupBy("column", F.expr("lower(stripped) AS key"))
        .agg(
            F.expr("sum(spellings) AS spellings"),
            F.expr("count(1) = 1 AS stripped_alike"),
            F.expr("sum(n) AS n"),
            F.expr("min(first_row) AS first_row"),
        )
        # Missing is a single value, so it never has two spellings.
        .where("spellings > 1")
    )


def text_variants(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Every spelling of every inconsistent value: `(column, key, variant, n)`."""
    counts = shared_counts(df, row_id).where("value IS NOT NULL")
    keyed = counts.selectExpr("column", f"{text.text_key('value')} AS key", "value AS variant", "n")
    inconsistent = spelling_groups(counts).select("column", "key")
    return keyed.join(inconsistent, ["column", "key"], "left_semi")


def date_columns(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Columns of which at least 80 % of the present values are dates, with that share."""
    types = column_types(df.schema)
    found = (
        text_evidence(text_counts(df, row_id))
        .where(IS_DATE_COLUMN)
        .selectExpr("column", "dates / present AS date_share")
    )
    typed = [name for name in data_columns(df, row_id) if is_temporal(types[name])]
    if typed:
        counted = missing_counts(df.select(*map(ref, typed)), None).where("missing < rows")
        found = found.unionByName(counted.selectExpr("column", "1D AS date_share"))
    return found


def date_formats(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Date columns with more than one notation, in order of first appearance."""
    return text_evidence(text_counts(df, row_id)).where(HAS_DATE_ISSUE).select("column", "formats")


def embedded_units(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Columns with an embedded-unit issue and what is known about their units."""
    return (
        text_evidence(text_counts(df, row_id))
        .where(HAS_UNIT_ISSUE)
        .select(
            "column", "present", "with_unit", "distinct_with_unit", "one_unit", "known_units",
            "categories",
        )
    )


def unit_values(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Every distinct value with a unit in the columns that have an issue: `(column, value, n)`."""
    counts = shared_counts(df, row_id)
    columns = text_evidence(counts).where(HAS_UNIT_ISSUE).select("column")
    # The side has at most one row per column of the table.
    return (
        counts.selectExpr("column", f"{text.strip('value')} AS value", "n")
        .where(f"{units.quantity_unit('value')} <> ''")
        .join(F.broadcast(columns), "column", "left_semi")
        .groupBy("column", "value")
        .agg(F.expr("sum(n) AS n"))
    )


# --- issues ------------------------------------------------------------------------------------


def issue_columns(kind: str, column: str, count: str) -> list[str]:
    return [
        f"{ISSUE_TYPES.index(kind) + 1} AS issue_rank",
        f"'{kind}' AS type",
        f"CAST({column} AS STRING) AS column",
        f"CAST({count} AS BIGINT) AS count",
    ]


def analyze_quality(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row per issue: `(issue_rank, type, column, count)`.

    `count` is missing cells, duplicate rows, spellings, date notations, or distinct values with a
    unit. Three scans: one aggregate for the missing cells of columns that hold no text, one grouping
    for the duplicates, and one for the distinct values, which are written when this is called and
    serve the rest.
    """
    require_batch(df, "analyze_quality")
    return _issues(df, row_id, shared_counts(df, row_id))


def gaps_of_other_columns(df: DataFrame, row_id: str | None) -> DataFrame:
    """`(column, missing, present)` for the columns that `text_counts` leaves out.

    The missing cells of text columns are in the counts already, so only the others are read.
    """
    types = column_types(df.schema)
    others = [name for name in data_columns(df, row_id) if not is_text(types[name])]
    return missing_counts(df.select(*map(ref, others)), None).selectExpr(
        "column", "missing", "rows - missing AS present"
    )


def _issues(df: DataFrame, row_id: str | None, counts: DataFrame) -> DataFrame:
    gaps = (
        counts.where("value IS NULL")
        .selectExpr("column", "n AS missing")
        .unionByName(gaps_of_other_columns(df, row_id).select("column", "missing"))
        .where("missing > 0")
        .selectExpr(*issue_columns(MISSING_VALUES, "column", "missing"))
    )
    duplicates = (
        duplicate_count(df, row_id)
        .where("duplicate_rows > 0")
        .selectExpr(*issue_columns(DUPLICATE_ROWS, "NULL", "duplicate_rows"))
    )
    spellings = (
        spelling_groups(counts)
        .groupBy("column")
        .agg(F.expr("sum(spellings) AS spellings"))
        .selectExpr(*issue_columns(TEXT_INCONSISTENCY, "column", "spellings"))
    )
    date_issue = ", ".join(issue_columns(DATE_INCONSISTENCY, "column", "size(formats)"))
    unit_issue = ", ".join(issue_columns(EMBEDDED_UNITS, "column", "distinct_with_unit"))
    others = (
        text_evidence(counts)
        .selectExpr(
            f"explode(array(CASE WHEN {HAS_DATE_ISSUE} THEN struct({date_issue}) END, "
            f"CASE WHEN {HAS_UNIT_ISSUE} THEN struct({unit_issue}) END)) AS issue"
        )
        .where("issue IS NOT NULL")
        .select("issue.*")
    )
    return reduce(DataFrame.unionByName, [gaps, duplicates, spellings, others])


def display_issues(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """The issues without embedded units that go away with the column's missing-value fix.

    That is the case where all other present values are plain numbers, there is one unit, and cells
    are missing.
    """
    counts = shared_counts(df, row_id)
    handled = (
        text_evidence(counts)
        .where(f"{MIXED_NUMERIC} AND missing > 0")
        .selectExpr(f"'{EMBEDDED_UNITS}' AS type", "column")
    )
    # The side has at most one row per column of the table.
    return (
        _issues(df, row_id, counts)
        .join(F.broadcast(handled), ["type", "column"], "left_anti")
        .select("issue_rank", "type", "column", "count")
    )


def profile_report(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row per issue type, in order: how many issues, and their counts added up."""
    rows = [
        f"named_struct('issue_rank', {i + 1}, 'type', '{kind}')" for i, kind in enumerate(ISSUE_TYPES)
    ]
    kinds = inline_rows(df.sparkSession.range(1), rows)
    found = (
        analyze_quality(df, row_id)
        .groupBy("issue_rank")
        .agg(F.expr("count(1) AS issues"), F.expr("sum(count) AS total"))
    )
    # At most five rows.
    return kinds.join(F.broadcast(found), "issue_rank", "left").selectExpr(
        "issue_rank", "type", "coalesce(issues, 0) AS issues", "coalesce(total, 0) AS total"
    )
