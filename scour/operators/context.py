"""The dataset context: one row per column with statistics, a hint, and a semantic role.

Everything comes from one `value_counts` pass; the per-column results are joined to the schema
facts, which hold one row per column of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import dates
from scour.functions.missing import as_text, is_missing, known
from scour.functions.text import matches, strip
from scour.operators.profile import inline_rows, value_counts, weighted
from scour.schema import (
    column_types,
    data_columns,
    is_integral,
    is_numeric,
    is_temporal,
    is_text,
    literal,
    quoted,
)
from scour.streaming.guards import require_batch

MAX_CATEGORIES = 20
SHOWN_CATEGORIES = 10
CONTEXT_DATE_SHARE = 0.95

# Parts of a column name that point to a role, and value patterns.
NAME_PARTS = {
    "identifier": ("id", "uuid", "guid", "index"),
    "date": ("date", "time", "timestamp", "created", "updated"),
    "phone": ("phone", "mobile", "tel", "contact"),
    "age": ("age", "years"),
    "money": (
        "price", "cost", "revenue", "salary", "amount", "total", "tax", "fee", "balance",
    ),
    "percentage": ("percent", "rate", "ratio", "margin"),
    "text": ("name", "title", "description", "text", "comment", "address"),
    "boolean": ("is_", "has_", "flag"),
    "category": (
        "category", "type", "status", "group", "role", "city", "country", "state", "gender",
        "department", "class",
    ),
}
EMAIL = r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE = r"(?U)^\+?[\d\s\-\(\)]{7,20}$"
TRUTH_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
TRUTH_NUMBERS = ("0", "1", "0.0", "1.0")


def _facts(df: DataFrame, names: list[str]) -> DataFrame:
    types = column_types(df.schema)
    rows = []
    for position, name in enumerate(names):
        dtype = types[name]
        boolean = isinstance(dtype, T.BooleanType)
        rows.append(
            f"named_struct('position', {position}, 'column', {literal(name)}, "
            f"'dtype', '{dtype.simpleString()}', 'is_text', {is_text(dtype)}, "
            f"'is_numeric', {is_numeric(dtype) or boolean}, 'is_integral', {is_integral(dtype)}, "
            f"'is_temporal', {is_temporal(dtype)}, 'is_boolean', {boolean})"
        )
    return inline_rows(df.sparkSession.range(1), rows)


def _of_type(df: DataFrame, names: list[str], test) -> str:
    types = column_types(df.schema)
    chosen = ", ".join(literal(name) for name in names if test(types[name]))
    return f"(column IN ({chosen}))" if chosen else "false"


def _column_stats(df: DataFrame, names: list[str], counts: DataFrame) -> DataFrame:
    """One row per column from its distinct values."""
    words = ", ".join(map(literal, TRUTH_WORDS))
    digits = ", ".join(map(literal, TRUTH_NUMBERS))
    is_text_column = _of_type(df, names, is_text)
    read = counts.selectExpr("*", f"{strip('value')} AS stripped").selectExpr(
        "column",
        "value",
        "n",
        f"CASE WHEN {_of_type(df, names, is_numeric)} THEN try_cast(value AS DOUBLE) END AS number",
        f"CASE WHEN {_of_type(df, names, is_temporal)} THEN try_cast(value AS TIMESTAMP_NTZ) "
        f"WHEN {is_text_column} THEN {dates.parse_date('stripped', day_first=False)} END AS date",
        f"{is_text_column} AND {matches('value', EMAIL)} AS is_email",
        f"{is_text_column} AND {matches('value', PHONE)} AS is_phone",
        f"lower(value) IN ({words}) AS is_truth_word",
        f"value IN ({digits}) AS is_truth_number",
    )
    finite = "CASE WHEN abs(number) < double('Infinity') THEN number END"
    return read.groupBy("column").agg(
        *map(
            F.expr,
            [
                "sum(n) AS rows",
                f"{weighted('value IS NULL')} AS missing",
                "count(value) AS distinct_values",
                # An infinite minimum or maximum is reported as none, not as the next value.
                f"CASE WHEN min(number) = min({finite}) THEN min(number) END AS min_value",
                f"CASE WHEN max(number) = max({finite}) THEN max(number) END AS max_value",
                f"{weighted('date IS NOT NULL')} AS dates",
                "min(date) AS date_min",
                "max(date) AS date_max",
                f"{weighted('is_email')} AS emails",
                f"{weighted('is_phone')} AS phones",
                "count_if(is_truth_word) AS truth_words",
                "count_if(is_truth_number) AS truth_numbers",
            ],
        )
    )


def _stats_table(df: DataFrame, row_id: str | None) -> tuple[DataFrame, DataFrame]:
    """The per-column statistics, also for columns without any row, and the value counts."""
    require_batch(df, "dataset_context")
    names = data_columns(df, row_id)
    counts = value_counts(df, names)
    tallies = (
        "rows", "missing", "distinct_values", "dates", "emails", "phones", "truth_words",
        "truth_numbers",
    )
    # One row per column of the table on either side.
    joined = _facts(df, names).join(F.broadcast(_column_stats(df, names, counts)), "column", "left")
    filled = joined.withColumns({name: F.expr(f"coalesce({name}, 0)") for name in tallies})
    # Text columns are dates only if more than 95 % of the present values parse.
    is_date = (
        "(is_temporal AND rows > missing) "
        f"OR (is_text AND dates > {CONTEXT_DATE_SHARE}D * (rows - missing))"
    )
    stats = filled.selectExpr(
        *[name for name in filled.columns if name not in ("date_min", "date_max")],
        "rows - missing AS present",
        "CASE WHEN rows > 0 THEN missing / rows ELSE 0D END AS missing_fraction",
        f"({is_date}) AS is_date",
        f"CASE WHEN {is_date} THEN date_min END AS date_min",
        f"CASE WHEN {is_date} THEN date_max END AS date_max",
    )
    return stats, counts


# The hint of a column; more than one may apply, the first listed wins.
HINT = f"""CASE
    WHEN is_boolean THEN 'Likely Boolean'
    WHEN is_date OR is_temporal THEN 'Likely Date'
    WHEN is_text AND distinct_values > 0 AND distinct_values < {MAX_CATEGORIES}
        THEN 'Likely Categorical'
    WHEN is_numeric AND rows > 0 AND distinct_values = rows THEN 'Likely Identifier' END"""


def _named(kind: str) -> str:
    return matches("lower(column)", "|".join(NAME_PARTS[kind]))


_UNIQUE = "(rows > 1 AND distinct_values = rows)"
_PHONES = "(is_text AND phones > 0.8D * present)"
_TWO_TRUTHS = (
    "(is_boolean OR (is_numeric AND truth_numbers = 2) "
    "OR (is_text AND truth_words = distinct_values))"
)
# Condition, role, confidence, evidence; the first condition that holds decides.
ROLES = (
    ("present = 0", "unknown", "low", "no present values"),
    (f"{_UNIQUE} AND {_named('identifier')}",
     "identifier", "high", "every value is unique, identifier-like name"),
    (f"is_date AND {_named('date')}", "date/datetime", "high", "values are dates, date-like name"),
    ("is_date", "date/datetime", "medium", "values are dates"),
    ("is_text AND emails > 0.9D * present",
     "email", "high", "more than 90 % look like email addresses"),
    (f"{_PHONES} AND {_named('phone')}",
     "phone", "high", "more than 80 % look like phone numbers, phone-like name"),
    (_PHONES, "phone", "medium", "more than 80 % look like phone numbers"),
    (f"is_numeric AND {_named('age')} AND min_value >= 0 AND max_value <= 120",
     "age", "high", "age-like name, values from 0 to 120"),
    (f"is_numeric AND {_named('age')}", "age", "medium", "age-like name, unusual range"),
    (f"is_numeric AND {_named('money')}",
     "monetary/numeric amount", "high", "numeric with amount-like name"),
    (f"is_numeric AND {_named('percentage')}",
     "percentage", "high", "numeric with rate-like name"),
    (f"is_text AND {_named('text')}", "name/text", "high", "text with name-like name"),
    (f"distinct_values = 2 AND ({_named('boolean')} OR {_TWO_TRUTHS})",
     "boolean/binary", "high", "two values with a binary name or meaning"),
    (f"distinct_values < {MAX_CATEGORIES} AND distinct_values < rows AND {_named('category')}",
     "categorical", "high", "few values, category-like name"),
    (f"{_UNIQUE} AND (is_integral OR is_text)",
     "identifier", "medium", "every value is unique"),
    ("is_numeric", "numeric", "low", "numeric without a more specific sign"),
    ("true", "unknown", "low", "no sign of a specific role"),
)
ROLE = "CASE " + " ".join(
    f"WHEN {test} THEN named_struct('role', {literal(name)}, 'confidence', {literal(confidence)}, "
    f"'evidence', {literal(evidence)})"
    for test, name, confidence, evidence in ROLES
) + " END"


def _top_categories(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """The most frequent values of the columns with few values; at most 19 rows per column."""
    few = stats.where(
        f"is_text AND NOT is_date AND distinct_values BETWEEN 1 AND {MAX_CATEGORIES - 1}"
    ).select("column")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    # Neither a filter on the key nor a semi-join: both would be pushed below the grouping and give
    # it a scan of its own.
    return (
        counts.join(F.broadcast(few), "column")
        .where("NOT (value IS NULL AND n > 0)")
        .withColumn("place", F.row_number().over(order))
        .where(f"place <= {SHOWN_CATEGORIES}")
        .groupBy("column")
        .agg(F.expr("array_sort(collect_list(struct(place, value))).value AS top_categories"))
    )


_STATISTICS = (
    "position", "column", "dtype", "rows", "missing", "missing_fraction", "distinct_values",
    "min_value", "max_value", "date_min", "date_max",
)


def column_statistics(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Rows, missing cells and fraction, distinct values, number and date range per column."""
    return _stats_table(df, row_id)[0].select(*_STATISTICS)


def _range_struct(name: str, dtype: T.DataType, position: int) -> str:
    """One column's ranges as a struct of aggregates; `n<i>`, `d<i>` are its number and date."""
    number, date = f"n{position}", f"d{position}"
    finite = f"CASE WHEN abs({number}) < double('Infinity') THEN {number} END"
    if is_temporal(dtype):
        is_date = f"count({date}) > 0"
    else:
        is_date = f"count({date}) > {CONTEXT_DATE_SHARE}D * count_if(NOT m{position})"
    missing = f"count_if(m{position})"
    return (
        f"named_struct('position', {position}, 'column', {literal(name)}, "
        f"'dtype', '{dtype.simpleString()}', 'rows', count(1), 'missing', {missing}, "
        f"'missing_fraction', CASE WHEN count(1) > 0 THEN {missing} / count(1) ELSE 0D END, "
        f"'min_value', CASE WHEN min({number}) = min({finite}) THEN min({number}) END, "
        f"'max_value', CASE WHEN max({number}) = max({finite}) THEN max({number}) END, "
        f"'date_min', CASE WHEN {is_date} THEN min({date}) END, "
        f"'date_max', CASE WHEN {is_date} THEN max({date}) END)"
    )


def column_ranges(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Rows, missing cells and fraction, number and date range per column.

    A plain aggregate: a row a task is all that is shuffled, unlike for `column_statistics`, which
    counts distinct values.
    """
    require_batch(df, "column_ranges")
    types = column_types(df.schema)
    names = data_columns(df, row_id)
    cells = []
    for i, name in enumerate(names):
        dtype = types[name]
        number = f"try_cast({known(name, dtype)} AS DOUBLE)" if is_numeric(dtype) else "CAST(NULL AS DOUBLE)"
        if is_temporal(dtype):
            date = f"CAST({quoted(name)} AS TIMESTAMP_NTZ)"
        elif is_text(dtype):
            date = dates.parse_date(f"s{i}", day_first=False)
        else:
            date = "CAST(NULL AS TIMESTAMP_NTZ)"
        cells.append((f"{is_missing(name, dtype)} AS m{i}", f"{number} AS n{i}", f"{date} AS d{i}"))
    stripped = [
        f"{strip(quoted(name))} AS s{i}" for i, name in enumerate(names) if is_text(types[name])
    ]
    prepared = df.selectExpr(*[quoted(name) for name in names], *stripped).selectExpr(
        *[cell for column in cells for cell in column]
    )
    structs = ", ".join(_range_struct(name, types[name], i) for i, name in enumerate(names))
    return prepared.agg(F.expr(f"array({structs})").alias("found")).select(F.inline("found"))


def column_hints(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    return _stats_table(df, row_id)[0].selectExpr("position", "column", f"{HINT} AS hint")


def column_roles(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    found = _stats_table(df, row_id)[0].selectExpr("position", "column", f"{ROLE} AS found")
    return found.select("position", "column", "found.*")


def top_categories(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    return _top_categories(*_stats_table(df, row_id))


def dataset_context(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """One row per column: statistics, hint, role and top categories."""
    stats, counts = _stats_table(df, row_id)
    described = stats.selectExpr(*_STATISTICS, f"{HINT} AS hint", f"{ROLE} AS found")
    # At most one row per column of the table.
    top = F.broadcast(_top_categories(stats, counts))
    return described.join(top, "column", "left").select(
        *_STATISTICS, "hint", "found.*", "top_categories"
    )


VALUE_KINDS = ("text", "number", "date")


def find_value_columns(
    df: DataFrame, value, kind: str = "text", row_id: str | None = "row_id"
) -> DataFrame:
    """Which columns a value may belong to: `(position, column)`.

    Text must occur in the column, a number must lie in the range of a numeric column, and a date
    fits every column with a date role.
    """
    require_batch(df, "find_value_columns")
    if kind not in VALUE_KINDS:
        raise ValueError(f"Unknown kind {kind!r}; use one of {', '.join(VALUE_KINDS)}")
    if kind == "date":
        roles = column_roles(df, row_id).where("role = 'date/datetime'")
        return roles.select("position", "column")
    types = column_types(df.schema)
    names = data_columns(df, row_id)
    tests = {}
    for position, name in enumerate(names):
        if kind == "text":
            tests[position] = f"bool_or({as_text(name, types[name])} = {literal(str(value))})"
        elif is_numeric(types[name]):
            number = f"CAST({known(name, types[name])} AS DOUBLE)"
            tests[position] = f"double('{float(value)!r}') BETWEEN min({number}) AND max({number})"
    if not tests:
        raise ValueError("The table has no column of this kind")
    rows = [
        f"named_struct('position', {i}, 'column', {literal(names[i])}, 'found', f{i})" for i in tests
    ]
    found = df.agg(*[F.expr(f"{test} AS f{i}") for i, test in tests.items()])
    return inline_rows(found, rows).where("found").select("position", "column")
