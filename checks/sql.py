"""Pieces of oracle SQL."""

from __future__ import annotations

# Fixed values, written out: an error in the library's own must show.
DATE_FORMATS = {
    "DD/MM/YYYY or MM/DD/YYYY": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "DD/MM/YY or MM/DD/YY": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$",
    "DD-MM-YYYY or MM-DD-YYYY": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "YYYY-MM-DD": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "Month DD, YYYY": r"^[A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4}$",
}
EMAIL = r"^[\pL\pN_.-]+@[\pL\pN_.-]+\.[\pL\pN_]+$"
PHONE = r"^\+?[0-9\s()-]{7,20}$"
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


def parsed(value: str, day_first: bool = True) -> str:
    """The date grammar for the notations that occur in the views."""
    orders = ("%d{0}%m{0}%Y", "%m{0}%d{0}%Y") if day_first else ("%m{0}%d{0}%Y", "%d{0}%m{0}%Y")
    formats = ["%Y-%m-%d", *[o.format(sep) for sep in "/-" for o in orders]]
    return "coalesce(" + ", ".join(f"try_strptime({value}, '{f}')" for f in formats) + ")"


def notation(value: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(trim({value}), '{pattern}') THEN '{name}'"
        for name, pattern in DATE_FORMATS.items()
    )
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE 'Unknown' END"


def title(value: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({value}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


QUANTITY = r"^([-+]?[0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)$"
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def unit(value: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({value}), '{QUANTITY}') "
        f"THEN lower(regexp_extract(trim({value}), '{QUANTITY}', 2)) END"
    )


def number_of(value: str) -> str:
    return f"CAST(regexp_extract(trim({value}), '{QUANTITY}', 1) AS DOUBLE)"


def plain(number: str) -> str:
    """A double as text, integral values without a fraction, at most six decimals."""
    return (
        f"CASE WHEN {number} = floor({number}) THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST(round({number}, 6) AS VARCHAR) END"
    )


def category(unit_sql: str) -> str:
    return (
        f"CASE WHEN {unit_sql} IN ('mg', 'g', 'kg', 'tonne') THEN 'Mass' "
        f"WHEN {unit_sql} IN ('mm', 'cm', 'm', 'km') THEN 'Length' "
        f"WHEN {unit_sql} IN ('ml', 'l') THEN 'Volume' "
        f"WHEN {unit_sql} IN ('ms', 'sec', 'min', 'hour', 'day') THEN 'Time' "
        f"WHEN {unit_sql} IS NOT NULL THEN 'Unknown' END"
    )


def value_counts(view: str, columns: list[str], name: str = "vc") -> str:
    """`name AS (…)`: distinct values per column with count and first row."""
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, "
        f"min(row_id) AS first_row FROM {view} GROUP BY 1, 2"
        for c in columns
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def evidence(source: str = "vc", name: str = "ev") -> str:
    """Everything the checks and suggestions read, one row per text column."""
    v = "value"
    u = unit(v)
    return f"""{name}_values AS (
        SELECT *, {u} AS u, {category('(' + u + ')')} AS c, {notation(v)} AS f,
            regexp_matches(value, '{NUMBER}') AS is_number,
            CASE WHEN NOT regexp_matches(value, '[A-Za-z]') THEN NULL
                WHEN trim(value) = {title('trim(value)')} THEN 'title'
                WHEN trim(value) = lower(trim(value)) THEN 'lower'
                WHEN trim(value) = upper(trim(value)) THEN 'upper' END AS style
        FROM {source}
    ), {name} AS (
        SELECT "column",
            coalesce(sum(n) FILTER (value IS NULL), 0) AS missing,
            coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS present,
            coalesce(sum(n) FILTER ({parsed(v)} IS NOT NULL), 0) AS dates,
            coalesce(sum(n) FILTER (is_number), 0) AS numbers,
            coalesce(sum(n) FILTER (u IS NOT NULL), 0) AS with_unit,
            count(*) FILTER (u IS NOT NULL) AS distinct_with_unit,
            coalesce(sum(n) FILTER (u IS NULL AND is_number), 0) AS plain_numbers,
            min(u) AS first_unit,
            count(DISTINCT u) AS units,
            list_sort(list_distinct(list(u) FILTER (c <> 'Unknown'))) AS known_units,
            list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))) AS categories,
            coalesce(sum(n) FILTER (style = 'title'), 0) AS titles,
            coalesce(sum(n) FILTER (style = 'lower'), 0) AS lowers,
            coalesce(sum(n) FILTER (style = 'upper'), 0) AS uppers
        FROM {name}_values GROUP BY 1
    ), {name}_formats AS (
        SELECT "column", list(f ORDER BY seen, f) AS formats FROM (
            SELECT "column", f, min(first_row) AS seen FROM {name}_values
            WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1
    ), {name}_spellings AS (
        SELECT "column", lower(trim(value)) AS k, count(*) AS spellings,
            count(DISTINCT trim(value)) AS stripped
        FROM {source} WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
    )"""


IS_DATE = "(present > 0 AND dates >= 0.8 * present)"
UNIT_ISSUE = "(with_unit > 0 AND NOT (with_unit = present AND units = 1))"
MIXED = (
    "(with_unit > 0 AND present > with_unit AND plain_numbers = present - with_unit AND units = 1)"
)


def context_stats(view: str, columns: dict[str, str], name: str = "st") -> str:
    """Statistics per column; `columns` maps a column to text, int, double or timestamp."""
    parts = []
    for position, (c, kind) in enumerate(columns.items()):
        numeric = kind in ("int", "double")
        date = f"{c}" if kind == "timestamp" else parsed(c, False) if kind == "text" else "NULL"
        as_text = kind == "text"
        dtype = {"text": "string", "int": "bigint", "int32": "int", "timestamp": "timestamp_ntz"}
        email = f"regexp_matches({c}, '{EMAIL}')" if as_text else "false"
        phone = f"regexp_matches({c}, '{PHONE}')" if as_text else "false"
        low = f"CAST(min({c}) AS DOUBLE)" if numeric else "NULL"
        high = f"CAST(max({c}) AS DOUBLE)" if numeric else "NULL"
        truth = (
            f"count(DISTINCT {c}) FILTER ({c} IN (0, 1))" if numeric
            else f"count(DISTINCT {c}) FILTER (lower({c}) IN "
            "('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f'))" if as_text else "0"
        )
        parts.append(
            f"SELECT {position} AS position, '{c}' AS \"column\", "
            f"'{dtype.get(kind, kind)}' AS dtype, '{kind}' AS kind, count(*) AS rows, "
            f"count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, "
            f"{low} AS min_value, {high} AS max_value, count({date}) AS dates, "
            f"CAST(min({date}) AS TIMESTAMP) AS d1, CAST(max({date}) AS TIMESTAMP) AS d2, "
            f"count(*) FILTER ({email}) AS emails, count(*) FILTER ({phone}) AS phones, "
            f"{truth} AS truths FROM {view}"
        )
    union = " UNION ALL ".join(parts)
    return f"""{name}_all AS ({union}), {name} AS (
        SELECT *, rows - missing AS present,
            CASE WHEN rows = 0 THEN 0.0 ELSE missing / rows END AS missing_fraction,
            kind IN ('int', 'double') AS is_numeric, kind = 'text' AS is_text,
            (kind = 'timestamp' AND missing < rows)
                OR (kind = 'text' AND dates > 0.95 * (rows - missing)) AS is_date
        FROM {name}_all)"""


HINT = """CASE WHEN is_date OR kind = 'timestamp' THEN 'Likely Date'
    WHEN is_text AND distinct_values BETWEEN 1 AND 19 THEN 'Likely Categorical'
    WHEN is_numeric AND distinct_values = rows AND rows > 0 THEN 'Likely Identifier' END"""


def _named(kind: str) -> str:
    return f"regexp_matches(lower(\"column\"), '{'|'.join(NAME_PARTS[kind])}')"


def role(output: str) -> str:
    """`output` is role, confidence or evidence."""
    unique = "(distinct_values = rows AND rows > 1)"
    rules = [
        ("present = 0", "unknown", "low",
            "no present values"),
        (f"{unique} AND {_named('identifier')}", "identifier", "high",
            "every value is unique, identifier-like name"),
        (f"is_date AND {_named('date')}", "date/datetime", "high",
            "values are dates, date-like name"),
        ("is_date", "date/datetime", "medium",
            "values are dates"),
        ("is_text AND emails > 0.9 * present", "email", "high",
            "more than 90 % look like email addresses"),
        (f"is_text AND phones > 0.8 * present AND {_named('phone')}", "phone", "high",
            "more than 80 % look like phone numbers, phone-like name"),
        ("is_text AND phones > 0.8 * present", "phone", "medium",
            "more than 80 % look like phone numbers"),
        (f"is_numeric AND {_named('age')} AND min_value >= 0 AND max_value <= 120", "age", "high",
            "age-like name, values from 0 to 120"),
        (f"is_numeric AND {_named('age')}", "age", "medium",
            "age-like name, unusual range"),
        (f"is_numeric AND {_named('money')}", "monetary/numeric amount", "high",
            "numeric with amount-like name"),
        (f"is_numeric AND {_named('percentage')}", "percentage", "high",
            "numeric with rate-like name"),
        (f"is_text AND {_named('text')}", "name/text", "high",
            "text with name-like name"),
        (
            f"distinct_values = 2 AND ({_named('boolean')} OR truths = 2)",
            "boolean/binary", "high",
            "two values with a binary name or meaning",
        ),
        (
            f"distinct_values < 20 AND distinct_values < rows AND {_named('category')}",
            "categorical", "high",
            "few values, category-like name",
        ),
        (f"{unique} AND (kind = 'int' OR is_text)", "identifier", "medium",
            "every value is unique"),
        ("is_numeric", "numeric", "low",
            "numeric without a more specific sign"),
    ]
    index = ("role", "confidence", "evidence").index(output)
    cases = " ".join(f"WHEN {rule[0]} THEN '{rule[index + 1]}'" for rule in rules)
    return f"CASE {cases} ELSE '{('unknown', 'low', 'no sign of a specific role')[index]}' END"
