"""One query per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scour
from checks import sql
from checks.views import columns_of, table, view, view_sql, with_views
from scour.functions import dates, units
from scour.functions.arithmetic import build_expression
from scour.operators import columns as column_ops
from scour.operators import context, dedup, missing, profile, suggest, uniques
from scour.operators.changes import union_logs
from scour.schema import ref
from scour.sources import csv_files, inference
from scour.sources.staging import scratch_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(name: str, oracle: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        ORACLES[name] = oracle
        return query

    return register


def joined(*names: str) -> list:
    """Arrays as text, so that both engines show them alike."""
    return [F.array_join(name, "|").alias(name) for name in names]


# --- predicates and filter ----------------------------------------------------------------------


def predicate(name: str, condition: dict, where: str, remove: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scour.filter_rows(view(spark, sf_dir, "messy_orders"), condition, remove=remove)

    oracle = with_views(["messy_orders"], f"SELECT * FROM messy_orders WHERE {where}")
    case(name, oracle)(query)


def leaf(operator: str, column: str, value=None) -> dict:
    return {"operator": operator, "column": column, "value": value}


DELIVERED = leaf("equals", "status", "Delivered")
PRICY = leaf("gt", "total_price", 250000)

predicate("pred_equals", DELIVERED, "coalesce(status = 'Delivered', false)")
predicate(
    "pred_not_equals",
    leaf("not_equals", "status", "Delivered"),
    "coalesce(status <> 'Delivered', true)",
)
predicate("pred_gt", PRICY, "coalesce(total_price > 250000, false)")
predicate("pred_gte", leaf("gte", "customer_id", 700), "customer_id >= 700")
predicate("pred_lt", leaf("lt", "total_price", 50000.5), "coalesce(total_price < 50000.5, false)")
predicate(
    "pred_lte",
    # Rows of either kind: customer 100 has orders, so the bound itself is met.
    {
        "operator": "or",
        "conditions": [leaf("lte", "total_price", 50000), leaf("lte", "customer_id", 100)],
    },
    "coalesce(total_price <= 50000, false) OR coalesce(customer_id <= 100, false)",
)
predicate(
    "pred_contains",
    leaf("contains", "status", "DELIV"),
    "coalesce(contains(lower(status), 'deliv'), false)",
)
predicate(
    "pred_starts_with",
    leaf("starts_with", "status", "Deliv"),
    "coalesce(starts_with(status, 'Deliv'), false)",
)
predicate(
    "pred_ends_with",
    leaf("ends_with", "order_date", "-15"),
    "coalesce(ends_with(order_date, '-15'), false)",
)
predicate("pred_is_null", leaf("is_null", "priority"), "priority IS NULL")
predicate("pred_is_not_null", leaf("is_not_null", "priority"), "priority IS NOT NULL")
predicate(
    "pred_in",
    leaf("in", "priority", ["1-URGENT", "2-HIGH", 3]),
    "coalesce(priority IN ('1-URGENT', '2-HIGH'), false)",
)
predicate(
    "pred_not_in",
    leaf("not_in", "priority", ["1-URGENT", "2-HIGH"]),
    "coalesce(priority NOT IN ('1-URGENT', '2-HIGH'), true)",
)


def _poor_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 1000")


@case(
    "pred_in_table",
    with_views(
        ["messy_orders"],
        "SELECT * FROM messy_orders WHERE total_price > 250000 "
        "OR customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)",
    ),
)
def pred_in_table(spark, sf_dir):
    known = leaf("in", "customer_id", _poor_customers(spark, sf_dir).select("c_custkey"))
    condition = {"operator": "or", "conditions": [PRICY, known]}
    return scour.filter_rows(view(spark, sf_dir, "messy_orders"), condition)


@case(
    "pred_not_in_table",
    with_views(
        ["messy_orders"],
        "SELECT * FROM messy_orders WHERE priority IS NULL OR priority NOT IN "
        "(SELECT o_orderpriority FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.99 FROM orders))",
    ),
)
def pred_not_in_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dearest = orders.agg((F.max("o_totalprice") * 0.99).alias("limit"))
    seen = orders.join(F.broadcast(dearest), F.col("o_totalprice") > F.col("limit")).select("o_orderpriority")
    return scour.filter_rows(view(spark, sf_dir, "messy_orders"), leaf("not_in", "priority", seen))


predicate(
    "pred_between",
    leaf("between", "total_price", [100000, 200000]),
    "coalesce(total_price BETWEEN 100000 AND 200000, false)",
)
predicate(
    "pred_and",
    {"operator": "and", "conditions": [DELIVERED, PRICY, leaf("is_not_null", "priority")]},
    "status = 'Delivered' AND total_price > 250000 AND priority IS NOT NULL",
)
predicate(
    "pred_or",
    {"operator": "or", "conditions": [DELIVERED, PRICY]},
    "coalesce(status = 'Delivered', false) OR coalesce(total_price > 250000, false)",
)
predicate(
    "pred_not",
    {"operator": "not", "conditions": [PRICY]},
    "NOT coalesce(total_price > 250000, false)",
)
predicate(
    "op_filter",
    {
        "operator": "and",
        "conditions": [
            {"operator": "not", "conditions": [leaf("contains", "status", "ship")]},
            {"operator": "or", "conditions": [PRICY, leaf("is_null", "total_price")]},
        ],
    },
    "NOT coalesce(contains(lower(status), 'ship'), false) "
    "AND (coalesce(total_price > 250000, false) OR total_price IS NULL)",
)
predicate(
    "op_filter_remove", PRICY, "NOT coalesce(total_price > 250000, false)", remove=True
)

# --- projection, expressions, sort ----------------------------------------------------------------


@case("op_select", with_views(["messy_orders"], "SELECT total_price, row_id FROM messy_orders"))
def op_select(spark, sf_dir):
    return scour.select_columns(view(spark, sf_dir, "messy_orders"), ["total_price", "row_id"])


@case(
    "op_drop",
    with_views(["messy_orders"], "SELECT row_id, customer_id, total_price, priority FROM messy_orders"),
)
def op_drop(spark, sf_dir):
    return scour.drop_columns(view(spark, sf_dir, "messy_orders"), ["status", "order_date"])


@case(
    "op_mutate",
    with_views(
        ["messy_orders"],
        "SELECT * EXCLUDE (total_price), total_price * 1.5 + customer_id AS total_price "
        "FROM messy_orders",
    ),
)
def op_mutate(spark, sf_dir):
    expression = ["+", ["*", "total_price", 1.5], "customer_id"]
    return scour.mutate(view(spark, sf_dir, "messy_orders"), "total_price", expression)


def _expressions(spark, sf_dir, source, expressions):
    df = view(spark, sf_dir, source)
    return df.select(
        "row_id",
        *[build_expression(e, df.schema).alias(name) for name, e in expressions.items()],
    )


@case(
    "expr_arith",
    with_views(
        ["messy_parts"],
        "SELECT row_id, CAST(p_size AS BIGINT) + 7 AS a, CAST(p_size AS BIGINT) - row_id AS b, "
        "p_retailprice * p_size AS c, -CAST(p_size AS BIGINT) AS d, p_retailprice AS e "
        "FROM messy_parts",
    ),
)
def expr_arith(spark, sf_dir):
    return _expressions(
        spark,
        sf_dir,
        "messy_parts",
        {
            "a": ["+", "p_size", 7],
            "b": ["-", "p_size", "row_id"],
            "c": ["*", "p_retailprice", "p_size"],
            "d": ["-", "p_size"],
            "e": ["+", "p_retailprice"],
        },
    )


@case(
    "expr_div",
    with_views(
        ["messy_parts"],
        "SELECT row_id, p_retailprice / p_size AS ratio, "
        "CASE WHEN p_size = 10 THEN CASE WHEN row_id > 500 THEN 'Infinity'::DOUBLE "
        "WHEN row_id < 500 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END "
        "ELSE (row_id - 500)::DOUBLE / (p_size - 10) END AS by_zero FROM messy_parts",
    ),
)
def expr_div(spark, sf_dir):
    return _expressions(
        spark,
        sf_dir,
        "messy_parts",
        {
            "ratio": ["/", "p_retailprice", "p_size"],
            "by_zero": ["/", ["-", "row_id", 500], ["-", "p_size", 10]],
        },
    )


@case(
    "expr_mod",
    with_views(
        ["messy_parts"],
        "SELECT row_id, CAST(((p_size - 20) % 7 + 7) % 7 AS BIGINT) AS m, "
        "CAST(-((((20 - p_size) % 7) + 7) % 7) AS BIGINT) AS negative, "
        "CASE WHEN p_size = 10 THEN 'NaN'::DOUBLE ELSE "
        "((500 - row_id)::DOUBLE - (p_size - 10) * floor((500 - row_id)::DOUBLE / (p_size - 10))) "
        "END AS by_zero FROM messy_parts",
    ),
)
def expr_mod(spark, sf_dir):
    return _expressions(
        spark,
        sf_dir,
        "messy_parts",
        {
            "m": ["%", ["-", "p_size", 20], 7],
            "negative": ["%", ["-", "p_size", 20], -7],
            "by_zero": ["%", ["-", 500, "row_id"], ["-", "p_size", 10]],
        },
    )


@case(
    "op_sort",
    with_views(
        ["messy_orders"],
        "SELECT row_id, status, total_price FROM messy_orders "
        "ORDER BY status NULLS LAST, total_price DESC NULLS LAST, row_id",
    ),
)
def op_sort(spark, sf_dir):
    df = view(spark, sf_dir, "messy_orders").select("row_id", "status", "total_price")
    return scour.sort_rows(df, ["status", "total_price"], [True, False], row_id="row_id")


# --- duplicates and missing values ------------------------------------------------------------------

EVENT_KEYS = ", ".join(columns_of("dup_events"))


@case(
    "op_drop_duplicates_subset",
    with_views(
        ["dup_events"],
        "SELECT * FROM dup_events QUALIFY row_number() OVER "
        "(PARTITION BY event_type, value_bucket ORDER BY row_id) = 1",
    ),
)
def op_drop_duplicates_subset(spark, sf_dir):
    return scour.drop_duplicates(view(spark, sf_dir, "dup_events"), ["event_type", "value_bucket"])


@case(
    "op_remove_duplicates",
    with_views(
        ["dup_events"], f"SELECT min(row_id) AS row_id, {EVENT_KEYS} FROM dup_events GROUP BY ALL"
    ),
)
def op_remove_duplicates(spark, sf_dir):
    return scour.remove_duplicates(view(spark, sf_dir, "dup_events"))


@case(
    "profile_duplicate_count",
    with_views(
        ["dup_events"],
        "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, "
        "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT count(*) AS n FROM dup_events GROUP BY {EVENT_KEYS})",
    ),
)
def profile_duplicate_count(spark, sf_dir):
    return scour.duplicate_count(view(spark, sf_dir, "dup_events"))


ANY_MISSING = "status IS NULL OR total_price IS NULL OR priority IS NULL"


@case(
    "op_drop_missing",
    with_views(["messy_orders"], f"SELECT * FROM messy_orders WHERE NOT ({ANY_MISSING})"),
)
def op_drop_missing(spark, sf_dir):
    return scour.drop_missing(view(spark, sf_dir, "messy_orders"))


@case(
    "op_fill_mean",
    with_views(
        ["messy_orders"],
        "SELECT * EXCLUDE (total_price), round(coalesce(total_price, "
        "(SELECT avg(total_price) FROM messy_orders)), 4) AS total_price FROM messy_orders",
    ),
)
def op_fill_mean(spark, sf_dir):
    filled = scour.fill_numeric(view(spark, sf_dir, "messy_orders"), "mean")
    return filled.withColumn("total_price", F.round("total_price", 4))


@case(
    "op_fill_median",
    with_views(
        ["messy_orders"],
        "SELECT * EXCLUDE (total_price), round(coalesce(total_price, "
        "(SELECT median(total_price) FROM messy_orders)), 4) AS total_price FROM messy_orders",
    ),
)
def op_fill_median(spark, sf_dir):
    filled = scour.fill_numeric(view(spark, sf_dir, "messy_orders"), "median")
    return filled.withColumn("total_price", F.round("total_price", 4))


def _mode(column: str, source: str = "messy_orders") -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@case(
    "op_fill_mode",
    with_views(
        ["messy_orders"],
        f"SELECT * EXCLUDE (status, priority), coalesce(status, {_mode('status')}) AS status, "
        f"coalesce(priority, {_mode('priority')}) AS priority FROM messy_orders",
    ),
)
def op_fill_mode(spark, sf_dir):
    return scour.fill_categorical(view(spark, sf_dir, "messy_orders"))


def _clean_events(spark, sf_dir):
    return scour.clean(
        view(spark, sf_dir, "dup_events"),
        remove_duplicates=True,
        fill_numeric="median",
        standardize_text=("event_type", "upper"),
    )


EVENTS_FILLED = (
    "filled AS (SELECT row_id, user_bucket, event_type, CAST(coalesce(value_bucket, "
    "(SELECT median(value_bucket) FROM dup_events)) AS DOUBLE) AS value_bucket FROM dup_events)"
)


@case(
    "clean_combined",
    with_views(
        ["dup_events"],
        "SELECT min(row_id) AS row_id, user_bucket, upper(event_type) AS event_type, value_bucket "
        "FROM filled GROUP BY user_bucket, event_type, value_bucket",
        EVENTS_FILLED,
    ),
)
def clean_combined(spark, sf_dir):
    return _clean_events(spark, sf_dir).data


@case(
    "clean_stats",
    with_views(
        ["dup_events"],
        "SELECT (SELECT count(*) FROM dup_events) AS rows_before, count(*) AS rows_after, "
        "(SELECT count(*) FROM dup_events WHERE value_bucket IS NULL) AS missing_rows_dropped, "
        "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows_removed, "
        "CAST(0 AS BIGINT) AS remaining_missing FROM "
        f"(SELECT count(*) AS n FROM dup_events WHERE value_bucket IS NOT NULL GROUP BY {EVENT_KEYS})",
    ),
)
def clean_stats(spark, sf_dir):
    return scour.clean(
        view(spark, sf_dir, "dup_events"), drop_missing=True, remove_duplicates=True
    ).stats


# --- text, units, dates -----------------------------------------------------------------------------


def text_style(name: str, style: str, source: str, column: str, expression: str) -> None:
    def query(spark, sf_dir):
        return scour.normalize_text(view(spark, sf_dir, source), style, [column])

    oracle = with_views(
        [source], f"SELECT * EXCLUDE ({column}), {expression} AS {column} FROM {source}"
    )
    case(name, oracle)(query)


text_style("text_strip", "strip", "messy_parts", "label", "trim(label)")
text_style(
    "text_collapse_ws", "collapse_whitespace", "messy_parts", "label",
    r"trim(regexp_replace(label, '\s+', ' ', 'g'))",
)
text_style("text_lower", "lower", "messy_orders", "status", "lower(status)")
text_style("text_upper", "upper", "messy_orders", "status", "upper(status)")
text_style("text_title", "title", "messy_parts", "label", sql.title("label"))


@case(
    "text_all_columns",
    with_views(
        ["messy_parts"],
        "SELECT row_id, p_size, p_retailprice, "
        + ", ".join(
            f"{sql.title(c)} AS {c}"
            for c in ("label", "weight", "quantity", "height", "mixed_dim")
        )
        + " FROM messy_parts",
    ),
)
def text_all_columns(spark, sf_dir):
    return scour.normalize_text(view(spark, sf_dir, "messy_parts"), "title", "all_string")


@case(
    "op_standardize_text",
    with_views(
        ["messy_orders"],
        f"SELECT row_id, {sql.title('trim(status)')} AS title, lower(trim(status)) AS lower, "
        "upper(trim(status)) AS upper, trim(status) AS strip FROM messy_orders",
    ),
)
def op_standardize_text(spark, sf_dir):
    df = view(spark, sf_dir, "messy_orders").select("row_id", "status")
    for style in ("title", "lower", "upper", "strip"):
        df = scour.standardize_text(df.withColumn(style, F.col("status")), style, style)
    return df.drop("status")


UNITS_REMOVED = (
    "CASE WHEN regexp_matches(lower(trim(quantity)), '^[-+]?[0-9]+(\\.[0-9]+)?\\s*units$') "
    f"THEN {sql.plain(sql.number_of('quantity'))} ELSE quantity END"
)


@case(
    "op_remove_units",
    with_views(
        ["messy_parts"],
        f"SELECT row_id, {UNITS_REMOVED} AS quantity, CAST({UNITS_REMOVED} AS DOUBLE) AS number, "
        "CASE WHEN lower(weight) LIKE '%kg' THEN "
        f"{sql.plain(sql.number_of('weight'))} ELSE weight END AS weight FROM messy_parts",
    ),
)
def op_remove_units(spark, sf_dir):
    df = view(spark, sf_dir, "messy_parts").select(
        "row_id", "quantity", F.col("quantity").alias("number"), "weight"
    )
    df = scour.remove_units(df, "quantity", "units")
    df = scour.remove_units(df, "number", "units", numeric=True)
    return scour.remove_units(df, "weight", "kg")


def _in_kg(column: str) -> str:
    number, unit = sql.number_of(column), sql.unit(column)
    converted = f"({number} * CASE {unit} WHEN 'g' THEN 1.0 WHEN 'kg' THEN 1000.0 END / 1000.0)"
    return (
        f"CASE WHEN {unit} IN ('g', 'kg') THEN {sql.plain(converted)} || ' kg' ELSE {column} END"
    )


@case(
    "op_standardize_units",
    with_views(
        ["messy_parts"],
        f"SELECT row_id, {_in_kg('weight')} AS weight, {_in_kg('mixed_dim')} AS mixed_dim "
        "FROM messy_parts",
    ),
)
def op_standardize_units(spark, sf_dir):
    df = view(spark, sf_dir, "messy_parts").select("row_id", "weight", "mixed_dim")
    return scour.standardize_units(scour.standardize_units(df, "weight", "kg"), "mixed_dim", "kg")


SPELLED = """CASE p_partkey % 8 WHEN 0 THEN 'KGS' WHEN 1 THEN ' Litres ' WHEN 2 THEN 'hrs'
    WHEN 3 THEN 'Parsec' WHEN 4 THEN 't' WHEN 5 THEN 'metre' WHEN 6 THEN 'Grams'
    WHEN 7 THEN 'ms' END"""
CANONICAL = """CASE p_partkey % 8 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'hour'
    WHEN 3 THEN 'parsec' WHEN 4 THEN 'tonne' WHEN 5 THEN 'm' WHEN 6 THEN 'g' WHEN 7 THEN 'ms' END"""


@case("unit_normalize", f"SELECT p_partkey AS row_id, {CANONICAL} AS unit FROM part")
def unit_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.expr(units.normalize_unit(SPELLED)).alias("unit")
    )


@case(
    "unit_category",
    f"SELECT p_partkey AS row_id, {sql.category('(' + CANONICAL + ')')} AS category FROM part",
)
def unit_category(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.expr(units.unit_category(units.normalize_unit(SPELLED))).alias("category")
    )


@case(
    "unit_convert",
    f"SELECT p_partkey AS row_id, round(CASE {CANONICAL} WHEN 'kg' THEN p_size * 1000.0 "
    "WHEN 'tonne' THEN p_size * 1000000.0 WHEN 'g' THEN p_size * 1.0 END / 1000.0, 6) "
    "AS converted FROM part",
)
def unit_convert(spark, sf_dir):
    converted = F.expr(units.convert_value("p_size", SPELLED, "kg"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.round(converted, 6).alias("converted")
    )


def _redated(value: str, fmt: str, day_first: bool = True) -> str:
    date = sql.parsed(value, day_first)
    return f"CASE WHEN {date} IS NULL THEN {value} ELSE strftime({date}, '{fmt}') END"


@case(
    "op_date_format",
    with_views(
        ["messy_orders"],
        f"SELECT row_id, {_redated('order_date', '%Y-%m-%d')} AS iso, "
        f"{_redated('order_date', '%d-%m-%Y')} AS dashed, "
        f"{_redated('order_date', '%m-%d-%Y', False)} AS month_first, "
        f"{_redated('order_date', '%B %d, %Y')} AS named FROM messy_orders",
    ),
)
def op_date_format(spark, sf_dir):
    df = view(spark, sf_dir, "messy_orders").select(
        "row_id",
        *[F.col("order_date").alias(n) for n in ("iso", "dashed", "month_first", "named")],
    )
    df = scour.date_format(df, "iso", "DD-MM-YYYY", "YYYY-MM-DD")
    df = scour.date_format(df, "dashed", "DD-MM-YYYY", "DD-MM-YYYY")
    df = scour.date_format(df, "month_first", "MM-DD-YYYY", "MM-DD-YYYY")
    return scour.date_format(df, "named", "DD-MM-YYYY", "Month DD, YYYY")


@case(
    "date_detect_format",
    with_views(
        ["messy_orders"],
        f"SELECT row_id, {sql.notation('order_date')} AS notation, "
        f"{sql.notation('status')} AS other FROM messy_orders",
    ),
)
def date_detect_format(spark, sf_dir):
    return view(spark, sf_dir, "messy_orders").select(
        "row_id",
        F.expr(dates.detect_format("order_date")).alias("notation"),
        F.expr(dates.detect_format("status")).alias("other"),
    )


# --- rules ------------------------------------------------------------------------------------------

RULES = [
    {"rule": "min", "column": "total_price", "value": 20000},
    {"rule": "max", "column": "total_price", "value": 450000},
    {"rule": "not-null", "column": "priority"},
    {"rule": "allowed-values", "column": "status", "value": ["Delivered", "Shipped"]},
    {"rule": "allowed-values", "column": "customer_id", "value": ["1", "2"]},
]
BROKEN = [
    ("min", "total_price", "'20000'", "total_price < 20000"),
    ("max", "total_price", "'450000'", "total_price > 450000"),
    ("not-null", "priority", "NULL", "priority IS NULL"),
    ("allowed-values", "status", "'Delivered,Shipped'", "status NOT IN ('Delivered', 'Shipped')"),
    ("allowed-values", "customer_id", "'1,2'", "customer_id IS NOT NULL"),
]


def single_rule(name: str, index: int) -> None:
    kind, column, shown, test = BROKEN[index]

    def query(spark, sf_dir):
        return scour.violations(view(spark, sf_dir, "messy_orders"), [RULES[index]])

    oracle = with_views(
        ["messy_orders"],
        f"SELECT 0 AS rule_index, '{kind}' AS rule, '{column}' AS \"column\", "
        f"CAST({shown} AS VARCHAR) AS rule_value, row_id FROM messy_orders WHERE {test}",
    )
    case(name, oracle)(query)


single_rule("validate_min", 0)
single_rule("validate_max", 1)
single_rule("validate_not_null", 2)
single_rule("validate_allowed", 3)

ALL_BROKEN = "broken AS (" + " UNION ALL ".join(
    f"SELECT {i} AS rule_index, '{kind}' AS rule, '{column}' AS \"column\", "
    f"CAST({shown} AS VARCHAR) AS rule_value, row_id FROM messy_orders WHERE {test}"
    for i, (kind, column, shown, test) in enumerate(BROKEN)
) + ")"

LINE_RULES = [
    {"rule": "min", "column": "l_quantity", "value": 2},
    {"rule": "max", "column": "l_discount", "value": 0.09},
    {"rule": "max", "column": "l_extendedprice", "value": 90000},
    {"rule": "not-null", "column": "l_returnflag"},
    {"rule": "allowed-values", "column": "l_linestatus", "value": ["O"]},
]
LINE_BROKEN = [
    ("min", "l_quantity", "'2'", "l_quantity < 2"),
    ("max", "l_discount", "'0.09'", "l_discount > 0.09"),
    ("max", "l_extendedprice", "'90000'", "l_extendedprice > 90000"),
    ("not-null", "l_returnflag", "NULL", "l_returnflag IS NULL"),
    ("allowed-values", "l_linestatus", "'O'", "l_linestatus <> 'O'"),
]


@case(
    "validate_violations",
    with_views(
        ["line_items"],
        " UNION ALL ".join(
            f"SELECT {i} AS rule_index, '{kind}' AS rule, '{column}' AS \"column\", "
            f"CAST({shown} AS VARCHAR) AS rule_value, row_id FROM line_items WHERE {test}"
            for i, (kind, column, shown, test) in enumerate(LINE_BROKEN)
        ),
    ),
)
def validate_violations(spark, sf_dir):
    return scour.violations(view(spark, sf_dir, "line_items"), LINE_RULES)


_RULE_LIST = "rules AS (" + " UNION ALL ".join(
    f"SELECT {i} AS rule_index, '{kind}' AS rule, '{column}' AS \"column\", "
    f"CAST({shown} AS VARCHAR) AS rule_value"
    for i, (kind, column, shown, _) in enumerate(BROKEN)
) + ")"


@case(
    "validate_report",
    with_views(
        ["messy_orders"],
        'SELECT rules.*, count(b.row_id) AS violations, coalesce(array_to_string(list(b.row_id '
        "ORDER BY b.row_id) FILTER (b.place <= 10), '|'), '') AS first_rows, "
        "CASE WHEN count(b.row_id) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status "
        "FROM rules LEFT JOIN (SELECT rule_index, row_id, row_number() OVER (PARTITION BY "
        "rule_index ORDER BY row_id) AS place FROM broken) b USING (rule_index) GROUP BY ALL",
        ALL_BROKEN,
        _RULE_LIST,
    ),
)
def validate_report(spark, sf_dir):
    report = scour.validation_report(view(spark, sf_dir, "messy_orders"), RULES)
    return report.withColumn("first_rows", F.array_join("first_rows", "|"))


@case(
    "validate_summary",
    with_views(
        ["messy_orders"],
        "SELECT (SELECT count(*) FROM messy_orders) AS rows, count(*) AS violations, "
        "CASE WHEN count(*) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM broken",
        ALL_BROKEN,
    ),
)
def validate_summary(spark, sf_dir):
    return scour.validation_summary(view(spark, sf_dir, "messy_orders"), RULES)


# --- profile and issues -----------------------------------------------------------------------------

ORDER_TYPES = {
    "customer_id": "int", "status": "text", "total_price": "double", "priority": "text",
    "order_date": "text",
}
PART_TEXTS = ["label", "weight", "quantity", "height", "mixed_dim"]
ORDER_TEXTS = ["status", "priority", "order_date"]
SPARK_TYPES = {"int": "bigint", "double": "double", "text": "string"}


def _missing_sql(view_name: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{SPARK_TYPES[kind]}' AS dtype, "
        f"count(*) AS rows, count(*) - count({c}) AS missing FROM {view_name}"
        for i, (c, kind) in enumerate(types.items())
    )


@case(
    "inspect_report",
    with_views(
        ["messy_orders"],
        "SELECT *, round(missing * 100.0 / rows, 4) AS missing_percent FROM gaps",
        f"gaps AS ({_missing_sql('messy_orders', ORDER_TYPES)})",
    ),
)
def inspect_report(spark, sf_dir):
    report = scour.inspect_columns(view(spark, sf_dir, "messy_orders"))
    return report.withColumn("missing_percent", F.round("missing_percent", 4))


@case(
    "inspect_table",
    with_views(
        ["dup_events"],
        "SELECT CAST(sum(n) AS BIGINT) AS rows, 3 AS columns, "
        "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT count(*) AS n FROM dup_events GROUP BY {EVENT_KEYS})",
    ),
)
def inspect_table(spark, sf_dir):
    return scour.inspect_table(view(spark, sf_dir, "dup_events"))


@case("profile_missing", with_views(["messy_orders"], _missing_sql("messy_orders", ORDER_TYPES)))
def profile_missing(spark, sf_dir):
    return profile.missing_counts(view(spark, sf_dir, "messy_orders"))


def _order_evidence(body: str, *more: str) -> str:
    return with_views(
        ["messy_orders"], body, sql.value_counts("messy_orders", ORDER_TEXTS), sql.evidence(), *more
    )


def _part_evidence(body: str, *more: str) -> str:
    return with_views(
        ["messy_parts"], body, sql.value_counts("messy_parts", PART_TEXTS), sql.evidence(), *more
    )


@case(
    "profile_text_variants",
    _order_evidence(
        'SELECT v."column", lower(trim(v.value)) AS key, v.value AS variant, v.n FROM vc v '
        'JOIN ev_spellings s ON s."column" = v."column" AND s.k = lower(trim(v.value))'
    ),
)
def profile_text_variants(spark, sf_dir):
    return profile.text_variants(view(spark, sf_dir, "messy_orders"))


@case(
    "profile_date_columns",
    _order_evidence(
        'SELECT "column", round(dates / present, 4) AS date_share FROM ev WHERE ' + sql.IS_DATE
    ),
)
def profile_date_columns(spark, sf_dir):
    found = profile.date_columns(view(spark, sf_dir, "messy_orders"))
    return found.withColumn("date_share", F.round("date_share", 4))


@case(
    "profile_date_formats",
    _order_evidence(
        "SELECT \"column\", array_to_string(formats, '|') AS formats FROM ev "
        f'JOIN ev_formats USING ("column") WHERE {sql.IS_DATE} AND len(formats) > 1'
    ),
)
def profile_date_formats(spark, sf_dir):
    found = profile.date_formats(view(spark, sf_dir, "messy_orders"))
    return found.select("column", *joined("formats"))


@case(
    "profile_units",
    _part_evidence(
        'SELECT "column", CAST(present AS BIGINT) AS present, CAST(with_unit AS BIGINT) AS with_unit, '
        "distinct_with_unit, units = 1 AS one_unit, "
        "coalesce(array_to_string(known_units, '|'), '') AS known_units, "
        "array_to_string(categories, '|') AS categories FROM ev WHERE " + sql.UNIT_ISSUE
    ),
)
def profile_units(spark, sf_dir):
    found = profile.embedded_units(view(spark, sf_dir, "messy_parts"))
    return found.select(
        "column", "present", "with_unit", "distinct_with_unit", "one_unit",
        *joined("known_units", "categories"),
    )


@case(
    "profile_unit_values",
    _part_evidence(
        'SELECT v."column", trim(v.value) AS value, CAST(sum(v.n) AS BIGINT) AS n FROM vc v '
        f'JOIN ev USING ("column") WHERE {sql.UNIT_ISSUE} '
        f"AND {sql.unit('v.value')} IS NOT NULL GROUP BY ALL"
    ),
)
def profile_unit_values(spark, sf_dir):
    return profile.unit_values(view(spark, sf_dir, "messy_parts"))


PART_TYPES = {**dict.fromkeys(PART_TEXTS, "text"), "p_size": "int", "p_retailprice": "double"}


def _issues_sql(view_name: str, types: dict[str, str]) -> str:
    keys = ", ".join(types)
    gaps = _missing_sql(view_name, types)
    return f"""issues AS (
        SELECT 1 AS issue_rank, 'missing_values' AS type, "column", CAST(missing AS BIGINT) AS count
        FROM ({gaps}) WHERE missing > 0
        UNION ALL SELECT 2, 'duplicate_rows', NULL, CAST(sum(n) - count(*) AS BIGINT)
        FROM (SELECT count(*) AS n FROM {view_name} GROUP BY {keys}) HAVING sum(n) > count(*)
        UNION ALL SELECT 3, 'text_inconsistency', "column", CAST(sum(spellings) AS BIGINT)
        FROM ev_spellings GROUP BY "column"
        UNION ALL SELECT 4, 'date_format_inconsistency', "column", CAST(len(formats) AS BIGINT)
        FROM ev JOIN ev_formats USING ("column") WHERE {sql.IS_DATE} AND len(formats) > 1
        UNION ALL SELECT 5, 'embedded_units', "column", distinct_with_unit FROM ev
        WHERE {sql.UNIT_ISSUE})"""


@case(
    "analyze_quality",
    _order_evidence("SELECT * FROM issues", _issues_sql("messy_orders", ORDER_TYPES)),
)
def analyze_quality(spark, sf_dir):
    return scour.analyze_quality(view(spark, sf_dir, "messy_orders"))


@case(
    "analyze_display",
    _part_evidence(
        "SELECT i.* FROM issues i LEFT JOIN ev e ON e.\"column\" = i.\"column\" "
        "AND i.type = 'embedded_units' "
        f"WHERE NOT coalesce({sql.MIXED} AND e.missing > 0, false)",
        _issues_sql("messy_parts", PART_TYPES),
    ),
)
def analyze_display(spark, sf_dir):
    return scour.display_issues(view(spark, sf_dir, "messy_parts"))


@case(
    "profile_report",
    _part_evidence(
        "SELECT k.issue_rank, k.type, count(i.type) AS issues, "
        "CAST(coalesce(sum(i.count), 0) AS BIGINT) AS total FROM (VALUES (1, 'missing_values'), "
        "(2, 'duplicate_rows'), (3, 'text_inconsistency'), (4, 'date_format_inconsistency'), "
        "(5, 'embedded_units')) k(issue_rank, type) LEFT JOIN issues i USING (issue_rank) "
        "GROUP BY ALL",
        _issues_sql("messy_parts", PART_TYPES),
    ),
)
def profile_report(spark, sf_dir):
    return scour.profile_report(view(spark, sf_dir, "messy_parts"))


# --- dataset context --------------------------------------------------------------------------------

ORDER_STATS = sql.context_stats("messy_orders", ORDER_TYPES)
RAW_TYPES = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double",
    "o_orderdate": "timestamp", "o_orderpriority": "text",
}
RAW_STATS = sql.context_stats("orders", RAW_TYPES)
CUSTOMER_TYPES = {
    "c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "text",
}
CUSTOMER_STATS = sql.context_stats("customer", CUSTOMER_TYPES)
LINE_TYPES = {
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "text", "l_linestatus": "text", "l_linenumber": "int",
}


def _day(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


def _days(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in names})


@case(
    "ctx_unique",
    with_views(
        ["line_items"],
        'SELECT "column", distinct_values FROM st',
        sql.context_stats("line_items", LINE_TYPES),
    ),
)
def ctx_unique(spark, sf_dir):
    return context.column_statistics(view(spark, sf_dir, "line_items")).select(
        "column", "distinct_values"
    )


@case(
    "ctx_unique_sketch",
    with_views(
        ["line_items"],
        'SELECT "column", rows, missing, true AS close FROM st',
        sql.context_stats("line_items", LINE_TYPES),
    ),
)
def ctx_unique_sketch(spark, sf_dir):
    """Sketches of two halves, merged: estimates within four standard errors of the exact counts."""
    df = view(spark, sf_dir, "line_items")
    halves = [df.where(f"l_linenumber {test}") for test in ("<= 3", "> 3")]
    merged = uniques.merge_sketches(*map(uniques.unique_sketches, halves))
    exact = context.column_statistics(df).selectExpr("column", "distinct_values AS exact")
    return uniques.estimate_unique(merged).join(exact, "column").selectExpr(
        "column", "rows", "missing",
        f"abs(distinct_values - exact) <= {4 * uniques.relative_error()} * exact AS close",
    )


@case(
    "ctx_missing",
    with_views(
        ["messy_orders"],
        'SELECT "column", rows, missing, round(missing_fraction, 4) AS missing_fraction FROM st',
        ORDER_STATS,
    ),
)
def ctx_missing(spark, sf_dir):
    return context.column_ranges(view(spark, sf_dir, "messy_orders")).select(
        "column", "rows", "missing", F.round("missing_fraction", 4).alias("missing_fraction")
    )


@case(
    "ctx_minmax",
    with_views(
        ["line_items"],
        'SELECT "column", min_value, max_value FROM st',
        sql.context_stats("line_items", LINE_TYPES),
    ),
)
def ctx_minmax(spark, sf_dir):
    return context.column_ranges(view(spark, sf_dir, "line_items")).select(
        "column", "min_value", "max_value"
    )


def _date_range(stats: str) -> str:
    return (
        f"SELECT \"column\", CASE WHEN is_date THEN {_day('d1')} END AS date_min, "
        f"CASE WHEN is_date THEN {_day('d2')} END AS date_max FROM {stats}"
    )


@case(
    "ctx_date_range",
    with_views(
        ["messy_orders"],
        _date_range("st") + " UNION ALL " + _date_range("raw"),
        ORDER_STATS,
        sql.context_stats("orders", RAW_TYPES, "raw"),
    ),
)
def ctx_date_range(spark, sf_dir):
    parts = [
        context.column_ranges(df, row_id)
        for df, row_id in (
            (view(spark, sf_dir, "messy_orders"), "row_id"),
            (table(spark, sf_dir, "orders"), None),
        )
    ]
    both = reduce(DataFrame.unionByName, parts).select("column", "date_min", "date_max")
    return _days(both, "date_min", "date_max")


@case(
    "ctx_hint",
    f"WITH {RAW_STATS} SELECT position, \"column\", {sql.HINT} AS hint FROM st",
)
def ctx_hint(spark, sf_dir):
    return context.column_hints(table(spark, sf_dir, "orders"), None)


@case(
    "ctx_top_categories",
    _order_evidence(
        'SELECT "column", array_to_string(list(value ORDER BY n DESC, value) FILTER (place <= 10), '
        "'|') AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" "
        "ORDER BY n DESC, value) AS place FROM vc WHERE value IS NOT NULL AND \"column\" IN "
        "(SELECT \"column\" FROM st WHERE is_text AND NOT is_date "
        "AND distinct_values BETWEEN 1 AND 19)) GROUP BY 1",
        ORDER_STATS,
    ),
)
def ctx_top_categories(spark, sf_dir):
    found = context.top_categories(view(spark, sf_dir, "messy_orders"))
    return found.select("column", *joined("top_categories"))


ROLE_COLUMNS = '"column", ' + ", ".join(
    f"{sql.role(name)} AS {name}" for name in ("role", "confidence", "evidence")
)


@case(
    "ctx_role",
    with_views(
        ["messy_orders"],
        f"SELECT {ROLE_COLUMNS} FROM st UNION ALL SELECT {ROLE_COLUMNS} FROM raw "
        f"UNION ALL SELECT {ROLE_COLUMNS} FROM cust",
        ORDER_STATS,
        sql.context_stats("orders", RAW_TYPES, "raw"),
        sql.context_stats("customer", CUSTOMER_TYPES, "cust"),
    ),
)
def ctx_role(spark, sf_dir):
    parts = [
        context.column_roles(view(spark, sf_dir, "messy_orders")),
        context.column_roles(table(spark, sf_dir, "orders"), None),
        context.column_roles(table(spark, sf_dir, "customer"), None),
    ]
    return reduce(DataFrame.unionByName, parts).drop("position")


@case(
    "ctx_dataset",
    _order_evidence(
        'SELECT st.position, st."column", dtype, rows, missing, '
        "round(missing_fraction, 4) AS missing_fraction, distinct_values, min_value, max_value, "
        f"CASE WHEN is_date THEN {_day('d1')} END AS date_min, "
        f"CASE WHEN is_date THEN {_day('d2')} END AS date_max, {sql.HINT} AS hint, "
        f"{sql.role('role')} AS role, {sql.role('confidence')} AS confidence, "
        f"{sql.role('evidence')} AS evidence, top_categories "
        'FROM st LEFT JOIN top ON top.name = st."column"',
        ORDER_STATS,
        'top AS (SELECT "column" AS name, array_to_string(list(value ORDER BY n DESC, value) '
        "FILTER (place <= 10), '|') AS top_categories FROM (SELECT *, row_number() OVER "
        '(PARTITION BY "column" ORDER BY n DESC, value) AS place FROM vc WHERE value IS NOT NULL '
        'AND "column" IN (SELECT "column" FROM st WHERE is_text AND NOT is_date '
        "AND distinct_values BETWEEN 1 AND 19)) GROUP BY 1)",
    ),
)
def ctx_dataset(spark, sf_dir):
    found = scour.dataset_context(view(spark, sf_dir, "messy_orders"))
    found = _days(found, "date_min", "date_max")
    return found.withColumns(
        {
            "missing_fraction": F.round("missing_fraction", 4),
            "top_categories": F.array_join("top_categories", "|"),
        }
    )


@case(
    "find_value_columns",
    with_views(
        ["messy_orders"],
        "SELECT 'text' AS kind, 1 AS position, 'status' AS \"column\" FROM messy_orders "
        "HAVING bool_or(status = 'Shipped') UNION ALL "
        "SELECT 'number', 0, 'customer_id' FROM messy_orders "
        "HAVING min(customer_id) <= 1200 AND max(customer_id) >= 1200 UNION ALL "
        "SELECT 'number', 2, 'total_price' FROM messy_orders "
        "HAVING min(total_price) <= 1200 AND max(total_price) >= 1200 UNION ALL "
        "SELECT 'date', 4, 'order_date' FROM messy_orders HAVING "
        f"count({sql.parsed('order_date')}) > 0.95 * count(order_date)",
    ),
)
def find_value_columns(spark, sf_dir):
    df = view(spark, sf_dir, "messy_orders")
    found = [
        scour.find_value_columns(df, value, kind).select(F.lit(kind).alias("kind"), "position", "column")
        for value, kind in (("Shipped", "text"), (1200, "number"), ("June", "date"))
    ]
    return reduce(DataFrame.unionByName, found)


# --- suggestions ------------------------------------------------------------------------------------

SUGGESTION = ("type", "column", "resolution_type", "operation", "parameter", "message")


def _flat(report: DataFrame) -> DataFrame:
    """The outcome with lists as text."""
    return report.select(*SUGGESTION, *joined("available_targets", "detected_units"))


def _suggestion_sql(kind: str, source: str, cases: list[tuple], column: str = '"column"') -> str:
    """`cases`: (test, resolution, operation, parameter, targets, detected, message), all SQL; the
    message is NULL where a case has none."""

    def pick(index: int) -> str:
        chosen = [(c[0], (*c, "NULL")[index]) for c in cases]
        return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in chosen) + " END"

    return (
        f"SELECT '{kind}' AS type, {column} AS \"column\", {pick(1)} AS resolution_type, "
        f"CAST({pick(2)} AS VARCHAR) AS operation, CAST({pick(3)} AS VARCHAR) AS parameter, "
        f"CAST({pick(4)} AS VARCHAR) AS available_targets, "
        f"CAST({pick(5)} AS VARCHAR) AS detected_units, "
        f"CAST({pick(6)} AS VARCHAR) AS message FROM {source}"
    )




def _review(message: str) -> tuple[str, ...]:
    return "'REVIEW_REQUIRED'", "NULL", "NULL", "NULL", "NULL", f"'Review required: {message}.'"


OTHERS_ARE_PLAIN = "'Some values carry ' || first_unit || ', the others are plain numbers.'"
NUMERIC_CLASS = "(present > 0 AND numbers = present)"
TEXT_CLASS = "(present > 0 AND numbers = 0)"
FULL = (
    'full_ev AS (SELECT g."column", g.missing, g.rows - g.missing AS present, '
    "CASE WHEN e.\"column\" IS NULL THEN g.rows - g.missing ELSE e.numbers END AS numbers, "
    "coalesce(e.with_unit, 0) AS with_unit, coalesce(e.units, 0) AS units, "
    "coalesce(e.plain_numbers, 0) AS plain_numbers, e.first_unit "
    'FROM gaps g LEFT JOIN ev e USING ("column"))'
)
SUGGEST_MISSING = _suggestion_sql(
    "missing_values",
    "full_ev WHERE missing > 0",
    [
        (NUMERIC_CLASS, "'SAFE_FIX'", "'fill_numeric'", "'median'", "NULL", "NULL"),
        (TEXT_CLASS, "'SAFE_FIX'", "'fill_categorical'", "'mode'", "NULL", "NULL"),
        (
            sql.MIXED, "'MIXED_NUMERIC'", "'remove_units'", "first_unit", "NULL", "NULL",
            f"{OTHERS_ARE_PLAIN} || ' Standardize numeric representation first?'",
        ),
        ("true", *_review("numbers and other text are mixed in this column")),
    ],
)
WINNER = """CASE WHEN titles > lowers AND titles > uppers AND 2 * titles >= titles + lowers + uppers
    THEN 'title' WHEN lowers > titles AND lowers > uppers
    AND 2 * lowers >= titles + lowers + uppers THEN 'lower' WHEN uppers > titles AND uppers > lowers
    AND 2 * uppers >= titles + lowers + uppers THEN 'upper' END"""
SUGGEST_TEXT = _suggestion_sql(
    "text_inconsistency",
    'ev JOIN (SELECT "column", max(stripped) AS most FROM ev_spellings GROUP BY 1) '
    'USING ("column")',
    [
        ("most = 1", "'SAFE_FIX'", "'standardize_text'", "'strip'", "NULL", "NULL"),
        (f"{WINNER} IS NOT NULL", "'SAFE_FIX'", "'standardize_text'", WINNER, "NULL", "NULL"),
        ("true", *_review("no casing is dominant enough")),
    ],
)
SUGGEST_DATES = _suggestion_sql(
    "date_format_inconsistency",
    f'ev JOIN ev_formats USING ("column") WHERE {sql.IS_DATE} AND len(formats) > 1',
    [("true", *_review("several date notations; the user has to choose the target"))],
)
_TARGETS = (
    "CASE categories[1] WHEN 'Mass' THEN 'mg|g|kg|tonne' WHEN 'Length' THEN 'mm|cm|m|km' "
    "WHEN 'Volume' THEN 'ml|l' WHEN 'Time' THEN 'ms|sec|min|hour|day' END"
)
_MIXED_CASE = (
    "'MIXED_NUMERIC'", "'remove_units'", "first_unit", "NULL", "NULL", OTHERS_ARE_PLAIN
)
SUGGEST_UNITS = _suggestion_sql(
    "embedded_units",
    f"ev WHERE {sql.UNIT_ISSUE}",
    [
        (f"{sql.MIXED} AND missing = 0", *_MIXED_CASE),
        (
            "present > with_unit AND plain_numbers <> present - with_unit",
            *_review("inconsistent text mixed with numbers"),
        ),
        (
            "present > with_unit AND units > 1",
            *_review("plain numbers mixed with several units"),
        ),
        (
            "present > with_unit",
            *_review("resolved as part of the missing-value issue of the same column"),
        ),
        (
            "units > 1 AND len(categories) = 1 AND categories[1] <> 'Unknown'",
            "'STANDARDIZATION_AVAILABLE'", "'standardize_units'", "NULL", _TARGETS,
            "array_to_string(known_units, '|')",
        ),
        (
            "units > 1",
            *_review("the units belong to different categories: ' "
                     "|| array_to_string(list_sort(categories), ', ') || '"),
        ),
        ("true", "'SAFE_FIX'", "'remove_units'", "first_unit", "NULL", "NULL"),
    ],
)


def _duplicates_suggestion(source: str, keys: str) -> str:
    return (
        "SELECT 'duplicate_rows' AS type, CAST(NULL AS VARCHAR) AS \"column\", "
        "'SAFE_FIX' AS resolution_type, 'remove_duplicates' AS operation, "
        "CAST(NULL AS VARCHAR) AS parameter, CAST(NULL AS VARCHAR) AS available_targets, "
        "CAST(NULL AS VARCHAR) AS detected_units, CAST(NULL AS VARCHAR) AS message "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}) HAVING sum(n) > count(*)"
    )


PART_GAPS = f"gaps AS ({_missing_sql('messy_parts', PART_TYPES)})"
ORDER_GAPS = f"gaps AS ({_missing_sql('messy_orders', ORDER_TYPES)})"


@case(
    "suggest_classify",
    _part_evidence(
        'SELECT "column", CAST(present AS BIGINT) AS present, CAST(numbers AS BIGINT) AS numbers, '
        f"CASE WHEN {NUMERIC_CLASS} THEN 'numeric' WHEN {TEXT_CLASS} THEN 'categorical' "
        "ELSE 'ambiguous' END AS classification FROM full_ev",
        PART_GAPS,
        FULL,
    ),
)
def suggest_classify(spark, sf_dir):
    return suggest.classify_columns(view(spark, sf_dir, "messy_parts"))


@case("suggest_missing", _order_evidence(SUGGEST_MISSING, ORDER_GAPS, FULL))
def suggest_missing(spark, sf_dir):
    return _flat(suggest.suggest_missing(view(spark, sf_dir, "messy_orders")))


@case("suggest_mixed_numeric", _part_evidence(SUGGEST_MISSING, PART_GAPS, FULL))
def suggest_mixed_numeric(spark, sf_dir):
    return _flat(suggest.suggest_missing(view(spark, sf_dir, "messy_parts")))


@case(
    "suggest_duplicates",
    with_views(["dup_events"], _duplicates_suggestion("dup_events", EVENT_KEYS)),
)
def suggest_duplicates(spark, sf_dir):
    return _flat(suggest.suggest_duplicates(view(spark, sf_dir, "dup_events")))


@case("suggest_text_style", _order_evidence(SUGGEST_TEXT))
def suggest_text_style(spark, sf_dir):
    return _flat(suggest.suggest_text_style(view(spark, sf_dir, "messy_orders")))


@case("suggest_units", _part_evidence(SUGGEST_UNITS))
def suggest_units(spark, sf_dir):
    return _flat(suggest.suggest_units(view(spark, sf_dir, "messy_parts")))


@case("suggest_dates", _order_evidence(SUGGEST_DATES))
def suggest_dates(spark, sf_dir):
    return _flat(suggest.suggest_dates(view(spark, sf_dir, "messy_orders")))


@case(
    "suggest_all",
    _part_evidence(
        " UNION ALL ".join(
            [
                SUGGEST_MISSING,
                _duplicates_suggestion("messy_parts", ", ".join(PART_TYPES)),
                SUGGEST_TEXT,
                SUGGEST_DATES,
                SUGGEST_UNITS,
            ]
        ),
        PART_GAPS,
        FULL,
    ),
)
def suggest_all(spark, sf_dir):
    return _flat(scour.suggest(view(spark, sf_dir, "messy_parts")))


# --- audit, impact, pipelines -----------------------------------------------------------------------


def _log_sql(source: str, column: str, test: str, before: str, after: str, reason: str) -> str:
    return (
        f"SELECT row_id, '{column}' AS \"column\", {before} AS original_value, "
        f"{after} AS cleaned_value, {reason} AS reason FROM {source} WHERE {test}"
    )


TITLED = sql.title("trim(status)")
ISO = _redated("order_date", "%Y-%m-%d")


@case(
    "audit_cells",
    with_views(
        ["messy_orders", "messy_parts"],
        " UNION ALL ".join(
            [
                _log_sql(
                    "messy_orders", "priority", "priority IS NULL", "'NaN'", _mode("priority"),
                    "'Filled missing value using mode'",
                ),
                _log_sql(
                    "messy_orders", "status", f"status <> {TITLED}", "status", TITLED,
                    "'Standardized text using title case'",
                ),
                _log_sql(
                    "messy_orders", "order_date", f"order_date <> {ISO}", "order_date", ISO,
                    "'Converted date to YYYY-MM-DD using user-selected interpretation'",
                ),
                _log_sql(
                    "messy_parts", "quantity", f"quantity <> {UNITS_REMOVED}", "quantity",
                    UNITS_REMOVED, "'Removed units unit'",
                ),
                _log_sql(
                    "messy_parts", "weight", f"weight <> {_in_kg('weight')}", "weight",
                    _in_kg("weight"),
                    f"'Converted from ' || regexp_extract(weight, '{sql.QUANTITY}', 2) || ' to kg'",
                ),
            ]
        ),
    ),
)
def audit_cells(spark, sf_dir):
    orders, parts = view(spark, sf_dir, "messy_orders"), view(spark, sf_dir, "messy_parts")
    # One scan of the orders for three operators.
    edits = [
        *missing.categorical_edits(orders, "mode", "priority"),
        *column_ops.standardize_text_edits(orders, "status", "title"),
        *column_ops.date_format_edits(orders, "order_date", "DD-MM-YYYY", "YYYY-MM-DD"),
    ]
    part_edits = [
        *column_ops.remove_units_edits(parts, "quantity", "units"),
        *column_ops.standardize_units_edits(parts, "weight", "kg"),
    ]
    return union_logs(
        [
            column_ops.edit_log(orders, edits, "row_id"),
            column_ops.edit_log(parts, part_edits, "row_id"),
        ]
    )


@case(
    "audit_rows",
    with_views(
        ["dup_events", "messy_orders"],
        "SELECT row_id, '*' AS \"column\", 'Duplicate row' AS original_value, "
        "'Removed' AS cleaned_value, 'Removed duplicate row' AS reason FROM dup_events "
        f"QUALIFY row_number() OVER (PARTITION BY {EVENT_KEYS} ORDER BY row_id) > 1 UNION ALL "
        "SELECT row_id, '*', 'Row contains missing value', 'Removed', "
        f"'Dropped row containing missing value' FROM messy_orders WHERE {ANY_MISSING}",
    ),
)
def audit_rows(spark, sf_dir):
    return union_logs(
        [
            dedup.remove_duplicates_log(view(spark, sf_dir, "dup_events")),
            missing.drop_missing_log(view(spark, sf_dir, "messy_orders")),
        ]
    )


@case(
    "preview_changes",
    with_views(
        ["dup_events"],
        "SELECT row_id, 'value_bucket' AS \"column\", 'NaN' AS original_value, "
        "(SELECT CAST(CAST(median(value_bucket) AS DOUBLE) AS VARCHAR) FROM dup_events) "
        "AS cleaned_value, 'Filled missing value using median' AS reason "
        "FROM dup_events WHERE value_bucket IS NULL UNION ALL "
        "SELECT row_id, '*', 'Duplicate row', 'Removed', 'Removed duplicate row' FROM filled "
        f"QUALIFY row_number() OVER (PARTITION BY {EVENT_KEYS} ORDER BY row_id) > 1 UNION ALL "
        "SELECT min(row_id), 'event_type', event_type, upper(event_type), "
        f"'Standardized text using uppercase' FROM filled GROUP BY {EVENT_KEYS}",
        EVENTS_FILLED,
    ),
)
def preview_changes(spark, sf_dir):
    return _clean_events(spark, sf_dir).log


STEPS = [
    {"op": "normalize_text", "style": "strip", "columns": ["status"]},
    {"op": "filter", "condition": leaf("not_equals", "status", "Shipped")},
    {"op": "mutate", "column": "total_price", "expression": ["*", "total_price", 2]},
    {"op": "mutate", "column": "share", "expression": ["/", "total_price", "customer_id"]},
    {"op": "sort", "by": ["total_price"], "ascending": [False]},
    {"op": "drop_duplicates", "subset": ["customer_id", "status"]},
    {"op": "drop", "columns": ["order_date"]},
]
STATE = (
    "state AS (SELECT row_id, customer_id, trim(status) AS status, total_price * 2 AS total_price, "
    "priority, CASE WHEN customer_id = 0 THEN 'Infinity'::DOUBLE "
    "ELSE total_price * 2 / customer_id END AS share FROM messy_orders "
    "WHERE coalesce(trim(status) <> 'Shipped', true) QUALIFY row_number() OVER (PARTITION BY "
    "customer_id, trim(status) ORDER BY total_price DESC NULLS LAST, row_id) = 1)"
)


@case("run_steps", with_views(["messy_orders"], "SELECT * FROM state", STATE))
def run_steps(spark, sf_dir):
    return scour.run_pipeline(view(spark, sf_dir, "messy_orders"), STEPS).data


@case(
    "impact_counts",
    with_views(
        ["messy_orders"],
        "SELECT (SELECT count(*) FROM messy_orders) AS rows_before, count(*) AS rows_after, "
        "(SELECT count(*) FROM messy_orders) - count(*) AS rows_removed, "
        "'share' AS columns_added, 'order_date' AS columns_removed FROM state",
        STATE,
    ),
)
def impact_counts(spark, sf_dir):
    impact = scour.run_pipeline(view(spark, sf_dir, "messy_orders"), STEPS).impact
    return impact.select(
        "rows_before", "rows_after", "rows_removed", *joined("columns_added", "columns_removed")
    )


@case(
    "impact_values_changed",
    with_views(
        ["messy_orders"],
        "SELECT CAST(coalesce(sum(CAST(m.status IS DISTINCT FROM s.status AS BIGINT) "
        "+ CAST(m.total_price IS DISTINCT FROM s.total_price AS BIGINT)), 0) AS BIGINT) "
        "AS values_changed FROM state s JOIN messy_orders m USING (row_id)",
        STATE,
    ),
)
def impact_values_changed(spark, sf_dir):
    impact = scour.run_pipeline(view(spark, sf_dir, "messy_orders"), STEPS).impact
    return impact.select("values_changed")


@case(
    "run_operation",
    with_views(
        ["messy_orders"],
        f"SELECT 'standardize_text' AS operation, row_id, trim(status) AS value FROM messy_orders "
        "UNION ALL SELECT 'fill_categorical', row_id, "
        f"coalesce(priority, {_mode('priority')}) FROM messy_orders "
        f"UNION ALL SELECT 'date_format', row_id, {ISO} FROM messy_orders "
        f"UNION ALL SELECT 'drop_missing', row_id, status FROM messy_orders WHERE NOT ({ANY_MISSING})",
    ),
)
def run_operation(spark, sf_dir):
    df = view(spark, sf_dir, "messy_orders")
    requests = [
        ("standardize_text", "status", {"style": "strip"}, "status"),
        ("fill_categorical", "priority", {"strategy": "mode"}, "priority"),
        (
            "date_format", "order_date",
            {"interpretation": "DD-MM-YYYY", "format": "YYYY-MM-DD"}, "order_date",
        ),
        ("drop_missing", None, {}, "status"),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            scour.run_operation(df, name, column, parameters).data.select(
                F.lit(name).alias("operation"), "row_id", ref(shown).alias("value")
            )
            for name, column, parameters, shown in requests
        ],
    )


@case(
    "replay_history",
    with_views(
        ["messy_orders"],
        "SELECT row_id, status, 2 AS upto FROM state WHERE coalesce(total_price > 250000, false) "
        "UNION ALL SELECT row_id, status, 1 FROM state UNION ALL "
        "SELECT row_id, status, 0 FROM messy_orders",
        STATE,
    ),
)
def replay_history(spark, sf_dir):
    source = view(spark, sf_dir, "messy_orders")
    history = scour.record(source, [], STEPS)
    history = scour.record(source, history, [{"op": "filter", "condition": PRICY}])
    return reduce(
        DataFrame.unionByName,
        [
            scour.replay(source, history, upto).select("row_id", "status", F.lit(upto).alias("upto"))
            for upto in (0, 1, 2)
        ],
    )


# --- sources and sinks ------------------------------------------------------------------------------


def _save(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    scour.save_table(df, path)
    return path


def _write_lines(lines: DataFrame, header: str, label: str) -> str:
    """Raw lines below a header, one file per task, nothing quoted."""
    path = scratch_path(lines.sparkSession, label)
    lines.toDF(header).write.option("header", True).option("sep", "\x01").option(
        "quote", "\x02"
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option(
        "emptyValue", ""
    ).csv(path)
    return path


@case("src_csv_lenient", view_sql("messy_orders"))
def src_csv_lenient(spark, sf_dir):
    return scour.load_csv(spark, _save(view(spark, sf_dir, "messy_orders"), "lenient"))


@case(
    "ingest_strict",
    with_views(
        ["messy_parts"],
        "SELECT * EXCLUDE (quantity, p_size), coalesce(quantity, '') AS quantity, "
        "CAST(p_size AS BIGINT) AS p_size FROM messy_parts",
    ),
)
def ingest_strict(spark, sf_dir):
    return scour.ingest_csv(spark, _save(view(spark, sf_dir, "messy_parts"), "strict")).data


BROKEN_LINE = """CASE WHEN o_orderkey % 50 = 0 THEN concat(cast(o_orderkey as string), ',x')
    WHEN o_orderkey % 50 = 1 THEN concat(cast(o_orderkey as string), ',x,y,"z, or not"')
    WHEN o_orderkey % 50 = 2 THEN concat(cast(o_orderkey as string), ',"x,y')
    ELSE concat(cast(o_orderkey as string), ',"', o_orderpriority, ', quoted",', o_orderstatus)
    END"""


#: Lines that one task sorts.
SORTED_AT_ONCE = 1_000_000


def _write_one_file(lines: DataFrame, header: str, label: str) -> str:
    """Raw lines in the order of their key below a header, in one file, so that numbers are known.

    They are sorted in ranges, one file each. The task that writes the one file reads those in turn
    (`coalesce` keeps their order), and holds none of them.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, label)
    first = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(header).alias("line"))
    ranges = lines.count() // SORTED_AT_ONCE + 1
    ordered = stage(
        first.unionByName(lines).repartitionByRange(ranges, "key").sortWithinPartitions("key"), "sorted"
    )
    pieces = [spark.read.schema(ordered.schema).parquet(file) for file in sorted(ordered.inputFiles())]
    reduce(DataFrame.unionAll, pieces).coalesce(1).select("line").write.text(path)
    return path


def _error_sql(record: str) -> str:
    """The error table of orders whose key gives a remainder of 0 to 2 by 50."""
    return (
        "SELECT row_index, CASE WHEN kind < 2 THEN 3 END AS expected_fields, "
        "CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 END AS found_fields, raw_content, "
        "CASE kind WHEN 0 THEN 'missing_fields' WHEN 1 THEN 'extra_fields' "
        "ELSE 'malformed_quotes' END AS issue_type, "
        "CASE kind WHEN 0 THEN 'The record has 2 fields, the header 3.' "
        "WHEN 1 THEN 'The record has 4 fields, the header 3.' "
        "ELSE 'The quotes of the record are broken.' END AS message "
        "FROM (SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS row_index, "
        f"o_orderkey % 50 AS kind, {record} AS raw_content FROM orders) WHERE kind < 3"
    )


@case("ingest_errors", _error_sql(BROKEN_LINE))
def ingest_errors(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", f"{BROKEN_LINE} AS line")
    return scour.ingest_csv(spark, _write_one_file(lines, "id,priority,status", "broken")).errors


def _quoted_record(broken: bool) -> str:
    """A record of an order over several lines, as SQL; some are broken."""
    sound = """concat(cast(o_orderkey as string), ',"', o_orderpriority, '
quoted, ""twice""

",', o_orderstatus)"""
    if not broken:
        return sound
    return f"""CASE WHEN o_orderkey % 50 = 0 THEN concat(cast(o_orderkey as string), ',"x
y"')
    WHEN o_orderkey % 50 = 1 THEN concat(cast(o_orderkey as string), ',"x

y",,"z
or not"')
    WHEN o_orderkey % 50 = 2 THEN concat(cast(o_orderkey as string), ',"x
y"z')
    ELSE {sound} END"""


@case("ingest_quoted_errors", _error_sql(_quoted_record(True)))
def ingest_quoted_errors(spark, sf_dir):
    """Line breaks within quotes; the file is split where it may be, records are numbered through."""
    lines = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS key", f"{_quoted_record(True)} AS line"
    )
    path = _write_one_file(lines, "id,priority,status", "quoted")
    return scour.ingest_csv(spark, path, multi_line=True).errors


@case(
    "ingest_quoted",
    "SELECT o_orderkey AS id, concat(o_orderpriority, chr(10), 'quoted, \"twice\"', chr(10), chr(10)) "
    "AS priority, o_orderstatus AS status FROM orders",
)
def ingest_quoted(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS key", f"{_quoted_record(False)} AS line"
    )
    path = _write_one_file(lines, "id,priority,status", "quoted")
    return scour.ingest_csv(spark, path, multi_line=True).data


@case(
    "ingest_encoding",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'encoding_error' AS issue_type, "
    "'fatal_error' AS status FROM orders WHERE o_orderkey % 40 = 0",
)
def ingest_encoding(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr(
        """concat(cast(o_orderkey as string), ',', CASE WHEN o_orderkey % 40 = 0
        THEN cast(unhex('FFFE') as string) ELSE o_orderpriority END) AS line"""
    )
    # As plain text: a CSV writer would replace the broken bytes.
    path = scratch_path(spark, "encoding")
    lines.write.text(path)
    result = scour.ingest_csv(spark, path)
    rejected = csv_files.structural_errors(spark, path, ["id", "priority"])
    return rejected.select(
        F.split_part(F.make_valid_utf8("raw_content"), F.lit(","), F.lit(1)).alias("id"),
        "issue_type",
        F.lit(result.status).alias("status"),
    )


@case(
    "ingest_empty",
    "SELECT 'blank' AS folder, 'empty_file' AS issue_type, count(*) > 0 AS fatal FROM orders",
)
def ingest_empty(spark, sf_dir):
    """Lines of white space only: all of them are looked at before the file counts as empty."""
    lines = table(spark, sf_dir, "orders").select(
        F.repeat(F.lit(" "), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("line")
    )
    path = scratch_path(spark, "blank")
    lines.write.text(path)
    result = scour.ingest_csv(spark, path)
    return result.errors.select(
        F.lit("blank").alias("folder"),
        "issue_type",
        F.lit(result.status == csv_files.FATAL).alias("fatal"),
    )


RAW_COLUMNS = ("id_text", "padded", "price_text", "blank", "mixed")


@case(
    "infer_numeric",
    with_views(
        ["raw_orders"],
        "SELECT row_id, CAST(id_text AS BIGINT) AS id_text, padded, "
        "CAST(nullif(price_text, '') AS DOUBLE) AS price_text, CAST(NULL AS DOUBLE) AS blank, "
        "mixed FROM raw_orders",
    ),
)
def infer_numeric(spark, sf_dir):
    return inference.safe_infer(view(spark, sf_dir, "raw_orders").select("row_id", *RAW_COLUMNS))


@case(
    "infer_datetime",
    with_views(
        ["raw_orders"],
        f"SELECT row_id, {_day('CAST(iso_day AS TIMESTAMP)')} AS iso_day, "
        f"{_day(sql.parsed('slash_day', False))} AS slash_day, holed_day FROM raw_orders",
    ),
)
def infer_datetime(spark, sf_dir):
    df = view(spark, sf_dir, "raw_orders").select("row_id", "iso_day", "slash_day", "holed_day")
    return _days(inference.safe_infer(df), "iso_day", "slash_day")


@case(
    "sink_csv",
    with_views(
        ["messy_parts"],
        "SELECT *, p_size * CAST(0.5 AS DOUBLE) AS half FROM messy_parts",
    ),
)
def sink_csv(spark, sf_dir):
    df = view(spark, sf_dir, "messy_parts").withColumn("half", F.col("p_size") * F.lit(0.5))
    return scour.load_csv(spark, _save(df, "sink"), schema=df.schema)


@case(
    "sample_rows",
    with_views(["messy_orders"], "SELECT * FROM messy_orders ORDER BY row_id LIMIT 3"),
)
def sample_rows(spark, sf_dir):
    return scour.sample_rows(view(spark, sf_dir, "messy_orders"), "row_id")
