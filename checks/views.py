"""The tables the queries run on: the given ones, and messy views derived from them.

A view is a source table and a list of expressions that mean the same in Spark and in DuckDB, so
the query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _padded(part: str) -> str:
    return f"lpad(cast({part}(o_orderdate) as string), 2, '0')"


_YEAR = "cast(year(o_orderdate) as string)"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "messy_orders": (
        "orders",
        {
            "row_id": "o_orderkey",
            "customer_id": "o_custkey",
            "status": """CASE WHEN o_orderkey % 17 = 0 THEN NULL
                WHEN o_orderkey % 6 = 0 THEN 'Delivered' WHEN o_orderkey % 6 = 1 THEN 'delivered'
                WHEN o_orderkey % 6 = 2 THEN 'DELIVERED' WHEN o_orderkey % 6 = 3 THEN ' Delivered '
                ELSE 'Shipped' END""",
            "total_price": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END",
            "priority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
            "order_date": f"""CASE WHEN o_orderkey % 101 = 0 THEN 'invalid-date'
                WHEN o_orderkey % 4 = 0
                THEN concat({_padded('day')}, '-', {_padded('month')}, '-', {_YEAR})
                WHEN o_orderkey % 4 = 1
                THEN concat({_padded('day')}, '/', {_padded('month')}, '/', {_YEAR})
                ELSE concat({_YEAR}, '-', {_padded('month')}, '-', {_padded('day')}) END""",
        },
    ),
    "messy_parts": (
        "part",
        {
            "row_id": "p_partkey",
            "label": "concat('  ', upper(p_name), '   ', lower(p_brand), ' ')",
            "weight": """CASE WHEN p_partkey % 3 = 0 THEN concat(cast(p_size as string), ' kg')
                WHEN p_partkey % 3 = 1 THEN concat(cast(p_size * 250 as string), 'g')
                ELSE concat(cast(p_size as string), '.5 KG') END""",
            "quantity": """CASE WHEN p_partkey % 19 = 0 THEN NULL
                WHEN p_partkey % 5 = 0 THEN concat(cast(p_size as string), ' units')
                ELSE cast(p_size as string) END""",
            "height": "concat(cast(p_size as string), ' cm')",
            "mixed_dim": """CASE WHEN p_partkey % 2 = 0 THEN concat(cast(p_size as string), ' cm')
                ELSE concat(cast(p_size as string), ' kg') END""",
            "p_size": "p_size",
            "p_retailprice": "p_retailprice",
        },
    ),
    "dup_events": (
        "events",
        {
            "row_id": "event_id",
            "user_bucket": "user_id % 20",
            "event_type": "event_type",
            "value_bucket": """CASE WHEN event_id % 7 = 0 THEN NULL
                ELSE cast(floor(value / 50) as int) END""",
        },
    ),
    "line_items": (
        "lineitem",
        {
            "row_id": "(l_orderkey * 100000 + l_partkey) * 100000 + l_suppkey * 10 + l_linenumber",
            "l_quantity": "l_quantity",
            "l_extendedprice": "l_extendedprice",
            "l_discount": "l_discount",
            "l_tax": "l_tax",
            "l_returnflag": "l_returnflag",
            "l_linestatus": "l_linestatus",
            "l_linenumber": "l_linenumber",
        },
    ),
    "raw_orders": (
        "orders",
        {
            "row_id": "o_orderkey",
            "id_text": "cast(o_orderkey as string)",
            "padded": "lpad(cast(o_orderkey as string), 9, '0')",
            "price_text": """CASE WHEN o_orderkey % 13 = 0 THEN ''
                ELSE cast(o_custkey as string) END""",
            "blank": "CASE WHEN o_orderkey < 0 THEN 'x' ELSE '' END",
            "mixed": """CASE WHEN o_orderkey % 5 = 0 THEN 'unknown'
                ELSE cast(o_custkey as string) END""",
            "iso_day": f"concat({_YEAR}, '-', {_padded('month')}, '-', {_padded('day')})",
            "slash_day": f"concat({_padded('month')}, '/', {_padded('day')}, '/', {_YEAR})",
            "holed_day": f"""CASE WHEN o_orderkey % 7 = 0 THEN ''
                ELSE concat({_YEAR}, '-', {_padded('month')}, '-', {_padded('day')}) END""",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[f"{expression} AS {alias}" for alias, expression in columns.items()]
    )


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    listed = ", ".join(f"{expression} AS {alias}" for alias, expression in columns.items())
    return f"SELECT {listed} FROM {source}"


def with_views(names: list[str], body: str, *more: str) -> str:
    """The body with the views, and further `name AS (…)` entries, as common table expressions."""
    parts = [f"{name} AS ({view_sql(name)})" for name in names]
    return "WITH " + ", ".join([*parts, *more]) + " " + body


def columns_of(name: str, row_id: bool = False) -> list[str]:
    return [column for column in VIEWS[name][1] if row_id or column != "row_id"]
