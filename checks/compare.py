"""Run queries next to their oracle SQL and compare the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Spark type to DuckDB type; the queries return nothing else.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(
    spark: SparkSession, sf_dir: str, query, sql: str, connection=None
) -> str | None:
    """None if both agree on column names and rows, otherwise what differs."""
    connection = connection or oracle_connection(sf_dir)
    df = query(spark, sf_dir)
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    wanted = dict(zip(relation.columns, map(str, relation.types)))
    odd = {
        field.name: (field.dataType.simpleString(), wanted[field.name])
        for field in df.schema.fields
        if wanted[field.name] != TYPES.get(field.dataType.simpleString())
    }
    if odd:
        return f"types {odd}"
    ours = _rows(df.columns, df.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    if ours == theirs:
        return None
    more, less = ours - theirs, theirs - ours
    return (
        f"{sum(more.values())} rows only here, {sum(less.values())} only in the oracle; e.g. "
        f"{list(more)[:2]} / {list(less)[:2]}"
    )
