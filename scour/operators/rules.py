"""Rule validation: minimum, maximum, not-null and allowed values, all in one scan.

A rule is a dict `{"rule": "min" | "max" | "not-null" | "allowed-values", "column": …, "value": …}`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.missing import is_missing
from scour.functions.predicates import build_condition
from scour.schema import column_types, is_numeric, ref, require_row_id
from scour.streaming.guards import require_batch

RULES = ("min", "max", "not-null", "allowed-values")
SHOWN_ROWS = 10


def check_rules(rules: Sequence[Mapping], schema: T.StructType) -> None:
    """Raise ValueError unless all rules fit the table."""
    types = column_types(schema)
    if not rules:
        raise ValueError("No validation rule was given")
    bounds: dict[str, dict[str, float]] = {}
    for rule in rules:
        kind, column, value = rule.get("rule"), rule.get("column"), rule.get("value")
        if kind not in RULES:
            raise ValueError(f"Unknown rule {kind!r}; use one of {', '.join(RULES)}")
        if column not in types:
            raise ValueError(f"Column {column!r} does not exist")
        if kind in ("min", "max"):
            if not is_numeric(types[column]):
                raise ValueError(f"Rule {kind!r} needs a numeric column; {column!r} is not")
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"Rule {kind!r} on {column!r} needs a number, not {value!r}")
            bounds.setdefault(column, {})[kind] = value
        if kind == "allowed-values" and not value:
            raise ValueError(f"Rule 'allowed-values' on {column!r} needs a list of values")
    for column, limit in bounds.items():
        if "min" in limit and "max" in limit and limit["min"] > limit["max"]:
            raise ValueError(f"The minimum of {column!r} is greater than its maximum")


def violates(rule: Mapping, schema: T.StructType) -> Column:
    """TRUE where a row breaks the rule, FALSE elsewhere."""
    column, value = rule["column"], rule.get("value")
    dtype = column_types(schema)[column]
    if rule["rule"] == "not-null":
        return F.expr(is_missing(column, dtype))
    if rule["rule"] == "allowed-values":
        outside = build_condition(
            {"operator": "not_in", "column": column, "value": list(value)}, schema
        )
        return ~F.expr(is_missing(column, dtype)) & outside
    operator = "lt" if rule["rule"] == "min" else "gt"
    return build_condition({"operator": operator, "column": column, "value": value}, schema)


def _rule_value(rule: Mapping) -> str | None:
    value = rule.get("value")
    if rule["rule"] == "not-null":
        return None
    if rule["rule"] == "allowed-values":
        return ",".join(map(str, value))
    whole = isinstance(value, float) and value.is_integer() and abs(value) < 1e15
    return str(int(value) if whole else value)


def _describe(rule: Mapping, index: int) -> list[Column]:
    return [
        F.lit(index).alias("rule_index"),
        F.lit(rule["rule"]).alias("rule"),
        F.lit(rule["column"]).alias("column"),
        F.lit(_rule_value(rule)).cast("string").alias("rule_value"),
    ]


def violations(df: DataFrame, rules: Sequence[Mapping], row_id: str = "row_id") -> DataFrame:
    """One row per broken rule and row. Rows that break no rule are filtered out at the scan."""
    check_rules(rules, df.schema)
    require_row_id(df, row_id, "violations")
    tests = [violates(rule, df.schema) for rule in rules]
    broken = [
        F.when(test, F.struct(*_describe(rule, i)))
        for i, (rule, test) in enumerate(zip(rules, tests))
    ]
    return (
        df.where(reduce(Column.__or__, tests))
        .select(ref(row_id).alias("row_id"), F.explode(F.array(*broken)).alias("broken"))
        .where(F.col("broken").isNotNull())
        .select("broken.*", "row_id")
    )


def rule_counts(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """One row per rule with the number of rows that break it, from one aggregate."""
    require_batch(df, "rule_counts")
    check_rules(rules, df.schema)
    counts = [
        F.count_if(violates(rule, df.schema)).alias(f"n{i}") for i, rule in enumerate(rules)
    ]
    rows = [
        F.struct(*_describe(rule, i), F.col(f"n{i}").alias("violations"))
        for i, rule in enumerate(rules)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def validation_report(
    df: DataFrame, rules: Sequence[Mapping], row_id: str = "row_id"
) -> DataFrame:
    """Per rule: the count, the first ten row identities, and PASSED or FAILED.

    The ten rows come from a rank filter that Spark applies before the shuffle as well, so at most
    ten rows per rule leave a task.
    """
    require_batch(df, "validation_report")
    order = Window.partitionBy("rule_index").orderBy("row_id")
    first = (
        violations(df, rules, row_id)
        .select("rule_index", "row_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= SHOWN_ROWS)
        .groupBy("rule_index")
        .agg(F.array_sort(F.collect_list("row_id")).alias("first_rows"))
    )
    no_rows = F.array().cast(T.ArrayType(df.schema[row_id].dataType))
    # Ten identities per rule: the side is as small as the rule list.
    return (
        rule_counts(df, rules)
        .join(F.broadcast(first), "rule_index", "left")
        .select(
            "rule_index",
            "rule",
            "column",
            "rule_value",
            "violations",
            F.coalesce("first_rows", no_rows).alias("first_rows"),
            F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED").alias("status"),
        )
    )


def validation_summary(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """One row: rows checked, violations over all rules, and the overall outcome."""
    require_batch(df, "validation_summary")
    check_rules(rules, df.schema)
    broken = reduce(Column.__add__, [violates(r, df.schema).cast("bigint") for r in rules])
    total = F.coalesce(F.sum(broken), F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("violations")).withColumn(
        "status", F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED")
    )
