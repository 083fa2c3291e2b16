"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes.

Each site (host and path) is expanded into the expressions that a rule could be written as. They
meet the rules in an equi-join on the first 32 bits of a digest, and the full digests decide. Only
expressions in a shape that some rule has (so many host labels, so many path characters) are made,
so a URL with thousands of labels costs no more than another.

Defined cases: a null URL or one without `://` has an empty host and path. Ports and user names are
part of the host. Rules without a host fit every host. The rule with the most characters wins, then
the one with the longer host, then `block`. A null host or path of a rule is empty, a rule without
an action is ignored. Repeated pages are judged alike and all returned. Empty tables give no rows,
or the default verdict for all. Other columns of the pages are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_DIGITS = 8


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two parts that rules speak of, both empty if there is no scheme."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(_lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    return F.when(host == "", F.lit(0)).otherwise(dots + 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prepared(rules: DataFrame) -> DataFrame:
    named = rules.where(F.col("action").isNotNull()).select(
        F.col("action"),
        _lower_ascii(F.coalesce("host", F.lit(""))).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
    )
    return named.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn(
        "rule_digest", _digest(F.col("rule"))
    )


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    host, path = F.col("host"), F.col("path")
    made = [
        F.when(
            (_labels(host) >= labels) & (F.length(path) >= characters),
            F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, characters)),
        )
        for labels, characters in shapes
    ]
    return F.filter(F.array(*made), lambda expression: expression.isNotNull())


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Key, host, path, rule (null if none fits) and verdict for each page.

    `rules` has the columns action, host and path. The distinct shapes of the rules come to the
    driver: pairs of a label count and a path length, a number that does not grow with the pages.
    """
    host, path = host_and_path(F.col(url))
    sites = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    prepared = _prepared(rules)
    shapes = [
        tuple(row)
        for row in prepared.select(_labels(F.col("rule_host")), F.length("rule_path"))
        .distinct()
        .collect()
    ]
    if not shapes:
        return sites.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    expanded = (
        sites.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(_expressions(sorted(shapes))).alias("expression"))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("short", F.substring("digest", 1, HASH_DIGITS))
    )
    keyed = prepared.withColumn("short", F.substring("rule_digest", 1, HASH_DIGITS))
    precedence = F.struct(
        F.length("rule").alias("characters"),
        F.length("rule_host").alias("host_characters"),
        (F.col("action") == "block").alias("blocks"),
        F.col("rule"),
        F.col("action"),
    )
    best = (
        expanded.join(keyed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(precedence).alias("best"))
    )
    return sites.join(best, ["host", "path"], "left").select(
        key,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table from (action, host, path) triples."""
    row = "SELECT CAST(NULL AS STRING) AS action, CAST(NULL AS STRING) AS host, CAST(NULL AS STRING) AS path"
    empty = spark.sql(row).where(F.lit(False))
    one = spark.range(1)
    parts = [
        one.select(*[F.lit(value).alias(name) for name, value in zip(empty.columns, rule)])
        for rule in rules
    ]
    return reduce(DataFrame.unionByName, parts, empty)
