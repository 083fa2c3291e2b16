"""Sketches of distinct values: error, merging, missing cells, plan."""

import pytest

from scour.operators import context, uniques


def test_error_and_exact_small_counts(spark):
    df = spark.range(60_000).selectExpr(
        "id AS row_id", "id % 20000 AS many", "concat('v', id % 7) AS few",
        "CASE WHEN id % 2 = 0 THEN double('NaN') ELSE 1D END AS holed", "CAST(NULL AS STRING) AS none",
    )
    exact = {r["column"]: r for r in context.column_statistics(df).collect()}
    found = {r["column"]: r for r in uniques.approximate_unique(df).collect()}
    assert found.keys() == exact.keys()
    for name, row in found.items():
        assert (row["rows"], row["missing"]) == (exact[name]["rows"], exact[name]["missing"])
        error = abs(row["distinct_values"] - exact[name]["distinct_values"])
        assert error <= 4 * uniques.relative_error() * exact[name]["distinct_values"]
    assert [found[n]["distinct_values"] for n in ("few", "holed", "none")] == [7, 1, 0]


def test_loads_merge_as_one_table(spark, tmp_path):
    whole = spark.range(9_000).selectExpr("id AS row_id", "id % 4000 AS a", "id % 3 = 0 AS b")
    loads = [whole.where(f"row_id % 3 = {i}") for i in range(3)]
    paths = [str(tmp_path / str(i)) for i in range(3)]
    for load, path in zip(loads, paths):
        uniques.unique_sketches(load).write.parquet(path)
    merged = uniques.merge_sketches(*map(spark.read.parquet, paths))
    found = {r["column"]: r["distinct_values"] for r in uniques.estimate_unique(merged).collect()}
    once = {r["column"]: r["distinct_values"] for r in uniques.approximate_unique(whole).collect()}
    assert found["b"] == once["b"] == 2
    for counted in (found["a"], once["a"]):
        assert abs(counted - 4000) <= 4 * uniques.relative_error() * 4000


def test_merging_other_columns_and_precisions(spark):
    one = uniques.unique_sketches(spark.range(10).selectExpr("id AS row_id", "id AS a"), lg_k=10)
    two = uniques.unique_sketches(spark.range(5).selectExpr("id AS row_id", "id + 8 AS a", "id AS b"))
    rows = uniques.estimate_unique(uniques.merge_sketches(one, two)).collect()
    assert {tuple(r) for r in rows} == {("a", 15, 0, 13), ("b", 5, 0, 5)}


def test_empty_table_and_refusals(spark):
    empty = spark.range(0).selectExpr("id AS row_id", "id AS `a b`")
    assert [tuple(r) for r in uniques.approximate_unique(empty).collect()] == [("a b", 0, 0, 0)]
    with pytest.raises(ValueError, match="lg_k"):
        uniques.unique_sketches(empty, lg_k=30)
    with pytest.raises(ValueError, match="no data columns"):
        uniques.unique_sketches(empty.select("row_id"))
    with pytest.raises(ValueError, match="no sketches"):
        uniques.merge_sketches()


def test_distinct_values_are_not_shuffled(spark):
    df = spark.range(100).selectExpr("id AS row_id", "id AS a", "id % 3 AS b")
    plan = uniques.approximate_unique(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
