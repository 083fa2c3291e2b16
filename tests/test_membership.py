"""Long lists and tables of values in `in` and `not_in`."""

import datetime as dt
import math

import pytest
from conftest import column

import scour
from scour.functions import membership


def leaf(operator, name, value):
    return {"operator": operator, "column": name, "value": value}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


CELLS = [(1, "a", 1.5, dt.date(2024, 5, 6)), (None, None, None, None), (2**53 + 1, "ß", math.nan, dt.date(1999, 1, 2))]
LISTS = {
    "n": [[1, 7], [1.0], [2**53 + 1], [None], ["1"], [1, None], [2**70]],
    "s": [["a"], ["ß", None], [1], ["A"]],
    "x": [[1.5], [math.nan], [2], [None, 1.5]],
    "d": [["2024-05-06"], [dt.date(1999, 1, 2), None], [dt.datetime(2024, 5, 6, 1)], [3]],
}


@pytest.mark.parametrize("name", sorted(LISTS))
@pytest.mark.parametrize("operator", ["in", "not_in"])
def test_joins_answer_as_literals(spark, make, monkeypatch, name, operator):
    df = make("n bigint, s string, x double, d date", CELLS)
    for values in LISTS[name]:
        for remove in (False, True):
            condition = leaf(operator, name, values)
            monkeypatch.setattr(membership, "LONGEST_LIST", 1000)
            wanted = column(scour.filter_rows(df, condition, remove=remove), "row_id")
            monkeypatch.setattr(membership, "LONGEST_LIST", 0)
            assert column(scour.filter_rows(df, condition, remove=remove), "row_id") == wanted, values


def test_a_million_values(spark, make):
    df = make("n bigint, s string", [(3, "3"), (4, None), (None, "999999999"), (1_999_999, "x")])
    values = list(range(1, 2_000_000, 2))
    found = scour.filter_rows(df, leaf("in", "n", values))
    assert "Join LeftSemi" in plan(found) and column(found, "row_id") == [0, 3]
    assert "(n#" in plan(found) and "<= 1999999" in plan(found)
    others = scour.filter_rows(df, leaf("not_in", "n", values))
    assert "Join LeftAnti" in plan(others) or "ExistenceJoin" in plan(others)
    assert column(others, "row_id") == [1, 2]
    steps = [{"op": "filter", "condition": {"operator": "or", "conditions": [
        leaf("in", "n", values), leaf("is_null", "s", None)]}}]
    assert column(scour.apply_pipeline(df, steps), "row_id") == [0, 1, 3]


def test_tables(spark, make):
    df = make("n bigint, x double", [(1, 1.0), (None, math.nan), (2, 5.0)])
    table = spark.createDataFrame([(1,), (1,), (9,)], "n int")
    with_null = spark.createDataFrame([(2,), (None,)], "x int")
    words = spark.createDataFrame([("1",)], "n string")
    assert column(scour.filter_rows(df, leaf("in", "n", table)), "row_id") == [0]
    assert column(scour.filter_rows(df, leaf("not_in", "n", table)), "row_id") == [1, 2]
    assert column(scour.filter_rows(df, leaf("in", "n", with_null)), "row_id") == [1, 2]
    assert column(scour.filter_rows(df, leaf("not_in", "x", with_null)), "row_id") == [0, 2]
    assert column(scour.filter_rows(df, leaf("in", "n", words)), "row_id") == []
    assert column(scour.filter_rows(df, leaf("in", "n", table.where("false"))), "row_id") == []
    odd = df.withColumnRenamed("n", "value")
    assert column(scour.filter_rows(odd, leaf("in", "value", table.toDF("value"))), "row_id") == [0]
    with pytest.raises(ValueError):
        scour.filter_rows(df, leaf("in", "n", table.selectExpr("n", "n AS m")))
    rule = {"rule": "allowed-values", "column": "n", "value": list(range(2, 3000))}
    assert column(scour.violations(df, [rule]), "row_id") == [0]
