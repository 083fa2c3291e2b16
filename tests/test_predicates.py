import datetime as dt
import math

import pytest
from conftest import column

import scour
from scour.functions.predicates import check_condition

VALUES = [1.0, None, 3.0, math.nan]


def leaf(operator, name, value=None):
    return {"operator": operator, "column": name, "value": value}


def negated(condition):
    return {"operator": "not", "conditions": [condition]}


@pytest.fixture
def numbers(make):
    return make("x double", VALUES)


@pytest.mark.parametrize(
    "condition, kept",
    [
        (leaf("equals", "x", 1), [0]),
        (leaf("not_equals", "x", 1), [1, 2, 3]),
        (leaf("gt", "x", 1), [2]),
        (leaf("gte", "x", 1), [0, 2]),
        (leaf("lt", "x", 3), [0]),
        (leaf("lte", "x", 3), [0, 2]),
        (leaf("is_null", "x"), [1, 3]),
        (leaf("is_not_null", "x"), [0, 2]),
        (leaf("in", "x", [1, 5]), [0]),
        (leaf("in", "x", [None, 3]), [1, 2, 3]),
        (leaf("in", "x", []), []),
        (leaf("not_in", "x", [1]), [1, 2, 3]),
        (leaf("between", "x", [1, 3]), [0, 2]),
        (leaf("equals", "x", math.nan), []),
        (leaf("equals", "x", "1"), []),
        (leaf("not_equals", "x", "1"), [0, 1, 2, 3]),
    ],
)
def test_leaves_and_their_negation(numbers, condition, kept):
    everything = range(len(VALUES))
    assert column(scour.filter_rows(numbers, condition), "row_id") == kept
    rest = [i for i in everything if i not in kept]
    assert column(scour.filter_rows(numbers, negated(condition)), "row_id") == rest
    assert column(scour.filter_rows(numbers, condition, remove=True), "row_id") == rest


def test_text_leaves(make):
    df = make("t string", ["a string", "42", None, "Another STRING", "stringent"])
    assert column(scour.filter_rows(df, leaf("contains", "t", "String")), "row_id") == [0, 3, 4]
    assert column(scour.filter_rows(df, leaf("starts_with", "t", "string")), "row_id") == [4]
    assert column(scour.filter_rows(df, leaf("ends_with", "t", "STRING")), "row_id") == [3]
    # A wildcard is an ordinary character.
    assert column(scour.filter_rows(df, leaf("contains", "t", "%")), "row_id") == []


def test_type_errors(make):
    df = make("n bigint, t string, d timestamp", [(1, "a", dt.datetime(2024, 1, 2))])
    for condition in (
        leaf("contains", "n", "1"), leaf("gt", "n", "5"), leaf("lt", "t", 5),
        leaf("between", "n", [1, "x"]), leaf("gt", "d", "June"),
    ):
        with pytest.raises(TypeError):
            scour.filter_rows(df, condition)
    assert scour.filter_rows(df, leaf("equals", "d", "June")).count() == 0
    assert scour.filter_rows(df, leaf("equals", "d", "2024-01-02")).count() == 1
    assert scour.filter_rows(df, leaf("gt", "d", "2024-01-01")).count() == 1
    with pytest.raises(ValueError):
        scour.filter_rows(df, leaf("equals", "ghost", 1))


@pytest.mark.parametrize(
    "condition",
    [
        {"operator": "and"},
        {"operator": "not", "conditions": [leaf("is_null", "x"), leaf("is_null", "x")]},
        {"operator": "or", "conditions": [leaf("is_null", "x")], "column": "x"},
        leaf("is_null", "x", 1),
        leaf("between", "x", [10]),
        leaf("in", "x", 3),
        leaf("equals", "x"),
        {"operator": "equals", "value": 1},
        {"operator": "like", "column": "x", "value": "a"},
        {**leaf("equals", "x", 1), "conditions": []},
    ],
)
def test_malformed_conditions(condition):
    with pytest.raises(ValueError):
        check_condition(condition)


def test_filters_reach_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "t")
    make("x double, t string", [(1.0, "a"), (None, None)]).write.parquet(path)
    df = spark.read.parquet(path)

    def pushed(condition):
        plan = scour.filter_rows(df, condition)._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [")[1].split("]")[0]

    assert "EqualNullSafe(x,1.0)" in pushed(leaf("equals", "x", 1.0))
    assert "GreaterThan(x,1.0)" in pushed(leaf("gt", "x", 1.0))
    assert "LessThan" in pushed(negated(leaf("lte", "x", 1.0))) or "GreaterThan" in pushed(
        negated(leaf("lte", "x", 1.0))
    )
    assert "StringStartsWith(t,a)" in pushed(leaf("starts_with", "t", "a"))
