"""Values and names with a meaning of their own in SQL text, and numbers that doubles would round."""

import pytest
from conftest import column

import scour
from scour.operators import columns as column_ops
from scour.operators import dedup

USER = "${system:user.name}"


def test_settings_in_values(spark, make):
    df = make("a string", [USER, USER, None, "b"])
    filled = scour.clean(df, fill_categorical="mode")
    assert column(filled.data, "a") == [USER, USER, USER, "b"]
    assert [r.cleaned_value for r in filled.log.collect()] == [USER]
    found = scour.find_value_columns(df, USER).collect()
    assert len(found) == 1
    kept = scour.filter_rows(df, {"operator": "equals", "column": "a", "value": USER})
    assert kept.count() == 2


def test_settings_in_names(spark, make):
    df = make("a string", ["x"]).withColumnRenamed("a", USER)
    with pytest.raises(ValueError, match="rename"):
        column_ops.remove_units(df, USER, "kg")


@pytest.mark.parametrize("name", ["raw__text", "raw__number", "x__cleaned", "__text_1", "__cleaned_1"])
def test_names_like_steps(spark, make, name):
    df = make("a string, n string", [("5 kg", "v__cleaned"), (None, "v__text")])
    df = df.withColumnRenamed("a", name)
    assert column(column_ops.remove_units(df, name, "kg"), name) == ["5", None]
    assert column(column_ops.standardize_units(df, name, "g"), name) == ["5000 g", None]
    assert column(column_ops.standardize_text(df, name, "upper"), name) == ["5 KG", None]
    log = column_ops.standardize_text_log(df, "n", "upper").collect()
    assert [r.original_value for r in log] == ["v__cleaned", "v__text"]


def test_no_break_space(spark, make):
    df = make("a string", ["5\u00a0kg", "2 kg"])
    assert column(column_ops.remove_units(df, "a", "kg"), "a") == ["5", "2"]
    assert column(column_ops.standardize_units(df, "a", "g"), "a") == ["5000 g", "2000 g"]


def test_long_integers(spark, make):
    df = make(
        "exact string, huge string, holed string, small string",
        [
            ("1700000000000000001", "1234567890123456789012345", "9007199254740993", "1"),
            ("1700000000000000002", "1234567890123456789012346", "", ""),
        ],
    )
    typed = scour.safe_infer(df)
    assert column(typed, "exact") == [1700000000000000001, 1700000000000000002]
    assert column(typed, "huge") == ["1234567890123456789012345", "1234567890123456789012346"]
    assert column(typed, "holed") == ["9007199254740993", ""]
    assert column(typed, "small") == [1.0, None]


def test_empty_subset(spark, make):
    with pytest.raises(ValueError):
        dedup.drop_duplicates(make("a bigint", [1, 2]), [])


def test_rule_value_is_whole(spark, make):
    df = make("a double", [1.0])
    rules = [{"rule": "max", "column": "a", "value": v} for v in (1234567.5, 100.0, 7)]
    shown = sorted(r.rule_value for r in scour.validation_report(df, rules).collect())
    assert shown == ["100", "1234567.5", "7"]
