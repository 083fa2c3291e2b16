import math
import random
import statistics

import pytest
from conftest import column, rows

import scour
from scour.operators import columns as column_ops
from scour.operators import dedup, missing
from scour.operators.quantiles import exact_medians

PEOPLE = [("A", 20.0), ("B", 21.0), ("B", 21.0)]


def test_remove_duplicates(make):
    df = make("name string, age double", PEOPLE)
    assert rows(scour.remove_duplicates(df)) == [(0, "A", 20.0), (1, "B", 21.0)]
    log = dedup.remove_duplicates_log(df)
    assert rows(log) == [(2, "*", "Duplicate row", "Removed", "Removed duplicate row")]
    again = scour.remove_duplicates(scour.remove_duplicates(df))
    assert rows(again) == rows(scour.remove_duplicates(df))
    assert scour.remove_duplicates(df.drop("row_id"), None).count() == 2
    assert rows(scour.duplicate_count(df)) == [(3, 2, 1)]


def test_missing_equals_missing_in_keys(make):
    df = make("k string, x double", [("a", None), ("a", math.nan), (None, 1.0), (None, 1.0)])
    assert column(scour.remove_duplicates(df), "row_id") == [0, 2]
    assert column(scour.drop_duplicates(df, ["k", "x"]), "row_id") == [0, 2]
    assert column(scour.drop_duplicates(df, ["k"]), "row_id") == [0, 2]


def test_one_hot_key(make):
    """A key with a third of the rows: the plan limits each task's rows before the shuffle."""
    values = [("hot" if i % 3 == 0 else f"k{i}",) for i in range(3000)]
    df = make("k string", values)
    assert scour.drop_duplicates(df, ["k"]).count() == 2001
    plan = scour.drop_duplicates(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert dedup.duplicate_rows(df).count() == 999


def test_drop_missing(make):
    df = make("a double, b string", [(1.0, "x"), (None, "y"), (math.nan, "z"), (2.0, None)])
    assert column(scour.drop_missing(df), "row_id") == [0]
    assert column(missing.drop_missing_log(df), "row_id") == [1, 2, 3]


def test_fills(make):
    df = make(
        "age double, marks bigint, full bigint, city string, none double",
        [
            (20.0, 70, 1, "Bengaluru", None),
            (30.0, None, 2, "Mysuru", None),
            (None, 90, 3, None, None),
            (math.nan, 80, 4, None, None),
        ],
    )
    mean = scour.fill_numeric(df, "mean")
    assert column(mean, "age") == [20.0, 30.0, 25.0, 25.0]
    median = scour.fill_numeric(df, "median")
    assert column(median, "marks") == [70.0, 80.0, 90.0, 80.0]
    # A filled column is double, a full one and one without any value stay as they are.
    types = dict(median.dtypes)
    assert types["marks"] == "double" and types["full"] == "bigint"
    assert column(median, "none") == [None] * 4
    assert column(scour.fill_categorical(df), "city") == ["Bengaluru", "Mysuru"] + ["Bengaluru"] * 2
    log = rows(missing.fill_numeric_log(df, "median", "age"))
    reason = "Filled missing value using median"
    assert log == [(2, "age", "NaN", "25.0", reason), (3, "age", "NaN", "25.0", reason)]


def test_fill_requests(make):
    df = make("age double, city string", [(1.0, "x"), (None, None)])
    for call in (
        lambda: scour.fill_numeric(df, "mode"),
        lambda: scour.fill_numeric(df, "mean", "city"),
        lambda: scour.fill_numeric(df, "mean", "ghost"),
        lambda: scour.fill_categorical(df, "mode", "age"),
        lambda: scour.fill_categorical(df, "median"),
    ):
        with pytest.raises(ValueError):
            call()


def test_mode_of_other_types(make):
    import datetime as dt

    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 1), None, dt.date(2024, 1, 2)]
    df = make("d date, b boolean", list(zip(days, [True, None, False, False])))
    filled = scour.fill_categorical(df)
    assert dict(filled.dtypes)["d"] == "date"
    assert column(filled, "d")[2] == dt.date(2024, 1, 2)
    assert column(filled, "b") == [True, False, False, False]


@pytest.mark.parametrize("seed", range(4))
def test_exact_median_with_narrow_limits(make, seed):
    """Tiny limits and coarse sketches force many rounds; the result stays exact."""
    draw = random.Random(seed)
    spread = [draw.uniform(-1000, 1000) for _ in range(400 + seed)]
    hot = [draw.choice([5.0, 5.0, draw.uniform(0, 10)]) for _ in range(400 + seed)]
    flat = [1.0] * (400 + seed)
    df = make("a double, b double, c double", list(zip(spread, hot, flat)))
    count = len(spread)
    got = exact_medians(df, {"a": count, "b": count, "c": count}, rank_limit=7, accuracy=10)
    assert got == {
        "a": statistics.median(spread), "b": statistics.median(hot), "c": 1.0,
    }
    assert exact_medians(df, {"a": count})["a"] == statistics.median(spread)


def test_remove_units(make):
    df = make("w string", ["70kg", "60 kg", "55kg", "68", None, " 2.50 KG ", "5 kgs"])
    assert column(scour.remove_units(df, "w", "kg"), "w") == [
        "70", "60", "55", "68", None, "2.5", "5 kgs",
    ]
    assert column_ops.remove_units_log(df, "w", "kg").count() == 4
    numeric = scour.remove_units(df.where("row_id < 5"), "w", "kg", numeric=True)
    assert column(numeric, "w") == [70.0, 60.0, 55.0, 68.0, None]
    odd = make("p string", ["5 (m*)", "6"])
    assert column(scour.remove_units(odd, "p", "(m*)"), "p") == ["5", "6"]


@pytest.mark.parametrize(
    "values, target, expected",
    [
        (["250 g", "300 g", "2.5 kg"], "kg", ["0.25 kg", "0.3 kg", "2.5 kg"]),
        (["0.25 kg", "2.5 kg", "300 g"], "g", ["250 g", "2500 g", "300 g"]),
        (["1.7 m", "1.8 m", "170 cm"], "cm", ["170 cm", "180 cm", "170 cm"]),
        (["170 cm", "1.8 m"], "m", ["1.7 m", "1.8 m"]),
        (["5 lbs", "x", None, "3 m"], "kg", ["5 lbs", "x", None, "3 m"]),
        (["90 mins"], "Hours", ["1.5 Hours"]),
        (["5 g"], "parsec", ["5 g"]),
    ],
)
def test_standardize_units(make, values, target, expected):
    df = make("w string", values)
    assert column(scour.standardize_units(df, "w", target), "w") == expected


def test_standardize_units_log(make):
    df = make("w string", ["250 g", "1 kg"])
    assert rows(column_ops.standardize_units_log(df, "w", "kg")) == [
        (0, "w", "250 g", "0.25 kg", "Converted from g to kg")
    ]


def test_standardize_text(make):
    df = make("g string, n bigint", [("male", 1), ("FEMALE", 2), (" Male ", 3), ("Female", 4)])
    assert column(scour.standardize_text(df, "g", "title"), "g") == [
        "Male", "Female", "Male", "Female",
    ]
    assert column_ops.standardize_text_log(df, "g", "title").count() == 3
    with pytest.raises(TypeError):
        scour.standardize_text(df, "n", "title")


def test_normalize_text(make):
    df = make("city string, n bigint", [("Mysore  ", 1), ("Delhi  \t City", 2), (None, 3)])
    collapsed = scour.normalize_text(df, "collapse_whitespace", ["city"])
    assert column(collapsed, "city") == ["Mysore", "Delhi City", None]
    assert column(scour.normalize_text(df, "upper"), "city")[0] == "MYSORE  "
    assert column(scour.normalize_text(df, "lower", "all_string"), "n") == [1, 2, 3]
    with pytest.raises(TypeError):
        scour.normalize_text(df, "strip", ["n"])


@pytest.mark.parametrize(
    "value, interpretation, target, expected",
    [
        ("07-08-2026", "DD-MM-YYYY", "YYYY-MM-DD", "2026-08-07"),
        ("07-08-2026", "MM-DD-YYYY", "YYYY-MM-DD", "2026-07-08"),
        ("13-08-2026", "MM-DD-YYYY", "YYYY-MM-DD", "2026-08-13"),
        ("31-01-2026", "DD-MM-YYYY", "Month DD, YYYY", "January 31, 2026"),
        ("01-02-2026", "MM-DD-YYYY", "DD-MM-YYYY", "02-01-2026"),
        ("2026-05-10", "YYYY-MM-DD", "DD-MM-YYYY", "10-05-2026"),
        ("invalid-date", "DD-MM-YYYY", "YYYY-MM-DD", "invalid-date"),
        (" 2026-05-10 ", "DD-MM-YYYY", "YYYY-MM-DD", " 2026-05-10 "),
        (None, "DD-MM-YYYY", "YYYY-MM-DD", None),
    ],
)
def test_date_format(make, value, interpretation, target, expected):
    df = make("d string", [value, "1/2/2024"])
    assert column(scour.date_format(df, "d", interpretation, target), "d")[0] == expected


def test_date_format_log(make):
    df = make("d string", ["07-08-2026", "2026-08-07"])
    reason = "Converted date to YYYY-MM-DD using user-selected interpretation"
    assert rows(column_ops.date_format_log(df, "d", "DD-MM-YYYY", "YYYY-MM-DD")) == [
        (0, "d", "07-08-2026", "2026-08-07", reason)
    ]
    with pytest.raises(ValueError):
        scour.date_format(df, "d", "DD-MM-YYYY", "YYYY/MM/DD")


def test_rules(make):
    df = make(
        "n double, city string",
        [(10.0, "a"), (20.0, None), (120.0, "c"), (math.nan, "b"), (None, "a")],
    )

    def broken(rule, name, value=None):
        found = scour.violations(df, [{"rule": rule, "column": name, "value": value}])
        return column(found, "row_id")

    assert broken("min", "n", 15) == [0]
    assert broken("max", "n", 100) == [2]
    assert broken("not-null", "city") == [1]
    assert broken("not-null", "n") == [3, 4]
    assert broken("allowed-values", "city", ["a", "b"]) == [2]
    # Texts never equal numbers, so every present value breaks this rule.
    assert broken("allowed-values", "n", ["10", "20"]) == [0, 1, 2]
    assert broken("allowed-values", "n", [10, 20]) == [2]


def test_rule_checks(make):
    df = make("n double, city string", [(1.0, "a")])
    bad = [
        [],
        [{"rule": "min", "column": "ghost", "value": 1}],
        [{"rule": "min", "column": "city", "value": 1}],
        [{"rule": "max", "column": "n", "value": "x"}],
        [{"rule": "allowed-values", "column": "city", "value": []}],
        [{"rule": "odd", "column": "n", "value": 1}],
        [{"rule": "min", "column": "n", "value": 5}, {"rule": "max", "column": "n", "value": 4}],
    ]
    for rules in bad:
        with pytest.raises(ValueError):
            scour.violations(df, rules)


def test_validation_report_shows_ten_rows(make):
    df = make("n bigint", range(50))
    rules = [{"rule": "min", "column": "n", "value": 30}, {"rule": "max", "column": "n", "value": 99}]
    report = scour.validation_report(df, rules).orderBy("rule_index").collect()
    assert (report[0].violations, report[0].first_rows, report[0].status) == (
        30, list(range(10)), "FAILED",
    )
    assert (report[1].violations, report[1].first_rows, report[1].status) == (0, [], "PASSED")
    assert rows(scour.validation_summary(df, rules)) == [(50, 30, "FAILED")]


def test_sort_puts_missing_last(make):
    df = make("x double, k string", [(2.0, "b"), (None, "a"), (math.nan, "c"), (1.0, None)])
    up = [r.row_id for r in scour.sort_rows(df, ["x"], row_id="row_id").collect()]
    down = [r.row_id for r in scour.sort_rows(df, ["x"], [False], row_id="row_id").collect()]
    assert up == [3, 0, 1, 2] and down == [0, 3, 1, 2]
    with pytest.raises(ValueError):
        scour.sort_rows(df, ["x"], [True, False])


def test_select_drop_sample(make):
    df = make("a bigint, b double", [(1, math.nan), (2, 2.0), (3, 3.0), (4, 4.0)])
    assert scour.select_columns(df, ["b", "a"]).columns == ["b", "a"]
    assert scour.drop_columns(df, ["b"]).columns == ["row_id", "a"]
    with pytest.raises(ValueError):
        scour.drop_columns(df, ["ghost"])
    assert rows(scour.sample_rows(df, "row_id")) == [(0, 1, None), (1, 2, 2.0), (2, 3, 3.0)]


def test_clean(make):
    df = make(
        "name string, weight string, age double",
        [(" ann", "70kg", 20.0), (" ann", "70kg", 20.0), ("BOB", "60", None), (None, "5 kg", 40.0)],
    )
    result = scour.clean(
        df, remove_duplicates=True, fill_numeric="mean", fill_categorical="mode",
        remove_units=("weight", "kg"), standardize_text=("name", "title"),
    )
    assert rows(result.data) == [
        (0, "Ann", "70", 20.0), (2, "Bob", "60", 80 / 3), (3, "Ann", "5", 40.0),
    ]
    assert rows(result.stats) == [(4, 3, 0, 1, 0)]
    kinds = sorted(row.reason.split(" ")[0] for row in result.log.collect())
    assert kinds == ["Filled"] * 2 + ["Removed"] * 3 + ["Standardized"] * 3
    dropped = scour.clean(df, drop_missing=True)
    assert rows(dropped.stats) == [(4, 2, 2, 0, 0)]
    for request in ({}, {"drop_missing": True, "fill_numeric": "mean"}):
        with pytest.raises(ValueError):
            scour.clean(df, **request)
