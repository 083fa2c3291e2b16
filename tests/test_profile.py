import datetime as dt
import math

import pytest
from conftest import column, rows

import scour
from scour.operators import context, profile, suggest


def issues(df):
    return [tuple(r) for r in scour.analyze_quality(df).orderBy("issue_rank", "column").collect()]


def outcomes(report):
    return {(r.type, r.column): r for r in report.collect()}


def test_clean_data_has_no_issues(make):
    df = make("name string, age bigint", [("Rahul", 20), ("Arjun", 21), ("Sneha", 22)])
    assert issues(df) == []
    assert scour.suggest(df).count() == 0
    assert [r.issues for r in scour.profile_report(df).collect()] == [0] * 5


def test_issue_kinds(make):
    df = make(
        "name string, day string, weight string, age double",
        [
            ("Rahul", "2024-01-02", "10kg", 20.0),
            ("rahul", "02/01/2024", "20kg", math.nan),
            ("Sneha", "2024-01-03", "30g", 21.0),
            ("Sneha", "2024-01-03", "30g", 21.0),
        ],
    )
    assert issues(df) == [
        (1, "missing_values", "age", 1),
        (2, "duplicate_rows", None, 1),
        (3, "text_inconsistency", "name", 2),
        (4, "date_format_inconsistency", "day", 2),
        (5, "embedded_units", "weight", 3),
    ]
    formats = profile.date_formats(df).first().formats
    assert formats == ["YYYY-MM-DD", "DD/MM/YYYY or MM/DD/YYYY"]
    assert rows(profile.unit_values(df), "value", "n") == [("10kg", 1), ("20kg", 1), ("30g", 2)]
    assert rows(profile.date_columns(df)) == [("day", 1.0)]


def test_text_variants(make):
    df = make("city string", ["Bengaluru", "bengaluru", " Bengaluru ", "Mysuru", None])
    assert sorted(column(profile.text_variants(df), "variant", "variant")) == [
        " Bengaluru ", "Bengaluru", "bengaluru",
    ]


def test_one_unit_everywhere_is_no_issue(make):
    df = make("h string, w string", [("170 cm", "1 kg"), ("165cms", "2 g"), ("180 cm", None)])
    assert column(profile.embedded_units(df), "column", "column") == ["w"]


def test_inspect(make):
    df = make("a double, b string", [(1.0, "x"), (None, "x"), (math.nan, None), (1.0, "x")])
    assert rows(scour.inspect_columns(df), "column", "dtype", "missing", "missing_percent") == [
        ("a", "double", 2, 50.0), ("b", "string", 1, 25.0),
    ]
    assert rows(scour.inspect_table(df)) == [(4, 2, 1)]
    empty = df.where("false")
    assert column(scour.inspect_columns(empty), "missing_percent", "column") == [0.0, 0.0]
    assert rows(scour.inspect_table(empty)) == [(0, 2, 0)]


def context_of(df):
    return {r.column: r for r in scour.dataset_context(df).collect()}


def test_semantic_roles(make):
    day = dt.datetime(2023, 1, 1)
    df = make(
        "Patient_Age bigint, Yearly_Revenue double, Employee_ID string, Order_Date timestamp, "
        "Status string, Unknown_Metric double, Mixed_Data string, Contact_Email string, "
        "Full_Name string, Is_Active bigint, Random_Two_Vals string, Department string",
        [
            (25, 1000.5, "001", day, "A", 1.1, "100", "a@b.com", "Alice", 1, "Apple", "HR"),
            (30, 500.0, "002", day, "B", 2.2, "200", "c@d.com", "Bob", 0, "Orange", "IT"),
            (40, 2000.0, "003", day, "A", 3.3, "unknown", "e@f.com", "Charlie", 1, "Apple", "HR"),
            (110, 1500.0, "004", day, "C", 4.4, "300", "g@h.com", "David", 1, "Orange", "IT"),
        ],
    )
    found = {name: r.role for name, r in context_of(df).items()}
    assert found == {
        "Patient_Age": "age", "Yearly_Revenue": "monetary/numeric amount",
        "Employee_ID": "identifier", "Order_Date": "date/datetime", "Status": "categorical",
        "Unknown_Metric": "numeric", "Mixed_Data": "identifier", "Contact_Email": "email",
        "Full_Name": "name/text", "Is_Active": "boolean/binary", "Random_Two_Vals": "unknown",
        "Department": "categorical",
    }


def test_hints_ranges_and_categories(make):
    df = make(
        "id bigint, cat string, dt string, x double, flag boolean, gone string",
        [
            (1, "A", "2020-01-01", 1.0, True, None),
            (2, "B", "2020-01-02", math.inf, False, None),
            (3, "A", "2020-01-03", math.nan, True, None),
            (4, "B", "2020-01-04", -2.0, None, None),
            (5, "C", "2020-01-05", 0.0, None, None),
        ],
    )
    found = context_of(df)
    assert found["id"].hint == "Likely Identifier"
    assert found["cat"].hint == "Likely Categorical"
    assert found["cat"].top_categories == ["A", "B", "C"]
    assert found["dt"].hint == "Likely Date" and found["dt"].top_categories is None
    assert (found["dt"].date_min, found["dt"].date_max) == (
        dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 5),
    )
    assert found["flag"].hint == "Likely Boolean"
    # An infinite end of the range is not reported.
    assert (found["x"].min_value, found["x"].max_value, found["x"].missing) == (-2.0, None, 1)
    assert found["gone"].role == "unknown" and found["gone"].missing_fraction == 1.0


def test_context_of_an_empty_table(make):
    found = context_of(make("a bigint, b string", [(1, "x")]).where("false"))
    assert [found[name].rows for name in ("a", "b")] == [0, 0]
    assert found["b"].role == "unknown"


def test_phone_role(make):
    df = make("phone string, other string", [("+91 98765 43210", "555-0100 11"), ("(080) 123 4567", "555 0101 12")])
    found = context_of(df)
    assert (found["phone"].role, found["phone"].confidence) == ("phone", "high")
    assert (found["other"].role, found["other"].confidence) == ("phone", "medium")


def test_find_value_columns(make):
    df = make(
        "city string, age bigint, day string",
        [("NY", 20, "2024-01-01"), ("LA", 40, "2024-02-01")],
    )
    assert column(scour.find_value_columns(df, "LA"), "column", "position") == ["city"]
    assert column(scour.find_value_columns(df, 30, "number"), "column", "position") == ["age"]
    assert column(scour.find_value_columns(df, 50, "number"), "column", "position") == []
    assert column(scour.find_value_columns(df, "June", "date"), "column", "position") == ["day"]
    with pytest.raises(ValueError):
        scour.find_value_columns(df, 1, "month")


# --- suggestions ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "values, resolution, operation, parameter",
    [
        (["20", None, "30"], "SAFE_FIX", "fill_numeric", "median"),
        (["Apple", "Banana", None], "SAFE_FIX", "fill_categorical", "mode"),
        (["2", "5", "3 units", None, "1"], "MIXED_NUMERIC", "remove_units", "units"),
        (["2", "apple", None], "REVIEW_REQUIRED", None, None),
        (["2", "3 kg", "4 g", None], "REVIEW_REQUIRED", None, None),
    ],
)
def test_missing_suggestions(make, values, resolution, operation, parameter):
    found = outcomes(suggest.suggest_missing(make("q string", values)))["missing_values", "q"]
    assert (found.resolution_type, found.operation, found.parameter) == (
        resolution, operation, parameter,
    )


def test_missing_suggestion_of_a_numeric_column(make):
    found = outcomes(suggest.suggest_missing(make("age double", [20.0, None, 30.0])))
    assert found["missing_values", "age"].operation == "fill_numeric"


@pytest.mark.parametrize(
    "values, resolution, operation, parameter",
    [
        (["10kg", "20kg"], "SAFE_FIX", "remove_units", "kg"),
        (["70 km", "80km"], "SAFE_FIX", "remove_units", "km"),
        (["2", "5", "3 units", "1"], "MIXED_NUMERIC", "remove_units", "units"),
        (["70 kg", "250 g"], "STANDARDIZATION_AVAILABLE", "standardize_units", None),
        (["170 cm", "70 kg"], "REVIEW_REQUIRED", None, None),
        (["10kg", "20lbs"], "REVIEW_REQUIRED", None, None),
        (["2", "5", "apple", "3 units"], "REVIEW_REQUIRED", None, None),
        (["2", "5 kg", "3 units"], "REVIEW_REQUIRED", None, None),
        (["2", "3 units", None], "REVIEW_REQUIRED", None, None),
        (["x", "y"], "REVIEW_REQUIRED", None, None),
    ],
)
def test_unit_suggestions(make, values, resolution, operation, parameter):
    report = suggest.suggest_units(make("q string", values), columns=["q"])
    found = outcomes(report)["embedded_units", "q"]
    assert (found.resolution_type, found.operation, found.parameter) == (
        resolution, operation, parameter,
    )
    if resolution == "STANDARDIZATION_AVAILABLE":
        assert found.available_targets == ["mg", "g", "kg", "tonne"]
        assert found.detected_units == ["g", "kg"]
    if values == ["170 cm", "70 kg"]:
        assert "different categories" in found.message
    if resolution == "REVIEW_REQUIRED":
        assert found.message.startswith("Review required")


@pytest.mark.parametrize(
    "values, style",
    [
        (["Title"] * 6 + ["title"] * 4 + ["TITLE"] * 2, "title"),
        (["Title"] * 5 + ["title"] * 5 + ["TITLE"] * 2, None),
        (["title"] * 3 + ["TITLE"], "lower"),
        (["a b ", "a b", " a b"], "strip"),
    ],
)
def test_text_style_vote(make, values, style):
    found = outcomes(suggest.suggest_text_style(make("s string", values)))["text_inconsistency", "s"]
    assert found.parameter == style
    assert found.resolution_type == ("SAFE_FIX" if style else "REVIEW_REQUIRED")


def test_given_variants(make):
    df = make("city string", ["Bangalore", "Bengaluru"])
    report = suggest.suggest_text_style(df, variants={"city": ["Bangalore", "Bengaluru"]})
    assert report.first().resolution_type == "REVIEW_REQUIRED"


def test_hints(make):
    df = make("s string, w string", [("Ab", "1 kg"), ("ab", "2 kg"), ("AB", "3 kg"), ("aB", "4 kg")])
    hint = {("text_inconsistency", "s"): {"operation": "standardize_text", "parameters": {"style": "upper"}}}
    assert suggest.suggest_text_style(df, hints=hint).first().parameter == "upper"
    wrong = {("embedded_units", "w"): {"operation": "remove_units", "parameters": {"unit": "g"}}}
    assert suggest.suggest_units(df, hints=wrong, columns=["w"]).first().resolution_type == "REVIEW_REQUIRED"
    twice = make("a bigint", [1, 1])
    other = {("duplicate_rows", None): {"operation": "fill_numeric"}}
    assert suggest.suggest_duplicates(twice).first().operation == "remove_duplicates"
    assert suggest.suggest_duplicates(twice, hints=other).first().resolution_type == "REVIEW_REQUIRED"


def test_missing_and_units_interplay(make):
    df = make("q string", ["2", "5", "3 units", None, "1"])
    assert [r.type for r in scour.display_issues(df).collect()] == ["missing_values"]
    assert scour.analyze_quality(df).count() == 2
    found = outcomes(scour.suggest(df))
    assert found["missing_values", "q"].resolution_type == "MIXED_NUMERIC"
    assert "missing-value issue" in found["embedded_units", "q"].message
    cleaned = scour.remove_units(df, "q", found["missing_values", "q"].parameter)
    found = outcomes(scour.suggest(cleaned))
    assert set(found) == {("missing_values", "q")}
    assert found["missing_values", "q"].operation == "fill_numeric"
    physical = make("w string", ["2 kg", "3 g", None])
    assert {r.type for r in scour.display_issues(physical).collect()} == {
        "missing_values", "embedded_units",
    }


def test_result_does_not_depend_on_partitioning(spark, make):
    values = [(["Ab", "ab", "cd", None][i % 4], f"{i % 9} kg" if i % 3 else str(i % 9)) for i in range(200)]
    results = []
    for partitions in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = make("s string, w string", values).repartition(int(partitions))
        results.append((issues(df), rows(scour.suggest(df)), rows(scour.remove_duplicates(df))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_context_statistics_match_parts(make):
    df = make("a bigint, b string", [(1, "x"), (2, "y"), (2, None)])
    full = scour.dataset_context(df).select("column", "hint", "role")
    assert rows(context.column_hints(df), "column", "hint") == rows(full, "column", "hint")
    assert rows(context.column_roles(df), "column", "role") == rows(full, "column", "role")


def test_wide_tables(spark):
    """300 text columns: the plan grows with the columns, not with their square, and rows are right."""

    def wide(columns):
        cells = [f"CASE id WHEN 0 THEN 'a' WHEN 1 THEN 'A' END AS c{i}" for i in range(columns)]
        return spark.range(3).selectExpr("id AS row_id", *cells)

    def size(columns):
        counts = profile.text_counts(wide(columns), "row_id")
        plan = counts._jdf.queryExecution().optimizedPlan()
        found, waiting = 0, [plan]
        while waiting:
            node = waiting.pop()
            found += node.expressions().size() + sum(
                len(node.expressions().apply(i).sql()) for i in range(node.expressions().size())
            )
            waiting += [node.children().apply(i) for i in range(node.children().size())]
        return found

    assert size(300) < 5 * size(75)
    found = profile.analyze_quality(wide(300)).collect()
    assert len(found) == 600
    assert {(r.type, r["count"]) for r in found} == {("missing_values", 1), ("text_inconsistency", 2)}
