"""Scalar building blocks against Python's own behaviour."""

import math
import re

import pytest
from pyspark.sql import functions as F

from scour.functions import dates, numbers, text, units
from scour.functions.arithmetic import build_expression, expression_errors
from scour.schema import quoted

TEXTS = [
    "o'neIL 3rd foo-bar", "  x y ", "ǆ straße ÀÉ", "中a b", "male FEMALE", "\x1cabc\x1f",
    "a\tb c  d", "", "　wide ", "don't STOP me2now", None,
]


def evaluate(spark, values, sql, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.coalesce(1).orderBy("i").select(F.expr(sql)).collect()]


@pytest.mark.parametrize(
    "style, expected",
    [
        ("strip", str.strip),
        ("collapse_whitespace", lambda s: re.sub(r"\s+", " ", s).strip()),
        ("lower", str.lower),
        ("upper", str.upper),
        ("title", str.title),
    ],
)
def test_text_styles_match_python(spark, style, expected):
    got = evaluate(spark, TEXTS, text.normalize("v", style))
    assert got == [None if t is None else expected(t) for t in TEXTS]


def test_text_styles_are_idempotent(spark):
    for style in text.NORMALIZE_STYLES:
        once = text.normalize("v", style)
        assert evaluate(spark, TEXTS, once) == evaluate(spark, TEXTS, text.normalize(once, style))


def test_unknown_style():
    with pytest.raises(ValueError):
        text.normalize("v", "camel")
    with pytest.raises(ValueError):
        text.standardize("v", "collapse_whitespace")


@pytest.mark.parametrize(
    "value, day_first, expected",
    [
        ("07-08-2026", True, "2026-08-07"),
        ("07-08-2026", False, "2026-07-08"),
        ("13-08-2026", False, "2026-08-13"),
        ("12-31-2026", True, "2026-12-31"),
        ("2026-5-10", True, "2026-05-10"),
        ("2026-05-10", False, "2026-05-10"),
        ("August 7, 2026", True, "2026-08-07"),
        ("sep 07, 2026", False, "2026-09-07"),
        ("31/12/99", True, "1999-12-31"),
        ("01/02/68", False, "2068-01-02"),
        ("29/2/2024", True, "2024-02-29"),
        ("29/2/2023", True, None),
        ("30-30-2023", True, None),
        ("1-2/2026", True, None),
        ("1-2-26", True, None),
        ("Foo 5, 2020", True, None),
        ("invalid-date", True, None),
        ("2000", True, None),
        ("today", True, None),
        ("", True, None),
        (None, True, None),
    ],
)
def test_date_grammar(spark, value, day_first, expected):
    sql = f"date_format({dates.parse_date('v', day_first)}, 'yyyy-MM-dd')"
    assert evaluate(spark, [value], sql) == [expected]


def test_detect_format(spark):
    values = [
        "1/2/2024", "1/2/24", "01-02-2024", "2024-1-2", "March 5, 2024", "5 March 2024", None,
    ]
    assert evaluate(spark, values, dates.detect_format("v")) == [
        "DD/MM/YYYY or MM/DD/YYYY", "DD/MM/YY or MM/DD/YY", "DD-MM-YYYY or MM-DD-YYYY",
        "YYYY-MM-DD", "Month DD, YYYY", "Unknown", None,
    ]


def test_white_space_of_dates(spark):
    """Any blank, as in quantities: no-break, thin, ideographic."""
    values = ["June\u00a05, 2024", "June\u20095,\u30002024", "June 5,\u00a02024", "June\u200b5, 2024"]
    assert evaluate(spark, values, dates.detect_format("v")) == ["Month DD, YYYY"] * 3 + ["Unknown"]
    sql = f"date_format({dates.parse_date('v', True)}, 'yyyy-MM-dd')"
    assert evaluate(spark, values, sql) == ["2024-06-05"] * 3 + [None]


def test_numbers_in_texts(spark):
    values = ["12", " -1.5 ", "1e3", ".5", "5.", "inf", "12d", "1f", "0x10", "1,299", "", "nan", None]
    assert evaluate(spark, values, numbers.to_double("v")) == [
        12.0, -1.5, 1000.0, 0.5, 5.0, math.inf, None, None, None, None, None, None, None,
    ]
    plain = evaluate(spark, ["nan", "7", "x"], numbers.is_plain_number("v"))
    assert plain == [True, True, False]


def test_render_numbers(spark):
    values = [70.0, 2.5, 0.1, -0.0, 1234567.125, 1e17, 1e20, 123456789.5, -3.25]
    assert evaluate(spark, values, numbers.render_number("v"), "double") == [
        "70", "2.5", "0.1", "0", "1234567.125", "100000000000000000", "100000000000000000000",
        "123456789.5", "-3.25",
    ]
    rounded = [0.25, 0.3, 1e-7, 2.9999999, 1.23456789, 1700.0]
    assert evaluate(spark, rounded, numbers.render_rounded("v"), "double") == [
        "0.25", "0.3", "0.0", "3.0", "1.234568", "1700",
    ]


def arithmetic(spark, expression, pairs, kinds="a bigint, b bigint"):
    df = spark.createDataFrame(pairs, kinds).coalesce(1)
    return [row[0] for row in df.select(build_expression(expression, df.schema)).collect()]


def same(got, expected):
    assert len(got) == len(expected)
    for left, right in zip(got, expected):
        if isinstance(right, float) and math.isnan(right):
            assert math.isnan(left)
        else:
            assert left == right


def test_division_by_zero(spark):
    pairs = [(1, 0), (-1, 0), (0, 0), (None, 0), (7, 2)]
    same(arithmetic(spark, ["/", "a", "b"], pairs), [math.inf, -math.inf, math.nan, None, 3.5])


def test_modulo_has_the_sign_of_the_divisor(spark):
    pairs = [(-7, 3), (7, -3), (7, 3), (7, 0), (6, -3), (None, 3)]
    same(arithmetic(spark, ["%", "a", "b"], pairs), [2.0, -2.0, 1.0, math.nan, 0.0, None])
    same(arithmetic(spark, ["%", "a", -3], [(7, 0), (-7, 0)]), [-2, -1])
    floats = [(-7.5, 2.0), (5.5, -2.0)]
    same(
        arithmetic(spark, ["%", "a", "b"], floats, "a double, b double"),
        [-7.5 % 2.0, 5.5 % -2.0],
    )


def test_nested_arithmetic(spark):
    expression = ["-", ["*", ["+", "a", 1], 2.5], ["-", "b"]]
    same(arithmetic(spark, expression, [(1, 2), (3, None)]), [7.0, None])
    same(arithmetic(spark, ["+", "a", "b"], [(2**40, 1)]), [2**40 + 1])


def test_expression_errors(spark):
    assert expression_errors(["+", "a", "ghost"], ["a"]) == [
        "Column 'ghost' in the expression does not exist"
    ]
    assert expression_errors(["+", "a", None], ["a"])
    assert expression_errors(["**", "a", 2], ["a"])
    assert expression_errors(["/", "a"], ["a"])
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.raises(TypeError):
        build_expression(["+", "t", 1], df.schema)


def test_units(spark):
    spelled = ["KGS", " Litres ", "hrs", "Parsec", "t", "metre", "Grams", "ms", None]
    assert evaluate(spark, spelled, units.normalize_unit("v")) == [
        "kg", "l", "hour", "parsec", "tonne", "m", "g", "ms", None,
    ]
    assert evaluate(spark, spelled, units.unit_category(units.normalize_unit("v"))) == [
        "Mass", "Volume", "Time", "Unknown", "Mass", "Length", "Mass", "Time", None,
    ]
    assert evaluate(spark, ["g", "kg", "lbs"], units.convert_value("250", "v", "kg")) == [
        0.25, 250.0, None,
    ]
    assert evaluate(spark, ["g"], units.convert_value("1", "v", "parsec")) == [None]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(3,)], "`a.b c` bigint")
    assert df.select(build_expression(["+", "a.b c", 1], df.schema)).first()[0] == 4
    assert quoted("a`b") == "`a``b`"
