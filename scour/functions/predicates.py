"""Condition trees as boolean columns with two-valued logic.

Every leaf is TRUE or FALSE, never NULL, so `and`, `or` and `not` combine freely. The forms are
chosen so that the predicates still reach the file scan.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import membership
from scour.functions.dates import parse_literal
from scour.functions.missing import is_missing
from scour.schema import column_types, is_float, is_numeric, is_temporal, is_text, ref

LOGICAL = ("and", "or", "not")
NULL_TESTS = ("is_null", "is_not_null")
LIST_TESTS = ("in", "not_in")
ORDER_TESTS = ("gt", "gte", "lt", "lte", "between")
TEXT_TESTS = ("contains", "starts_with", "ends_with")
OPERATORS = LOGICAL + NULL_TESTS + LIST_TESTS + ORDER_TESTS + TEXT_TESTS + ("equals", "not_equals")


def check_condition(condition: Mapping) -> None:
    """Raise ValueError unless the tree is well formed."""
    operator = condition.get("operator")
    value = condition.get("value")
    children = condition.get("conditions")
    if operator not in OPERATORS:
        raise ValueError(f"Unknown condition operator {operator!r}")
    if operator in LOGICAL:
        if condition.get("column") is not None or value is not None:
            raise ValueError(f"'{operator}' combines conditions; it takes no column or value")
        if not children:
            raise ValueError(f"'{operator}' needs a list of conditions")
        if operator == "not" and len(children) != 1:
            raise ValueError("'not' takes exactly one condition")
        for child in children:
            check_condition(child)
        return
    if children is not None:
        raise ValueError(f"'{operator}' tests a column; it takes no conditions")
    if condition.get("column") is None:
        raise ValueError(f"'{operator}' needs a column")
    is_list = isinstance(value, (list, tuple))
    if operator in NULL_TESTS and value is not None:
        raise ValueError(f"'{operator}' takes no value")
    if operator in LIST_TESTS and not is_list and not isinstance(value, DataFrame):
        raise ValueError(f"'{operator}' needs a list or a one-column table of values")
    if operator == "between" and not (is_list and len(value) == 2):
        raise ValueError("'between' needs exactly two values")
    if operator not in NULL_TESTS and value is None:
        raise ValueError(f"'{operator}' needs a value")


def condition_columns(condition: Mapping) -> list[str]:
    if condition["operator"] in LOGICAL:
        return [name for child in condition["conditions"] for name in condition_columns(child)]
    return [condition["column"]]


def build_condition(condition: Mapping, schema: T.StructType, for_filter: bool = False) -> Column:
    """The condition tree as a column over a table with this schema.

    With `for_filter` the column is good for a filter only: long lists and tables become joins.
    """
    check_condition(condition)
    return _build(condition, column_types(schema), for_filter)


def _build(condition: Mapping, types: Mapping[str, T.DataType], for_filter: bool) -> Column:
    operator = condition["operator"]
    if operator in LOGICAL:
        children = [_build(child, types, for_filter) for child in condition["conditions"]]
        if operator == "not":
            return ~children[0]
        return reduce(Column.__and__ if operator == "and" else Column.__or__, children)
    name = condition["column"]
    if name not in types:
        raise ValueError(f"Column {name!r} does not exist")
    value = condition.get("value")
    if operator in LIST_TESTS and (isinstance(value, DataFrame) or for_filter):
        member = _joined_member(name, types[name], value, for_filter)
        return member if operator == "in" else ~member
    return _leaf(operator, name, types[name], value)


def _joined_member(name: str, dtype: T.DataType, values: Sequence | DataFrame, for_filter: bool) -> Column:
    if not for_filter:
        raise ValueError(f"Only filters compare column {name!r} with a table of values")
    if isinstance(values, DataFrame):
        return membership.in_table(name, dtype, values)
    if len(values) > membership.LONGEST_LIST:
        return membership.in_list(SparkSession.active(), name, dtype, values)
    return _member(name, dtype, values)


def _leaf(operator: str, name: str, dtype: T.DataType, value) -> Column:
    missing = F.expr(is_missing(name, dtype))
    if operator == "is_null":
        return missing
    if operator == "is_not_null":
        return ~missing
    if operator in TEXT_TESTS:
        return _text_leaf(operator, name, dtype, str(value))
    if operator in LIST_TESTS:
        member = _member(name, dtype, value)
        return member if operator == "in" else ~member
    if operator in ORDER_TESTS:
        return _order_leaf(operator, name, dtype, value)
    literal = comparable(dtype, value)
    same = F.lit(False) if literal is None else ref(name).eqNullSafe(literal)
    return same if operator == "equals" else ~same


def _text_leaf(operator: str, name: str, dtype: T.DataType, value: str) -> Column:
    if not is_text(dtype):
        raise TypeError(f"'{operator}' needs a text column; {name!r} is {dtype.simpleString()}")
    column = ref(name)
    tests = {
        "contains": lambda: F.lower(column).contains(value.lower()),
        "starts_with": lambda: column.startswith(value),
        "ends_with": lambda: column.endswith(value),
    }
    return column.isNotNull() & tests[operator]()


def _member(name: str, dtype: T.DataType, values: Sequence) -> Column:
    literals = [comparable(dtype, value) for value in values]
    literals = [literal for literal in literals if literal is not None]
    column = ref(name)
    member = column.isNotNull() & column.isin(*literals) if literals else F.lit(False)
    if any(value is None or _is_nan(value) for value in values):
        member = member | F.expr(is_missing(name, dtype))
    return member


def _order_leaf(operator: str, name: str, dtype: T.DataType, value) -> Column:
    bounds = [comparable(dtype, item) for item in (value if operator == "between" else [value])]
    if any(bound is None for bound in bounds):
        raise TypeError(
            f"'{operator}' cannot compare column {name!r} ({dtype.simpleString()}) with {value!r}"
        )
    column = ref(name)
    present = column.isNotNull()
    if operator == "between":
        return present & column.between(*bounds)
    if operator in ("lt", "lte"):
        return present & (column < bounds[0] if operator == "lt" else column <= bounds[0])
    above = present & (column > bounds[0] if operator == "gt" else column >= bounds[0])
    # Spark sorts NaN above every number.
    return above & ~F.isnan(column) if is_float(dtype) else above


def comparable(dtype: T.DataType, value) -> Column | None:
    """The literal to compare a column of this type with, or None if the two never match."""
    if value is None or _is_nan(value):
        return None
    if is_numeric(dtype) and isinstance(value, (bool, int, float, Decimal)):
        if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
            value = float(value)
        return F.lit(int(value) if isinstance(value, bool) else value)
    if is_text(dtype) and isinstance(value, str):
        return F.lit(value)
    if isinstance(dtype, T.BooleanType) and value in (0, 1):
        return F.lit(bool(value))
    if is_temporal(dtype):
        if isinstance(value, str):
            value = parse_literal(value)
        if isinstance(value, (dt.date, dt.datetime)):
            # Through text, so that the session time zone applies and not the driver's.
            wider = "timestamp_ntz" if isinstance(dtype, T.DateType) else dtype
            if isinstance(dtype, T.DateType) and _is_midnight(value):
                wider = dtype
            return F.lit(str(value)).cast(wider)
    return None


def _is_midnight(value: dt.date) -> bool:
    return not isinstance(value, dt.datetime) or value.time() == dt.time()


def _is_nan(value) -> bool:
    return isinstance(value, (float, Decimal)) and math.isnan(value)
