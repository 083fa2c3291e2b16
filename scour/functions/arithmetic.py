"""Arithmetic expressions over columns and numeric constants.

An expression is a column name (`str`), a number, or a list: `[operator, operand]` for the signs
and `[operator, left, right]` otherwise, e.g. `["/", ["-", "revenue", "cost"], "revenue"]`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.numbers import divide, modulo, modulo_double
from scour.schema import column_types, is_integral, is_numeric, quoted

OPERATORS = ("+", "-", "*", "/", "%")


def expression_errors(expression, columns) -> list[str]:
    """Everything wrong with the expression, given the columns it may use."""
    if isinstance(expression, str):
        if expression in columns:
            return []
        return [f"Column {expression!r} in the expression does not exist"]
    if isinstance(expression, (bool, int, float)):
        return []
    if isinstance(expression, (list, tuple)):
        operator, *operands = expression or [None]
        if operator not in OPERATORS:
            return [f"Unknown arithmetic operator {operator!r}"]
        if len(operands) != 2 and not (len(operands) == 1 and operator in "+-"):
            return [f"Arithmetic operator {operator!r} cannot take {len(operands)} operand(s)"]
        return [error for operand in operands for error in expression_errors(operand, columns)]
    return [f"Only numbers can be constants, not {type(expression).__name__}"]


def build_expression(expression, schema: T.StructType) -> Column:
    errors = expression_errors(expression, schema.fieldNames())
    if errors:
        raise ValueError("; ".join(errors))
    return F.expr(_build(expression, column_types(schema))[0])


def _build(expression, types) -> tuple[str, bool]:
    """SQL text, and whether the value is integral."""
    if isinstance(expression, str):
        dtype = types[expression]
        if not (is_numeric(dtype) or isinstance(dtype, T.BooleanType)):
            raise TypeError(
                f"Arithmetic needs numeric columns; {expression!r} is {dtype.simpleString()}"
            )
        integral = is_integral(dtype) or isinstance(dtype, T.BooleanType)
        return f"CAST({quoted(expression)} AS {'BIGINT' if integral else 'DOUBLE'})", integral
    if isinstance(expression, (bool, int)):
        return f"CAST({int(expression)} AS BIGINT)", True
    if isinstance(expression, float):
        return f"double('{expression!r}')", False

    operator, *operands = expression
    built = [_build(operand, types) for operand in operands]
    integral = all(flag for _, flag in built)
    if len(built) == 1:
        return f"({operator}{built[0][0]})", integral
    left, right = built[0][0], built[1][0]
    if operator == "/":
        return divide(left, right), False
    if operator == "%":
        # An integral result needs a divisor that cannot be zero.
        if integral and isinstance(operands[1], int) and operands[1] != 0:
            return modulo(left, right), True
        return modulo_double(left, right), False
    return f"({left} {operator} {right})", integral
