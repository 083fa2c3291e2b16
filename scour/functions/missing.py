"""Missing values: NULL everywhere, and NaN in floating-point columns. All SQL text."""

from __future__ import annotations

from pyspark.sql import types as T

from scour.schema import is_float, quoted


def is_missing(name: str, dtype: T.DataType) -> str:
    column = quoted(name)
    if is_float(dtype):
        return f"({column} IS NULL OR isnan({column}))"
    return f"({column} IS NULL)"


def known(name: str, dtype: T.DataType) -> str:
    """The value, with NaN turned into NULL so that aggregates and keys skip it."""
    column = quoted(name)
    return f"nanvl({column}, NULL)" if is_float(dtype) else column


def as_text(name: str, dtype: T.DataType) -> str:
    """The value as text, one spelling per value (NaN is missing, -0.0 is 0.0)."""
    column = known(name, dtype)
    if is_float(dtype):
        # Adding zero turns a negative zero into a positive one.
        return f"CAST({column} + CAST(0 AS {dtype.simpleString()}) AS STRING)"
    return f"CAST({column} AS STRING)"
