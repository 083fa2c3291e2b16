"""Membership in a table, or in a list too long for a literal: a correlated EXISTS.

Spark plans it as a semi-join under a filter, as an anti-join under its negation, and as an
existence join within `or`. It is two-valued: a missing cell is in no list of present values, and a
missing value in the list stands for missing cells, as in short lists.

Lists are sent as tables, broadcast if their size (known here) is below `BROADCAST_BYTES`. A table
of values is never broadcast by hint: Spark goes by its size. On numbers and texts, the range of a
list also stands beside the join, so that it reaches the file scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.dates import parse_literal
from scour.functions.missing import is_missing
from scour.schema import is_float, is_numeric, is_temporal, is_text, ref

#: Longer lists become tables.
LONGEST_LIST = 1000
#: Lists of fewer bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of an entry of a hashed relation besides the characters of its value.
ENTRY = 64

_LONG = range(-(1 << 63), 1 << 63)


def _is_missing_value(value) -> bool:
    return value is None or (isinstance(value, (float, Decimal)) and value != value)


def _typed(dtype: T.DataType, value) -> tuple[str, object] | None:
    """The type to compare in and the value as it is sent, or None if the two never match."""
    if is_numeric(dtype):
        if isinstance(value, (bool, int)):
            return ("bigint", int(value)) if int(value) in _LONG else ("double", float(value))
        if isinstance(value, float):
            return "double", value
        if isinstance(value, Decimal):
            return "decimal(38,18)", value
    if is_text(dtype) and isinstance(value, str):
        return "string", value
    if isinstance(dtype, T.BooleanType) and value in (0, 1):
        return "boolean", bool(value)
    if is_temporal(dtype):
        value = parse_literal(value) if isinstance(value, str) else value
        if isinstance(value, (dt.date, dt.datetime)):
            midnight = not isinstance(value, dt.datetime) or value.time() == dt.time()
            of_days = isinstance(dtype, T.DateType)
            # Sent as text, so that the session time zone applies and not the driver's.
            return ("date" if midnight else "timestamp_ntz") if of_days else dtype.simpleString(), str(value)
    return None


def _found(name: str, values: DataFrame) -> Column:
    """Whether the cell is among the only column of the values.

    A name is looked for in the subquery first, below projections too: the column of values gets
    another name, and the alias hides those it had before.
    """
    other = f"in {name}"
    hidden = values.toDF(other).alias("values")
    return ref(name).isNotNull() & hidden.where(ref(other) == ref(name).outer()).exists()


def in_list(spark: SparkSession, name: str, dtype: T.DataType, values: Iterable) -> Column:
    """Whether a cell is in a list of any length."""
    kinds: dict[str, set] = {}
    with_missing = False
    for value in values:
        if _is_missing_value(value):
            with_missing = True
        elif (typed := _typed(dtype, value)) is not None:
            kinds.setdefault(typed[0], set()).add(typed[1])
    tests = []
    for kind, distinct in kinds.items():
        as_text = is_temporal(dtype)
        sent = "string" if as_text or kind.startswith("decimal") else kind
        rows = [(str(value) if sent == "string" else value,) for value in distinct]
        table = spark.createDataFrame(rows, f"value {sent}")
        if sent != kind:
            table = table.select(F.col("value").cast(kind))
        size = sum(4 * len(row[0]) if sent == "string" else 8 for row in rows) + ENTRY * len(rows)
        test = _found(name, F.broadcast(table) if size <= BROADCAST_BYTES else table)
        if kind in ("bigint", "string") and not as_text and not is_float(dtype):
            test = ref(name).between(F.lit(min(distinct)), F.lit(max(distinct))) & test
        tests.append(test)
    if with_missing:
        tests.append(F.expr(is_missing(name, dtype)))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def in_table(name: str, dtype: T.DataType, values: DataFrame) -> Column:
    """Whether a cell is in the only column of a table; types that never match give FALSE."""
    if len(values.columns) != 1:
        raise ValueError("A table of values needs exactly one column")
    other = values.schema[0].dataType
    kinds = (is_numeric, is_text, is_temporal, lambda t: isinstance(t, T.BooleanType))
    with_missing = values.where(is_missing(values.columns[0], other)).exists()
    member = F.expr(is_missing(name, dtype)) & with_missing
    if any(kind(dtype) and kind(other) for kind in kinds):
        member = member | (_found(name, values) & ~F.expr(is_missing(name, dtype)))
    return member
