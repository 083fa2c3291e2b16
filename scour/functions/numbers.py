"""Parsing and rendering numbers, and arithmetic that never fails on a zero divisor. SQL text."""

from __future__ import annotations

from scour.functions.text import matches

# Spark's cast also takes `12d` and `1f`, so the shape is checked first.
_NUMBER = r"^\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|(?i:inf|infinity))\s*$"
_PLAIN = r"^\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|(?i:inf|infinity|nan))\s*$"
_INTEGER = r"^\s*[-+]?\d+\s*$"
# Integers with no more digits are doubles without loss.
_EXACT_DIGITS = 15
_BIGINT_SAFE = "9.0e18D"
_NAN, _INFINITY = "double('NaN')", "double('Infinity')"


def is_number(text: str) -> str:
    return matches(text, _NUMBER)


def is_integer(text: str) -> str:
    """Whether a text is an integer of 64 bits."""
    return f"({matches(text, _INTEGER)} AND try_cast(trim({text}) AS BIGINT) IS NOT NULL)"


def loses_digits(text: str) -> str:
    """Whether a text is an integer that a double would round."""
    exact = f"try_cast(trim({text}) AS DECIMAL(38, 0))"
    rounded = f"try_cast(try_cast(trim({text}) AS DOUBLE) AS DECIMAL(38, 0))"
    return (
        f"(length({text}) > {_EXACT_DIGITS} AND {matches(text, _INTEGER)} "
        f"AND NOT coalesce({exact} = {rounded}, false))"
    )


def is_plain_number(text: str) -> str:
    """Numbers and the literal `nan`."""
    return matches(text, _PLAIN)


def to_double(text: str) -> str:
    """The number in a text, NULL where there is none."""
    return f"CASE WHEN {is_number(text)} THEN try_cast(trim({text}) AS DOUBLE) END"


def render_number(value: str) -> str:
    """A double as text: integral values without a fraction, no exponent, no trailing zeros."""
    return (
        f"CASE WHEN rint({value}) <> {value} "
        f"THEN trim(TRAILING '0' FROM CAST(try_cast({value} AS DECIMAL(38, 17)) AS STRING)) "
        f"WHEN abs({value}) < {_BIGINT_SAFE} THEN CAST(try_cast({value} AS BIGINT) AS STRING) "
        f"ELSE CAST(try_cast({value} AS DECIMAL(38, 0)) AS STRING) END"
    )


def render_rounded(value: str) -> str:
    """Like `render_number`, but other values keep at most six decimals (`0.0000001` is `0.0`)."""
    rounded = f"CAST(try_cast(round({value}, 6) AS DECIMAL(38, 6)) AS STRING)"
    return (
        f"CASE WHEN rint({value}) <> {value} "
        rf"THEN regexp_replace({rounded}, '(\\.\\d)(\\d*?)0+$', '$1$2') "
        f"ELSE {render_number(value)} END"
    )


def divide(a: str, b: str) -> str:
    """True division of doubles; a zero divisor gives an infinity or NaN."""
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    by_zero = (
        f"CASE WHEN isnan({a}) OR {a} = 0 THEN {_NAN} WHEN {a} > 0 THEN {_INFINITY} "
        f"WHEN {a} < 0 THEN -{_INFINITY} END"
    )
    return f"CASE WHEN {b} = 0 THEN {by_zero} ELSE try_divide({a}, {b}) END"


def modulo(a: str, b: str) -> str:
    """Remainder with the sign of the divisor; a zero divisor gives NULL."""
    rest = f"try_mod({a}, {b})"
    return (
        f"CASE WHEN {rest} = 0 THEN abs({rest}) WHEN ({rest} < 0) = ({b} < 0) THEN {rest} "
        f"ELSE {rest} + {b} END"
    )


def modulo_double(a: str, b: str) -> str:
    """The same for doubles; a zero divisor gives NaN."""
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"CASE WHEN {b} = 0 AND {a} IS NOT NULL THEN {_NAN} ELSE {modulo(a, b)} END"
