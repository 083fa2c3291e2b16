"""What may run on a stream.

Row-wise operators (filter, select, drop, mutate, the text, unit and date operators, rule
violations) are plain column expressions and accept a streaming table as it is. Operators that look
at the whole table would need state without a bound, so they refuse a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} looks at the whole table and cannot run on a stream")
