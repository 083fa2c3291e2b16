"""Exact medians without sorting the table and without one task holding all its values.

Spark's exact `percentile` keeps a count per distinct value in one buffer. Here the value at a
middle rank is enclosed in a bracket that mergeable sketches narrow until few rows lie strictly
inside; the bracket is placed by exact counts, so sketch errors cost time but never the result.
Only the values inside the last bracket are ranked, and their number is checked against a limit.
Each round is one scan of the columns concerned with a shuffle of one row per task; a value that
fills a third of the table ends up on a bracket edge, where it is counted and not collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scour.functions.missing import known
from scour.schema import column_types

RANK_LIMIT = 500_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Target:
    """The search for the value at one rank of one column; the counts are of rows.

    An edge of None is open. `below` counts values under `low`, `inside` those strictly between.
    """

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    at_low: int = 0

    @property
    def start(self) -> int:
        """The rank of the first value strictly inside."""
        return self.below + self.at_low

    @property
    def value(self) -> float | None:
        """The answer, once the rank falls on an edge."""
        if self.rank < self.start:
            return self.low
        if self.rank >= self.start + self.inside:
            return self.high
        return None

    def within(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > self.low)
        if self.high is not None:
            test = test & (value < self.high)
        return test


def exact_medians(
    df: DataFrame,
    counts: Mapping[str, int],
    rank_limit: int = RANK_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, float]:
    """The median of each column; `counts` holds the number of present values (none may be zero)."""
    targets = [
        _Target(name, rank, inside=n)
        for name, n in counts.items()
        for rank in sorted({(n - 1) // 2, n // 2})
    ]
    while wide := [t for t in targets if t.value is None and t.inside > rank_limit]:
        _narrow(df, wide, accuracy)
    open_targets = [t for t in targets if t.value is None]
    found = _rank(df, open_targets) if open_targets else {}

    medians = {}
    for name in counts:
        values = [
            found[t.column, t.rank] if t.value is None else t.value
            for t in targets
            if t.column == name
        ]
        medians[name] = sum(values) / len(values)
    return medians


def _value(df: DataFrame, name: str) -> Column:
    return F.expr(known(name, column_types(df.schema)[name])).cast("double")


def _narrow(df: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """Two new edges inside each bracket from a sketch, then the part that holds the rank."""
    margin = 2.0 / accuracy
    sketches = []
    for i, t in enumerate(targets):
        value = _value(df, t.column)
        share = (t.rank - t.start) / t.inside
        ends = [max(share - margin, 0.0), min(share + margin, 1.0)]
        within = F.when(t.within(value), value)
        sketches.append(F.percentile_approx(within, ends, accuracy).alias(f"e{i}"))
    edges = df.agg(*sketches).first()

    tallies = []
    for i, t in enumerate(targets):
        value = _value(df, t.column)
        first, second = edges[f"e{i}"]
        tallies += [
            F.count_if(value < first).alias(f"below{i}"),
            F.count_if(value == first).alias(f"first{i}"),
            F.count_if((value > first) & (value < second)).alias(f"inside{i}"),
            F.count_if(value == second).alias(f"second{i}"),
        ]
    tally = df.agg(*tallies).first()

    for i, t in enumerate(targets):
        first, second = edges[f"e{i}"]
        below, at_first, inside = tally[f"below{i}"], tally[f"first{i}"], tally[f"inside{i}"]
        end = t.start + t.inside
        after_second = below + at_first + inside + (tally[f"second{i}"] if second > first else 0)
        if t.rank < below:
            t.inside, t.high = below - t.start, first
        elif t.rank >= after_second:
            t.below, t.at_low, t.low = after_second, 0, second
            t.inside = end - after_second
        else:
            t.below, t.at_low, t.inside = below, at_first, inside
            t.low, t.high = first, second


def _rank(df: DataFrame, targets: list[_Target]) -> dict[tuple[str, int], float]:
    """Rank the distinct values strictly inside each bracket, at most the limit per target."""
    cells = []
    for i, t in enumerate(targets):
        value = _value(df, t.column)
        inside = F.when(t.within(value), value)
        cells.append(F.struct(F.lit(i).alias("target"), inside.alias("value")))
    counted = (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = (
        Window.partitionBy("target")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    wanted = F.element_at(F.array(*[F.lit(t.rank - t.start) for t in targets]), F.col("target") + 1)
    rows = (
        counted.withColumn("upto", F.sum("n").over(running))
        .where((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
        .select("target", "value")
        .collect()
    )
    return {
        (targets[row["target"]].column, targets[row["target"]].rank): row["value"] for row in rows
    }
