"""Mixing sources to target weights.

Words are counted per source. Each source gets its weight's share of the mix, but no more than
`most` times its own words; what it can't take is shared again by weight. The target over the words
is the source's repetition rate: a document is taken floor(rate) times, and once more if a coin,
drawn from a hash of its id, falls below the fraction.

Defined cases: a null text has no words and is taken like any other. A null source is a source. A
source without words has target 0. Rows that share an id share the coin, and a null id is one id.
Sources without a weight (missing, null, zero or negative) have target 0. Weights repeated for one
source are added up. Empty tables give no rows. Extra columns of the documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.names import free_name

from scour.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
COIN_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only: 52 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(text), 1, COIN_DIGITS), 16, 10)
    return digits.cast("double") / F.lit(float(16**COIN_DIGITS))


def source_targets(
    sizes: DataFrame, weights: DataFrame, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size and target for each source of `sizes` (columns source and size).

    `weights` has the columns source and weight. Sources that reach their limit keep it, the others
    share the rest by weight, until no other reaches its limit. A round is one aggregate of the
    table of sources, of which one row comes to the driver.
    """
    weighed = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = weighed.select(F.col("source").alias("__source"), "weight")
    known = stage(
        totals.join(w, totals.source.eqNullSafe(w["__source"]), "left").select(
            "source",
            "source_size",
            F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("limit"),
        ),
        "sources",
    )
    all_words = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = share * all_words
    level, full = 0.0, -1
    while True:
        reached = F.col("limit") <= F.lit(level) * F.col("weight")
        row = known.where("weight > 0").agg(
            F.count_if(reached).alias("full"),
            F.coalesce(F.sum(F.when(reached, F.col("limit"))), F.lit(0.0)).alias("kept"),
            F.coalesce(F.sum(F.when(~reached, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["full"] == full:
            break
        full = row["full"]
        if row["open"] == 0:
            level = float("inf")
            break
        level = (budget - row["kept"]) / row["open"]
    target = F.when(F.col("weight") > 0, F.least("limit", F.lit(level) * F.col("weight")))
    return known.select(
        "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")
    )


def mix(
    documents: DataFrame,
    weights: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    into: str = "mix",
) -> DataFrame:
    """The documents with a struct `into`: size, source_size, target and copies.

    A column of that name must not exist; all others are kept, whatever their names. The targets are
    one row a source, summed before the shuffle. A source with a third of the documents meets one
    row, so its partitions can be split.
    """
    if free_name(documents.columns, into) != into:
        raise ValueError(f"Column {into!r} exists already")
    sizes = documents.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = source_targets(sizes, weights, share, most).select(
        F.coalesce("source", F.lit("")).alias("name"),
        F.col("source").isNull().alias("none"),
        "source_size",
        "target",
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(
        F.lit(0.0)
    )
    whole = F.floor(rate)
    drawn = (F.col("coin") < rate - whole).cast("long")
    return (
        documents.select(
            F.struct("*").alias("row"),
            word_count(F.col(text)).alias("size"),
            coin(F.col(key), seed).alias("coin"),
            F.coalesce(F.col(source), F.lit("")).alias("name"),
            F.col(source).isNull().alias("none"),
        )
        .join(targets, ["name", "none"])
        .select(
            "row.*",
            F.struct("size", "source_size", "target", (whole + drawn).alias("copies")).alias(into),
        )
    )


def repeat_rows(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """Each document as often as the mix takes it, without the struct."""
    copies = F.col(into)["copies"]
    columns = [F.col(f"`{name}`") for name in mixed.columns if name != into]
    number = free_name(mixed.columns, "copy")
    return (
        mixed.where(copies > 0)
        .select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(number))
        .drop(number)
    )
