"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed
with either, in pieces, so that the dictionary and not the text's own past decides. The difference
of the two sizes over their sum says which kind it is closer to; a rising curve, fitted to labelled
texts that the dictionaries have not seen, makes it a probability of the good label.

The dictionaries and the curve are fitted on a bounded sample: at most `sample` labelled documents
of each kind, those with the smallest hash of their id, and of each at most `pieces` pieces for the
dictionary. Every text is scored whole.

Defined cases: null and empty texts have difference 0 and get the curve's value there. Labels that
are null or have no document are ignored, a document with several labels counts once for each. With
labels of one kind only, or none, every score is 0.5. Repeated rows score alike. Empty tables give
no rows. Extra columns of the documents are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.sources.staging import stage

PIECE_BYTES = 128
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the knots of the curve."""

    good: bytes
    bad: bytes
    curve: tuple[tuple[float, float], ...] = ((0.0, 0.5),)


class Difference:
    """The normalised difference of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=_prepared(content),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for content in (good, bad)
        ]

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
        good, bad = (sum(len(c.compress(piece)) for piece in pieces) for c in self.compressors)
        return (bad - good) / (bad + good)


def _prepared(content: bytes) -> zstandard.ZstdCompressionDict:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return dictionary


def differences(text: Column, good: bytes, bad: bytes) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Difference(good, bad)
        for batch in batches:
            yield pd.Series([measure(value) for value in batch], dtype=float)

    return F.pandas_udf(run, "double")(text)


def _sampled_pieces(text: Column, pieces: int) -> Column:
    """Some pieces of each text, spread evenly over its whole length, in mixed order."""

    def run(batch: pd.Series) -> pd.Series:
        chosen = []
        for value in batch:
            data = (value or "").encode("utf-8", "surrogatepass")
            starts = np.linspace(0, max(0, len(data) - PIECE_BYTES), pieces).astype(int)
            mixed = np.random.default_rng(len(data)).permutation(np.unique(starts))
            chosen.append([data[at : at + PIECE_BYTES] for at in mixed.tolist()])
        return pd.Series(chosen, dtype=object)

    return F.pandas_udf(run, "array<binary>")(text)


def fit_curve(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Knots of the rising curve through (difference, label, weight) with the least squared error.

    Neighbours that would make it fall are pooled; a knot is the centre of a pool.
    """
    pools: list[list[float]] = []  # weight, weighted sum of differences, of labels
    for value, label, weight in sorted(points):
        pools.append([weight, weight * value, weight * label])
        while len(pools) > 1 and (
            pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]
            or pools[-2][1] * pools[-1][0] == pools[-1][1] * pools[-2][0]
        ):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [(values / weight, labels / weight) for weight, values, labels in pools]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = 2000,
    pieces: int = 64,
    dictionary_bytes: int = 1 << 18,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    seed: int = 0,
) -> Model | None:
    """Fit dictionaries and curve; None without labels of both kinds.

    What comes to the driver is bounded: up to `sample` ids of each kind, `pieces` pieces of each,
    and one number each. Every second sampled document makes the dictionaries, the others the
    curve. Labels are read for training here and nowhere else.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(
        F.col("__key").isNotNull() & F.col("__label").isin(0, 1)
    )
    order = F.xxhash64(F.col("__key"), F.lit(seed))
    there = documents.select(F.col(key).alias("__key")).distinct()
    labelled = stage(known.join(there, "__key", "left_semi"), "labelled")
    all_labels = {row["__label"]: row["count"] for row in labelled.groupBy("__label").count().collect()}
    rows = []
    for value in (0, 1):
        kind = labelled.where(F.col("__label") == value).select("__key", order.alias("__order"))
        rows.append(kind.orderBy("__order", "__key").limit(sample).collect())
    if not all(rows):
        return None
    spark = documents.sparkSession
    chosen = spark.createDataFrame(
        pd.DataFrame(
            {
                "__key": [row["__key"] for kind in rows for row in kind],
                "__label": [value for value, kind in enumerate(rows) for _ in kind],
                "__fits": [i % 2 == 1 for kind in rows for i in range(len(kind))],
            }
        )
    )
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(
        F.broadcast(chosen), "__key"
    )
    found = (
        texts.where(~F.col("__fits"))
        .select("__key", "__label", _sampled_pieces(F.col("__text"), pieces).alias("__pieces"))
        .groupBy("__key", "__label")
        .agg(F.min("__pieces").alias("__pieces"))
        .collect()
    )
    place = {row["__key"]: row["__order"] for kind in rows for row in kind}
    found.sort(key=lambda row: (place[row["__key"]], row["__key"]))
    good, bad = (
        _dictionary([row["__pieces"] for row in found if row["__label"] == value], dictionary_bytes)
        for value in (1, 0)
    )
    fitted = (
        texts.where("__fits")
        .select("__key", "__label", differences(F.col("__text"), good, bad).alias("__value"))
        .groupBy("__key", "__label")
        .agg(F.avg("__value").alias("__value"))
        .collect()
    )
    seen = Counter(row["__label"] for row in fitted)
    if len(seen) < 2:
        return Model(good, bad)
    # Each kind weighs as much as it has labels, not as much as it was sampled.
    weight = {kind: all_labels[kind] / seen[kind] for kind in seen}
    points = [(row["__value"], row["__label"], weight[row["__label"]]) for row in fitted]
    return Model(good, bad, tuple(fit_curve(points)))


def _dictionary(documents: list[list[bytes]], limit: int) -> bytes:
    """A piece of each document in turn, then another of each, as many as fit, end to end.

    With few documents most of each goes in, with many a little of each.
    """
    rounds = zip_longest(*documents)
    pieces = dict.fromkeys(piece for turn in rounds for piece in turn if piece is not None)
    return b"".join(pieces)[:limit]


def score(
    documents: DataFrame, model: Model | None, text: str = "text", into: str = "score"
) -> DataFrame:
    """The documents with the probability of the good label; a column `into` is replaced."""
    if model is None:
        return documents.withColumn(into, F.lit(0.5))
    values, levels = zip(*model.curve)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Difference(model.good, model.bad)
        for batch in batches:
            found = np.array([measure(value) for value in batch], float)
            yield pd.Series(np.interp(found, values, levels))

    return documents.withColumn(into, F.pandas_udf(run, "double")(F.col(text)))
