"""Toxicity classifier that is not swayed by the mention of a group.

A text is the words it holds and their first letters, each with how dense it is. A logistic curve
over weighted features is fitted to labelled texts. Next to the labels the fit has counterfactuals:
each labelled sentence that names an identity group is written again with the other terms of that
list (neutral ones among them), and the square of the change of score is a penalty. What a sentence
says about a group decides, not which group it names.

The fit takes a bounded sample: at most `sample` labelled texts of each kind, those with the smallest
hash of their id, the `features` terms that set toxic ones of them apart best, and of each text at
most `sentences` sentences that name a group, each rewritten at most `swaps` times. Every text is
scored whole.

Defined cases: null and empty texts have no features and get the score of the bias. Labels that are
null, not 0 or 1, or have no document are ignored; a document with several labels counts once for
each value. With labels of one kind only, or none, every score is 0. Repeated rows score alike.
Empty tables give no rows. Extra columns of the documents are kept, but for one named like the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.sources.staging import stage

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: First letters that are features of their own, and words that a text counts as longer by.
PREFIXES, LONGER = (4, 6), 50
#: Terms of a list may stand for each other; each list has neutral ones.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "lesbians", "gays", "immigrants", "refugees", "foreigners",
     "muslims", "jews", "christians", "hindus", "atheists", "africans", "asians", "arabs", "mexicans"),
    ("person", "woman", "man", "girl", "boy", "lesbian", "immigrant", "refugee", "foreigner",
     "muslim", "jew", "christian", "hindu", "atheist", "african", "asian", "arab", "mexican"),
    ("young", "old", "black", "white", "gay", "straight", "transgender", "disabled", "jewish"),
    ("leute", "menschen", "frauen", "männer", "mädchen", "jungen", "juden", "muslime", "christen",
     "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("gens", "personnes", "femmes", "hommes", "filles", "garçons", "juifs", "musulmans", "chrétiens",
     "étrangers", "réfugiés", "homosexuels"),
    ("gente", "personas", "mujeres", "hombres", "chicas", "chicos", "judíos", "musulmanes", "cristianos",
     "extranjeros", "refugiados", "homosexuales"),
)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found, size = counted(text)
        hits = (term for term in found if term in self.weights)
        # Sorted, so that sums do not depend on the order of words.
        logit = self.bias + sum(self.weights[term] * density(found[term], size) for term in sorted(hits))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


# --- features -------------------------------------------------------------------------------------


def counted(text: str | None) -> tuple[Counter, int]:
    """How often words and first letters of words (with a star) are there, and the number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    found = Counter(words)
    for word, count in words.items():
        for letters in PREFIXES:
            if len(word) >= letters:
                found[f"{word[:letters]}*"] += count
    return found, words.total()


def density(count: int, size: int) -> float:
    return math.log1p(100 * count / (size + LONGER))


def terms(text: str | None) -> dict[str, float]:
    found, size = counted(text)
    return {term: density(count, size) for term, count in found.items()}


def swapped(text: str | None, identities, sentences: int, swaps: int) -> list[tuple[str, str]]:
    """Sentences that name a group, each with a copy that names another one.

    The other terms are taken in the order of the list, starting after the one that is named.
    """
    lists = {term: names for names in identities for term in names}
    pairs = []
    for sentence in SENTENCE.findall(text or ""):
        if not sentences:
            break
        lower = sentence.lower()
        named = next((word for word in WORD.findall(lower) if word in lists), None)
        if named is None:
            continue
        sentences -= 1
        names = lists[named]
        at = names.index(named)
        for other in [*names[at + 1 :], *names[:at]][:swaps]:
            pairs.append((lower, re.sub(rf"\b{re.escape(named)}\b", other, lower)))
    return pairs


# --- fit ------------------------------------------------------------------------------------------


@dataclass
class Sparse:
    """Rows of few features."""

    count: int
    of: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, rows: list[dict[int, float]]) -> Sparse:
        sizes = [len(row) for row in rows]
        at = np.fromiter((i for row in rows for i in row), np.int64, sum(sizes))
        value = np.fromiter((v for row in rows for v in row.values()), float, sum(sizes))
        return cls(len(rows), np.repeat(np.arange(len(rows)), sizes), at, value)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.value * weights[self.at], self.count)

    def back(self, rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.value * rows[self.of], size)


def fit_weights(
    texts: list[dict[int, float]],
    toxic: np.ndarray,
    changes: list[dict[int, float]],
    size: int,
    fairness: float,
    ridge: float = 3e-4,
    steps: int = 300,
    rate: float = 0.1,
) -> tuple[float, np.ndarray]:
    """Bias and weights: both kinds weigh the same, `fairness` times the mean squared change of
    score is added, and `ridge` keeps weights small. Gradient descent with adapted steps."""
    x, pairs = Sparse.build(texts), Sparse.build(changes)
    share = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    weights = np.zeros(size + 1)  # the bias last
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-(x.times(weights) + weights[-1]))) - toxic) * share
        slope = x.back(error, size + 1) + ridge * weights
        slope[-1] = error.sum()
        if changes:
            slope += 2 * fairness / len(changes) * pairs.back(pairs.times(weights), size + 1)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return float(weights[-1]), weights[:-1]


def _chosen(labels: DataFrame, documents: DataFrame, sample: int, seed: int) -> DataFrame:
    """The labelled documents with the smallest hashes, at most `sample` of each kind."""
    there = documents.select(F.col("key")).distinct()
    known = labels.distinct().join(there, "key", "left_semi")
    kinds = [
        known.where(F.col("toxic") == kind).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)
        for kind in (0, 1)
    ]
    return kinds[0].unionByName(kinds[1])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    identities=IDENTITIES,
    fairness: float = 10.0,
    sample: int = 8000,
    features: int = 2048,
    sentences: int = 16,
    swaps: int = 8,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    seed: int = 0,
) -> Model | None:
    """Fit the model; None without labels of both kinds.

    Spark counts in how many texts of either kind a term is; `features` terms come to the driver,
    and of each sampled text and rewritten sentence its numbers for these terms.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where(
        F.col("key").isNotNull() & F.col("toxic").isin(0, 1)
    )
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = stage(_chosen(known, texts, sample, seed), "chosen")
    # At most twice `sample` rows. Repeated ids are one text.
    read = texts.join(F.broadcast(chosen), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))

    def read_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "toxic": batch["toxic"],
                    "terms": [list(terms(value)) for value in batch["text"]],
                }
            )

    labelled = stage(read, "labelled")
    seen = {row["toxic"]: row["count"] for row in labelled.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return None
    held = labelled.mapInPandas(read_terms, "toxic int, terms array<string>")
    # How far the toxic texts with a term exceed what the share of toxic texts lets expect.
    expected = F.col("n") * (seen[1] / (seen[0] + seen[1]))
    excess = (F.col("hits") - expected) * F.abs(F.col("hits") - expected) / (expected + 1)
    best = (
        held.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
        .where("n >= 3")
        .select("term", excess.alias("excess"))
        .where("excess >= 6")
        .orderBy(F.desc("excess"), "term")
        .limit(features)
        .collect()
    )
    names = [row["term"] for row in best]
    place = {name: i for i, name in enumerate(names)}

    def numbers(found: dict[str, float]) -> dict[int, float]:
        return {place[term]: value for term, value in found.items() if term in place}

    def read_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, toxic, value in zip(batch["key"], batch["toxic"], batch["text"]):
                row = numbers(terms(value))
                rows.append((name, toxic, list(row), list(row.values())))
                for one, other in swapped(value, identities, sentences, swaps):
                    a, b = numbers(terms(one)), numbers(terms(other))
                    change = {i: b.get(i, 0.0) - a.get(i, 0.0) for i in a.keys() | b.keys()}
                    change = {i: v for i, v in sorted(change.items()) if v}
                    if change:
                        rows.append((name, None, list(change), list(change.values())))
            yield pd.DataFrame(rows, columns=["key", "toxic", "at", "value"]).astype({"toxic": "Int32"})

    kind = labelled.schema["key"].dataType.simpleString()
    rows = labelled.mapInPandas(read_rows, f"key {kind}, toxic int, at array<int>, value array<double>")
    found = [
        (row["toxic"], row["key"], dict(sorted(zip(row["at"], row["value"])))) for row in rows.collect()
    ]
    # The order of rows must not change the last digits of sums.
    found.sort(key=lambda row: (row[0] is None, row[0] or 0, repr(row[1]), list(row[2].items())))
    texts_ = [row for toxic, _, row in found if toxic is not None]
    toxic = np.array([toxic for toxic, _, _ in found if toxic is not None])
    changes = [row for toxic, _, row in found if toxic is None]
    bias, weights = fit_weights(texts_, toxic, changes, len(names), fairness)
    return Model(bias, dict(zip(names, weights.tolist())))


def score(
    documents: DataFrame, model: Model | None, text: str = "text", into: str = "score"
) -> DataFrame:
    """The documents with the probability that they are toxic."""
    if model is None:
        return documents.withColumn(into, F.lit(0.0))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(value) for value in batch], dtype=float)

    return documents.withColumn(into, F.pandas_udf(run, "double")(F.col(text)))
