"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of bits: sides of random planes through the middle of the data.
Vectors near each other tend to share a long prefix. Per tree the strings are sorted; the vectors
that share a prefix with a query are a range of that order. A query descends to its longest matches
and then ascends in all trees at once, one bit at a time, until the ranges hold enough candidates,
whose distances are computed exactly.

How many are enough is fitted: for some queries the true neighbours are found by brute force, and
the number that would have reached `recall` of them is used for all. On data without structure that
is a large share of the rows, on clustered data a small one.

Sorted orders are dealt in blocks by tree and first bits, large blocks in parts by hash, so every
task gets a bounded part of rows and of queries; counts add up over parts, and so do the nearest of
each part. Queries that find too few below the first bits of their block ascend to shorter ones in
another round, so none is left.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id or with another length than the most common one (the longer of a tie). Equal
vectors are one entry with their smallest ids: no other of them can be among the nearest. Repeated
rows are one row. Ties go to the smaller id. Fewer candidates than asked for are all returned. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scour.sources.staging import stage

#: Rows and queries of a block that meet in one task.
ROWS, QUERIES = 20_000, 1_000
#: Vectors that the planes are placed by, and queries that the number of candidates is fitted on.
FITTED, TRIED = 4096, 64
BITS = 32
#: Rows whose distances to a query are computed at a time.
SLICE = 4096


@dataclass(frozen=True)
class Forest:
    """Planes of each tree (one column a bit), and where they stand."""

    planes: np.ndarray  # trees, dimensions, bits
    middles: np.ndarray  # trees, bits

    @classmethod
    def fit(cls, vectors: np.ndarray, trees: int, seed: int) -> Forest:
        planes = np.random.default_rng(seed).normal(size=(trees, vectors.shape[1], BITS))
        return cls(planes, np.median(vectors @ planes, axis=1))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The bit strings of each vector, one per tree, first bit highest."""
        sides = (vectors @ self.planes > self.middles[:, None, :]).astype(np.int64)
        return (sides << np.arange(BITS - 1, -1, -1)).sum(2).T


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    doubles = F.col(vector).cast("array<double>")
    usable = (
        F.col(key).isNotNull()
        & F.forall(doubles, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
        & F.exists(doubles, lambda v: v != 0)
    )
    # Adding zero makes negative zeros positive, so that equal vectors are equal arrays.
    return rows.where(usable).select(
        F.col(key).cast("long").alias("id"),
        F.transform(doubles, lambda v: v + F.lit(0.0)).alias("vector"),
    )


def _entries(valid: DataFrame, count: int) -> DataFrame:
    """key (smallest id), ids (the smallest `count`) and vector of each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (
        valid.distinct()
        .withColumn("rank", rank)
        .where(F.col("rank") <= count)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("key"), "ids", "vector")
    )


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), size)


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def _with_codes(entries: DataFrame, forest: Forest, size: int) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(forest.codes(_matrix(batch, size))))

    return entries.withColumn("codes", F.pandas_udf(run, "array<long>")(F.col("vector")))


def _enough(indexed: DataFrame, tried: list, forest: Forest, k: int, recall: float) -> int:
    """Candidates, counted in all trees, that hold `recall` of the true neighbours of `tried`.

    One pass over the rows: each task has the nearest it saw and how many rows share how much.
    """
    size = len(tried[0]["vector"])
    queries = np.array([row["vector"] for row in tried], np.float64)
    keys = np.array([row["key"] for row in tried])
    codes = np.array([row["codes"] for row in tried])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(keys), BITS + 1), np.int64)
        nearest = [[] for _ in keys]
        for batch in batches:
            rows, own = _matrix(batch["vector"], size), batch["key"].to_numpy()
            strings = np.array(batch["codes"].tolist())
            for i in range(len(keys)):
                shared = shared_bits(strings, codes[i])
                counts[i] += np.bincount(shared.ravel(), minlength=BITS + 1)
                found = _distances(rows, queries[i])
                found[own == keys[i]] = np.inf
                best = np.argsort(found, kind="stable")[:k]
                nearest[i] += zip(found[best].tolist(), shared[best].max(1).tolist())
                nearest[i] = sorted(nearest[i])[:k]
        i, level = np.indices(counts.shape)
        yield pd.DataFrame({"i": i.ravel(), "level": level.ravel(), "rows": counts.ravel()}).assign(
            distance=-1.0
        )
        near = [(i, s, 0, d) for i, found in enumerate(nearest) for d, s in found if d < np.inf]
        yield pd.DataFrame(near, columns=["i", "level", "rows", "distance"])

    seen = stage(
        indexed.select("key", "vector", "codes").mapInPandas(
            run, "i int, level int, rows long, distance double"
        ),
        "tried",
    )
    counted = seen.where("distance < 0").groupBy("i", "level").agg(F.sum("rows").alias("rows"))
    reached = F.sum("rows").over(Window.partitionBy("i").orderBy(F.desc("level")))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "level"))
    needed = (
        seen.where("distance >= 0")
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .join(counted.select("i", "level", reached.alias("reached")), ["i", "level"])
        .select("reached")
        .collect()
    )
    if not needed:
        return 1
    ordered = sorted(row["reached"] for row in needed)
    return ordered[min(len(ordered) - 1, int(np.ceil(recall * len(ordered))))]


def _strings(table: DataFrame, bits: int, *columns: str) -> DataFrame:
    """A row for each tree, with the first bits of the string."""
    return table.select(*columns, F.posexplode("codes").alias("tree", "code")).withColumn(
        "prefix", F.shiftright("code", BITS - bits) if bits < BITS else F.col("code")
    )


def _blocks(indexed: DataFrame, queries: DataFrame, bits: int) -> DataFrame:
    """Into how many parts the rows and the queries of a block are cut; blocks without queries go."""
    place = ["tree", "prefix"]
    rows = _strings(indexed, bits).groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))
    asked = _strings(queries, bits).groupBy(*place).agg(F.count(F.lit(1)).alias("asked"))
    return rows.join(asked, place).select(
        *place,
        F.ceil(F.col("rows") / ROWS).cast("int").alias("row_parts"),
        F.ceil(F.col("asked") / QUERIES).cast("int").alias("query_parts"),
    )


def _met(table: DataFrame, blocks: DataFrame, bits: int, own: str, other: str, *columns: str):
    """Each row in its part of the block, once for each part of the other side."""
    part = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
    return (
        _strings(table, bits, *columns)
        .join(blocks, ["tree", "prefix"])
        .withColumn(own, part)
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .groupBy("tree", "prefix", "row_parts", "query_parts")
    )


def _ranges(strings: np.ndarray, codes: np.ndarray, level: np.ndarray):
    """Where the strings that share `level` bits with a code begin and end in the sorted order."""
    free = BITS - level.astype(np.int64)
    low = codes >> free << free
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << free))


def _counts(rows: pd.DataFrame, queries: pd.DataFrame, bits: int) -> pd.DataFrame:
    strings = np.sort(rows["code"].to_numpy())
    codes = queries["code"].to_numpy()[:, None]
    levels = np.arange(bits, BITS + 1)[None, :]
    start, end = _ranges(strings, codes, levels)
    return pd.DataFrame(
        {"key": queries["key"].to_numpy().repeat(levels.size),
         "level": np.tile(levels[0], len(queries)), "found": (end - start).ravel()}
    )


def _nearest(rows: pd.DataFrame, queries: pd.DataFrame, k: int, size: int) -> pd.DataFrame:
    rows = rows.iloc[np.argsort(rows["code"].to_numpy(), kind="stable")]
    vectors, keys = _matrix(rows["vector"], size), rows["key"].to_numpy()
    asked = _matrix(queries["vector"], size)
    start, end = _ranges(
        rows["code"].to_numpy(), queries["code"].to_numpy(), queries["level"].to_numpy()
    )
    found = []
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        # Differences first: squares and products of whole vectors round away small distances.
        exact = np.concatenate(
            [np.zeros(0)]
            + [_distances(vectors[at : min(at + SLICE, b)], asked[i]) for at in range(a, b, SLICE)]
        )
        near = np.arange(b - a)
        if k < len(exact):  # all that tie with the last one stay, so that the smaller keys win
            near = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
        best = near[np.lexsort((keys[a:b][near], exact[near]))[:k]]
        found.append((keys[a:b][best], exact[best]))
    sizes = [len(near) for near, _ in found]
    return pd.DataFrame(
        {"key": queries["key"].to_numpy().repeat(sizes),
         "near": np.concatenate([near for near, _ in found]) if found else [],
         "distance": np.concatenate([d for _, d in found]) if found else []}
    )


def _counter(bits: int):
    return lambda rows, queries: _counts(rows, queries, bits)


def _finder(k: int, size: int):
    return lambda rows, queries: _nearest(rows, queries, k, size)


def _search(
    indexed: DataFrame, queries: DataFrame, enough: int, trees: int, k: int, size: int, total: int
) -> list[DataFrame]:
    """key, near and distance: for each query the nearest of each block, by rounds."""
    bits = int(np.clip(np.log2(max(1, trees * total / max(1, enough))), 0, BITS))
    found, waiting = [], queries
    while True:
        blocks = stage(_blocks(indexed, waiting, bits), "blocks")
        last = bits == 0

        counted = (
            _met(indexed, blocks, bits, "row_parts", "query_parts", "key")
            .cogroup(_met(waiting, blocks, bits, "query_parts", "row_parts", "key"))
            .applyInPandas(_counter(bits), "key long, level int, found long")
            .groupBy("key", "level")
            .agg(F.sum("found").alias("found"))
            .where((F.col("found") >= enough) | F.lit(last) & (F.col("level") == 0))
            .groupBy("key")
            .agg(F.max("level").alias("level"))
        )
        levels = stage(waiting.join(counted, "key", "left"), "levels")
        ready = levels.where("level IS NOT NULL")
        found.append(
            stage(
                _met(indexed, blocks, bits, "row_parts", "query_parts", "key", "vector")
                .cogroup(
                    _met(ready, blocks, bits, "query_parts", "row_parts", "key", "vector", "level")
                )
                .applyInPandas(_finder(k, size), "key long, near long, distance double"),
                "nearest",
            )
        )
        waiting = levels.where("level IS NULL").drop("level")
        if last or waiting.isEmpty():
            return found
        bits = max(0, bits - 2)


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = 10,
    recall: float = 0.95,
    key: str = "vec_id",
    vector: str = "embedding",
    seed: int = 0,
) -> DataFrame:
    """query_id, rank, the key of a neighbour and score (Euclidean distance) for each query row.

    Bounded samples come to the driver: `FITTED` vectors to place planes, `TRIED` queries to fit the
    number of candidates. Every row is indexed and may be found.
    """
    empty = rows.sparkSession.createDataFrame(
        [], f"query_id long, rank int, `{key}` long, score double"
    )
    valid = _valid(rows, key, vector)
    lengths = valid.groupBy(F.size("vector").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return empty
    size = common["size"]
    valid = valid.where(F.size("vector") == size)
    asked = (
        _valid(rows.where(is_query), key, vector).where(F.size("vector") == size).distinct()
    )
    entries = stage(_entries(valid, k + 1), "vectors")
    total = entries.count()
    some = F.xxhash64("key", F.lit(seed))
    fitted = entries.orderBy(some).limit(FITTED).select("vector").collect()
    forest = Forest.fit(np.array([row["vector"] for row in fitted], np.float64), trees, seed)
    indexed = stage(_with_codes(entries, forest, size), "strings")
    # Queries with equal vectors are searched for once.
    named = stage(
        asked.join(indexed, "vector").select(F.col("id").alias("query_id"), "key"), "queries"
    )
    queries = stage(
        indexed.join(named.select("key").distinct(), "key", "left_semi").drop("ids"), "queries"
    )
    tried = queries.orderBy(some).limit(TRIED).collect()
    if not tried:
        return empty
    enough = _enough(indexed, tried, forest, k, recall)
    found = _search(indexed, queries, enough, trees, k + 1, size, total)
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    nearest = F.row_number().over(Window.partitionBy("key").orderBy("distance", "near"))
    ids = F.row_number().over(Window.partitionBy("key").orderBy("distance", "id"))
    candidates = (
        together.distinct()
        .withColumn("place", nearest)
        .where(F.col("place") <= k + 1)
        .join(entries.select(F.col("key").alias("near"), "ids"), "near")
        .select("key", "distance", F.explode("ids").alias("id"))
        .withColumn("place", ids)
        .where(F.col("place") <= k + 1)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (
        named.join(candidates, "key")
        .where("id <> query_id")
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select(
            "query_id", "rank", F.col("id").alias(key), F.col("distance").alias("score")
        )
    )
