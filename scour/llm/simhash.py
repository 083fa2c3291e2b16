"""SimHash near-duplicates, linked by a hierarchical index in Gray order.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Equal fingerprints
are one class. Classes that differ in few bits are linked: fingerprints are cut into blocks, so many
more than bits may differ that linked ones agree on some blocks, and meet under those. Within such a
group an index is built: the fingerprints sorted by Gray rank, which puts alike ones side by side,
and above them nodes with the bits that all below share. Two nodes are compared on their shared bits
only; differences add up on the way down, and pairs of whole groups are left once they are too many,
or once all below is linked already.

A group yields a tree of links and not all its pairs. Groups above `part` are cut into parts by
hash, and every two parts meet, so no pair is lost and no task gets more than two parts.

Defined cases: null and empty texts and texts without words have fingerprint zero, which links like
any other. Fewer words than a shingle make one shingle. Repeated rows and equal texts are one class.
A null id does not name a component; a component without other ids has a null name. Empty tables
give no rows. Other columns are not read. Very long texts are hashed whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.components import components
from scour.sources.staging import stage

SEED = 42
BITS = 64
FAN = 8
#: Fingerprints in a part; shingles and pairs of nodes handled at a time.
PART, SHINGLES, PAIRS = 8192, 1 << 16, 1 << 15


# --- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of words, A-Z lower-cased."""
    # Lower case and white space of bytes are those of ASCII.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(1, len(words) - width + 1)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    lasts = ends[len(words) - count :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[start:end], SEED) for start, end in zip(starts, lasts)), np.uint64, count
    )


def simhash(text: str | None, width: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return fingerprint(shingle_hashes(text, width))


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        octets = hashes[at : at + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, width: int = 4) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(value, width) for value in batch], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- the index ------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over sorted codes; a node has the bits that all codes below share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        everything = np.full(len(codes), ~np.uint64(0), np.uint64)
        self.levels = [(self.codes, everything)]
        while len(self.levels[-1][0]) > FAN:
            values, masks = self.levels[-1]
            cuts = np.arange(0, len(values), FAN)
            any_set = np.bitwise_or.reduceat(values, cuts)
            all_set = np.bitwise_and.reduceat(values | ~masks, cuts)
            shared = np.bitwise_and.reduceat(masks, cuts) & ~(any_set ^ all_set)
            self.levels.append((any_set & shared, shared))

    def link(self, most: int) -> np.ndarray:
        """For each sorted code the first code of its component, linking at `most` differing bits."""
        sets = _Sets(len(self.codes))
        for step in (1, 2, 3):  # neighbours in Gray order first: most links are there
            near = np.flatnonzero(np.bitwise_count(self.codes[step:] ^ self.codes[:-step]) <= most)
            sets.join(near, near + step)
        top = len(self.levels) - 1
        size = len(self.levels[top][0])
        a, b = np.triu_indices(size)
        zeros = np.zeros(len(a), np.int64)
        waiting = [(top, a, b, zeros, zeros.astype(np.uint64))]
        while waiting:
            level, a, b, differences, known = waiting.pop()
            values, masks = self.levels[level]
            shared = masks[a] & masks[b]
            differences = differences + np.bitwise_count((values[a] ^ values[b]) & shared & ~known)
            keep = differences <= most
            first, last = sets.spans(level)
            # All below both nodes is one component already.
            keep &= (first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b])
            a, b, differences, shared = a[keep], b[keep], differences[keep], shared[keep]
            if level == 0:
                sets.join(a, b)
                continue
            size = len(self.levels[level - 1][0])
            for at in range(0, len(a), PAIRS // (FAN * FAN) or 1):
                part = slice(at, at + (PAIRS // (FAN * FAN) or 1))
                left = (a[part, None] * FAN + np.arange(FAN)).repeat(FAN, 1).ravel()
                right = np.tile(b[part, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
                inside = (left < size) & (right < size) & (left <= right)
                if level == 1:
                    inside &= left < right
                parent = np.arange(len(a[part])).repeat(FAN * FAN)[inside]
                waiting.append(
                    (level - 1, left[inside], right[inside], differences[part][parent],
                     shared[part][parent])
                )
        return sets.roots


class _Sets:
    """Disjoint sets of codes, with the range of set numbers below each node of the index."""

    def __init__(self, size: int):
        self.roots = np.arange(size)
        self._spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.column_stack([self.roots[a], self.roots[b]])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        if not len(pairs):
            return
        parent = self.roots

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        self.roots = parent
        self._spans.clear()

    def spans(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._spans:
            cuts = np.arange(0, len(self.roots), FAN**level)
            self._spans[level] = (
                np.minimum.reduceat(self.roots, cuts), np.maximum.reduceat(self.roots, cuts)
            )
        return self._spans[level]


def link_codes(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected: from each code to the first of its component."""
    index = GrayIndex(np.unique(codes.astype(np.uint64)))
    roots = index.link(most)
    other = np.flatnonzero(roots != np.arange(len(roots)))
    return index.codes[other], index.codes[roots[other]]


# --- links over all classes -----------------------------------------------------------------------


def _block_masks(count: int) -> list[int]:
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(classes: DataFrame, most: int = 4, part: int = PART) -> DataFrame:
    """a and b: links between the distinct codes of the column `fingerprint`.

    Of `most + r` blocks, codes that are linked agree on r at least; r rises with the number of
    codes, so that the groups of codes that agree on r blocks stay small.
    """
    total = classes.count()
    agree = 1
    while agree < 5 and total > (1 << (BITS * agree // (most + agree))) * part // 16:
        agree += 1
    masks = [sum(chosen) for chosen in combinations(_block_masks(most + agree), agree)]
    keyed = classes.select(
        "fingerprint",
        F.posexplode(
            F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))) for mask in masks])
        ).alias("mask", "bits"),
    )
    sizes = keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / part).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high")),
    )
    met = (
        keyed.join(sizes.select("mask", "bits", parts.alias("parts")), ["mask", "bits"])
        .withColumn("met", F.explode(others))
        # A part meets itself where it meets the next one.
        .where("parts = 1 OR met.low <> met.high")
        .select("mask", "bits", F.col("met.low").alias("low"), F.col("met.high").alias("high"), "fingerprint")
    )
    keys = ["mask", "bits", "low", "high"]
    spark = classes.sparkSession
    dealt = met.repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), *keys
    ).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            table = whole[keys].to_numpy()
            cuts = np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1
            codes = whole["fingerprint"].to_numpy().view(np.uint64)
            edges = [0, *cuts.tolist()]
            yield from _linked(codes, edges)
            held = whole.iloc[edges[-1] :]
        if held is not None:
            yield from _linked(held["fingerprint"].to_numpy().view(np.uint64), [0, len(held)])

    def _linked(codes: np.ndarray, edges: list[int]) -> Iterator[pd.DataFrame]:
        found = [link_codes(codes[a:b], most) for a, b in zip(edges, edges[1:])]
        if found:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, most: int = 4
) -> DataFrame:
    """key, fingerprint (64-bit integer), component (the smallest key reachable by links) and root.

    The root is the smallest fingerprint of the component.

    Fingerprints are written once. The classes, one row a distinct fingerprint, are what is linked;
    copies never meet each other.
    """
    marked = stage(
        documents.select(
            F.col(key).alias("key"), fingerprints(F.col(text), width).alias("fingerprint")
        ),
        "fingerprints",
    )
    classes = stage(marked.groupBy("fingerprint").agg(F.min("key").alias("first")), "classes")
    roots = components(links(classes, most)).withColumnRenamed("node", "fingerprint")
    rooted = stage(
        classes.join(roots, "fingerprint", "left").select(
            "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
        ),
        "classes",
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(names, "root").select("fingerprint", "component", "root")
    return marked.join(named, "fingerprint").select(
        F.col("key").alias(key), "fingerprint", "component", "root"
    )

