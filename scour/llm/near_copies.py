"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `least` or more.

A text is the set of its shingle hashes; texts with equal sets are one class. Classes whose SimHash
fingerprints (of the set) differ in at most `most` bits are candidates, linked by the index of
`simhash`. A pair of similarity 0.8 differs in ten bits on average, which no index of fingerprints
finds in less than a comparison of all, so those beyond `most` bits come from min-hashes: 128 of a
set make 32 bands of four, and classes that share a band are candidates too; a pair of similarity
0.8 shares none with a probability of 5e-8, one of more with less.

Classes that are tied by links of fingerprints or by shared bands, however long the chain, are a group, so both sides of every
candidate pair are in one group. A group's whole sets come together and are compared there, but for
sizes too different and for fewer equal min-hashes than a pair of that similarity has (six standard
deviations below the mean are left). Classes that verified links have joined are not compared again,
so a group gives a tree of links, at most one for each of its classes, never its pairs. Large groups
are cut into parts by number and bytes, of which every two meet; groups of more than `MANY` parts go
by single links and bands instead, whose groups are smaller.

Defined cases: words are as in `simhash`: A-Z lower-cased, cut at ASCII white space. Null and empty
texts and texts without words have the empty set and are one class that is linked to no other. Fewer
words than a shingle make one shingle. Null keys come last, and of rows that share key and class one
stays. Empty tables give no rows. Columns may have any name. Sets are told apart by 64 bits of their
hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.components import components
from scour.llm.simhash import fingerprint, shingle_hashes
from scour.llm.simhash import links as fingerprint_links
from scour.sources.staging import stage

SEED = 42
#: Differing bits of fingerprints that are candidates.
MOST = 6
BANDS, IN_BAND = 32, 4
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * IN_BAND).astype(np.uint64) * 2 + 1
#: Shingles handled at a time, classes and bytes of sets of a part, and parts of a group.
SHINGLES, PART, PART_BYTES, MANY = 2048, 2048, 16 << 20, 8
#: Identities of rows, 8 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST = 2_000_000


# --- sets -----------------------------------------------------------------------------------------


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def mark(hashes: np.ndarray) -> int:
    """The name of a set."""
    return _signed(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), ~np.uint64(0), np.uint64)
    for at in range(0, len(hashes), SHINGLES):
        np.minimum(least, (hashes[at : at + SHINGLES, None] * FACTORS).min(0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    rows = least.astype("<u8").reshape(BANDS, IN_BAND)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(rows)]


def _sets(text: Column, width: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(value, width).tobytes() for value in batch], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def _described(text: Column, width: int) -> Column:
    def one(value: str | None) -> tuple:
        hashes = shingle_set(value, width)
        if not len(hashes):
            return mark(hashes), 0, 0, [], b""
        least = min_hashes(hashes)
        # Not the highest bits: those of minima are zero.
        sketch = (least >> np.uint64(24)).astype(np.uint8).tobytes()
        return mark(hashes), len(hashes), fingerprint(hashes), bands(least), sketch

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [one(value) for value in batch],
                columns=["mark", "size", "fingerprint", "bands", "sketch"],
            )

    return F.pandas_udf(
        run, "mark long, size int, fingerprint long, bands array<long>, sketch binary"
    )(text)


# --- links ----------------------------------------------------------------------------------------


def _described_rows(documents: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """rid, row, key, mark, size, fingerprint, bands and sketch of each row, written once.

    The row's identity is written with it, so it stays the same when it is read again.
    """
    return stage(
        documents.select(
            F.monotonically_increasing_id().alias("rid"),
            F.struct("*").alias("row"),
            F.col(key).alias("key"),
            _described(F.col(text), width).alias("d"),
        ).select("rid", "row", "key", "d.*"),
        "described",
    )


def _counted(ids: DataFrame) -> DataFrame:
    """Written identities, to be broadcast if there are few enough. Texts then stay where they are."""
    written = stage(ids, "ids")
    return F.broadcast(written) if written.count() <= BROADCAST else written


def _tied(classes: DataFrame, most: int) -> DataFrame:
    """mark and band: classes that share a band are candidates.

    Equal fingerprints share one, the two of each link of fingerprints another; then the min-hashes'.
    """
    known = stage(classes.select("fingerprint").distinct(), "fingerprints")
    linked = (
        fingerprint_links(known, most)
        .distinct()
        .select(F.explode(F.array("a", "b")).alias("fingerprint"), F.xxhash64("a", "b").alias("band"))
    )
    equal = known.select("fingerprint", F.xxhash64("fingerprint").alias("band"))
    near = stage(linked.unionByName(equal), "near")
    return (
        classes.select("mark", "fingerprint")
        .join(near, "fingerprint")
        .select("mark", "band")
        .unionByName(classes.select("mark", F.explode("bands").alias("band")))
    )


def _groups(classes: DataFrame, most: int) -> DataFrame:
    """kind, id, parts, rid, mark, size, sketch of the classes of each group of candidates."""

    def cut(members: DataFrame, kind: int) -> DataFrame:
        by_number = F.ceil(F.count(F.lit(1)) / PART)
        by_bytes = F.ceil(F.sum(F.col("size").cast("long") * 8) / PART_BYTES)
        return (
            members.groupBy("id")
            .agg(F.count(F.lit(1)).alias("n"), F.greatest(by_number, by_bytes).cast("int").alias("parts"))
            .where("n > 1")
            .select("id", "parts", F.lit(kind).alias("kind"))
        )

    banded = _tied(classes, most)
    leaders = (
        banded.groupBy("band")
        .agg(F.min("mark").alias("leader"), F.max("mark").alias("last"))
        .where("leader < last")
        .select("band", "leader")
    )
    tied = banded.join(leaders, "band").where("mark <> leader")
    roots = components(tied.select(F.col("mark").alias("a"), F.col("leader").alias("b")))
    members = stage(
        classes.join(roots.select(F.col("node").alias("mark"), F.col("root").alias("id")), "mark"),
        "members",
    )
    by_root = stage(cut(members, 0), "groups")
    large = members.join(by_root.where(F.col("parts") > MANY).select("id"), "id", "left_semi")
    of_band = large.join(banded, "mark").select(F.col("band").alias("id"), "rid", "mark", "size", "sketch")
    few = members.join(by_root.where(F.col("parts") <= MANY), "id")
    many = of_band.join(cut(of_band, 1), "id")
    names = ["kind", "id", "parts", "rid", "mark", "size", "sketch"]
    return few.select(*names).unionByName(many.select(*names))


def tree_of_links(
    marks: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, part: np.ndarray | None, least: float
) -> list[tuple[int, int]]:
    """Pairs of marks whose sets are alike enough, as many as join what can be joined.

    With `part` only members of different parts are compared.
    """
    places = len(FACTORS)
    equal = max(0, int(places * least - 6 * np.sqrt(places * least * (1 - least))))
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    marks, sketch = marks[order], sketch[order]
    part = part[order] if part is not None else None
    # Shingles by number, so that one lookup a shingle counts what two sets share.
    distinct, numbers = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    members = [numbers[end - size : end] for end, size in zip(ends, sizes)]
    own = np.zeros(len(distinct), bool)
    roots = np.arange(len(sizes))
    links = []
    for i, size in enumerate(sizes):
        # Sorted by size: the ones after it, up to the largest that can be alike.
        last = np.searchsorted(sizes * least, size, "right")
        after = i + 1 + np.flatnonzero(roots[i + 1 : last] != roots[i])
        if part is not None:
            after = after[part[after] != part[i]]
        after = after[(sketch[after] == sketch[i]).sum(1) >= equal]
        if not len(after):
            continue
        own[members[i]] = True
        for j in after.tolist():
            if roots[j] == roots[i]:
                continue
            shared = np.count_nonzero(own[members[j]])
            if shared / (size + sizes[j] - shared) >= least:
                links.append((int(max(marks[i], marks[j])), int(min(marks[i], marks[j]))))
                roots[roots == roots[j]] = roots[i]
        own[members[i]] = False
    return links


def _links(groups: DataFrame, described: DataFrame, text: str, width: int, least: float) -> DataFrame:
    """a and b: links that join all classes that are alike enough, at most one a class and part."""
    wanted = _counted(groups.select("rid").distinct())
    sets = stage(
        described.select("rid", F.col("row").getField(text).alias("text"))
        .join(wanted, "rid", "left_semi")
        .select("rid", _sets(F.col("text"), width).alias("set")),
        "sets",
    )
    own = F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high")),
    )
    keys = ["kind", "id", "low", "high"]
    met = (
        groups.join(sets, "rid")
        .withColumn("met", F.explode(others))
        .select("kind", "id", "met.low", "met.high", own.alias("part"), "mark", "sketch", "set")
    )
    dealt = met.repartition(
        int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys
    ).sortWithinPartitions(*keys)

    def links(pieces: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else pieces[0]
        found: list[tuple[int, int]] = []
        if len(rows) > 1:
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
            sets = [np.frombuffer(value, np.uint64) for value in rows["set"]]
            cross = rows["low"].iloc[0] != rows["high"].iloc[0]
            part = rows["part"].to_numpy() if cross else None
            found = tree_of_links(rows["mark"].to_numpy(), sets, sketch, part, least)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            table = batch[keys].to_numpy()
            edges = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                here = tuple(table[a].tolist())
                if here != last and held:
                    yield links(held)
                    held = []
                last = here
                held.append(batch.iloc[a:b])
        if held:
            yield links(held)

    return stage(dealt.mapInPandas(run, "a long, b long"), "links")


def _rooted(described: DataFrame, text: str, width: int, least: float, most: int) -> DataFrame:
    """The described rows with root, the smallest mark reachable by links."""
    classes = stage(
        described.where("size > 0")
        .groupBy("mark")
        # But for the row these are the same in all rows of a class.
        .agg(
            F.min("rid").alias("rid"),
            *[F.first(c).alias(c) for c in ("size", "fingerprint", "bands", "sketch")],
        ),
        "classes",
    )
    links = _links(stage(_groups(classes, most), "met"), described, text, width, least)
    roots = components(links).withColumnRenamed("node", "mark")
    return described.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def near_copies(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    least: float = 0.8,
    most: int = MOST,
) -> DataFrame:
    """key, mark (the text's class) and root (the smallest mark reachable by links) of each row."""
    described = _described_rows(documents, key, text, width)
    return _rooted(described, text, width, least, most).select(F.col("key").alias(key), "mark", "root")


def one_of_each(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    least: float = 0.8,
    most: int = MOST,
) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest key."""
    described = _described_rows(documents, key, text, width)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "rid"))
    chosen = (
        _rooted(described, text, width, least, most)
        .groupBy("root")
        .agg(first.alias("first"))
        .select(F.col("first.rid").alias("rid"))
    )
    # Most rows stay, so the others are fewer to move.
    dropped = _counted(described.select("rid").join(chosen, "rid", "left_anti"))
    return described.join(dropped, "rid", "left_anti").select("row.*")
