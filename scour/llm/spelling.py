"""Spelling variants: words that differ by one letter, grouped under the most frequent spelling.

Letters are dealt into groups, and a word is the vector of its numbers of letters of each group. A
trie arranges the words by these numbers, one group a level. One inserted letter raises one number
by one, a deleted one lowers one, a replaced one does both or neither, so a depth-first search from
the root may spend a surplus of one and a deficit of one on its way down. The words of the leaves it
reaches are verified letter by letter. Many words go down the trie together: a node holds those that
have not overspent, and where few words are left below a node the remaining levels are compared at
once.

The first levels of the trie deal the work: words with equal first numbers are a block, and a word
visits the blocks that its budget reaches. Of two blocks only one side visits the other, so each
pair meets once. Blocks of more than `BLOCK` words are cut into parts by hash, each of which is
visited, so that a task holds a bounded number of words. More words take more levels. What a task
gives is a count and the best spelling of each word, never the pairs.

Defined cases: words are strings of the letters U+0001 to U+00FF; others raise an error. Null words
are left out. Words of any length are compared whole. Ties of frequency go to the smaller word in
code-point order. Empty tables give no rows. Repeated words are one word, their numbers added.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.sources.staging import stage

GROUPS, LEVELS = 12, 7
#: Words of a part, words that visit it at a time, words below a node that are compared at once.
BLOCK, VISITORS, FEW = 8192, 16384, 24
#: Bytes of a word that are compared in a table; longer words are compared one by one.
WIDTH = 48
#: Pairs that are verified at a time.
PAIRS = 1 << 16


# --- words ----------------------------------------------------------------------------------------


def count_words(words: DataFrame, shortest: int, least: int, word: str = "word") -> DataFrame:
    """word and n of the words of at least `shortest` letters that occur at least `least` times."""
    return (
        words.where(F.length(word) >= shortest)
        .groupBy(F.col(word).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def letter_groups(spark: SparkSession, words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters in groups of similar frequency, the most frequent letters apart."""
    counted = (
        words.select(F.explode(F.split("word", "")).alias("letter"))
        .where("letter <> ''")
        .groupBy("letter")
        .count()
        .collect()  # at most 255 letters
    )
    dealt, sums = [""] * groups, [0] * groups
    for row in sorted(counted, key=lambda row: (-row["count"], row["letter"])):
        if ord(row["letter"]) > 255:
            raise ValueError(f"Letter {row['letter']!r} is not one of U+0001 to U+00FF")
        at = sums.index(min(sums))
        dealt[at] += row["letter"]
        sums[at] += row["count"]
    return dealt


def _block(word: Column, groups: list[str], levels: int) -> Column:
    """The first numbers of the vector, a byte each."""
    block = F.lit(0).cast("long")
    for level, letters in enumerate(groups[:levels]):
        # A group may be empty when there are few letters.
        number = F.length(word) - F.length(F.translate(word, letters, "")) if letters else F.lit(0)
        block = block + F.least(number, F.lit(255)).cast("long") * (1 << 8 * level)
    return block


def _steps(levels: int) -> list[int]:
    """The differences of block numbers that a budget can make, of a difference and its reverse one."""
    ones = [1 << 8 * level for level in range(levels)]
    return [0, *ones, *(b - a for i, a in enumerate(ones) for b in ones[i + 1 :])]


# --- trie -----------------------------------------------------------------------------------------


class Words:
    """Words as bytes, with their letters in a table and their vectors."""

    def __init__(self, words: pd.Series, counts: pd.Series, group_of: np.ndarray):
        self.words = [word.encode("latin-1") for word in words]
        self.counts = counts.to_numpy(np.int64)
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        of = np.repeat(np.arange(len(self.words)), self.sizes)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        shown = within <= WIDTH
        # One column more than is compared, for the longer word of a pair.
        self.letters = np.zeros((len(self.words), WIDTH + 1), np.uint8)
        self.letters[of[shown], within[shown]] = flat[shown]
        numbers = np.bincount(of * GROUPS + group_of[flat], minlength=len(self.words) * GROUPS)
        self.vectors = np.minimum(numbers, 255).astype(np.int16).reshape(len(self.words), GROUPS)


def search(vectors: np.ndarray, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Visitors and words whose vectors differ by a surplus and a deficit of one each at most.

    `vectors` are sorted, so that a node of the trie is a range of them.
    """
    todo = [(0, 0, len(vectors), np.arange(len(visitors)), np.zeros((2, len(visitors)), np.int16))]
    while todo:
        level, low, high, alive, spent = todo.pop()
        if level == GROUPS or high - low <= FEW:
            over = vectors[None, low:high, level:] - visitors[alive, None, level:]
            fits = (np.maximum(over, 0).sum(2) + spent[0][:, None] <= 1) & (
                np.maximum(-over, 0).sum(2) + spent[1][:, None] <= 1
            )
            who, what = np.nonzero(fits)
            yield alive[who], low + what
            continue
        column = vectors[low:high, level]
        edges = np.flatnonzero(column[1:] != column[:-1]) + 1 + low
        wanted = visitors[alive, level]
        for start, end in zip([low, *edges], [*edges, high]):
            over = vectors[start, level] - wanted
            paid = spent + np.stack([np.maximum(over, 0), np.maximum(-over, 0)])
            fits = (paid <= 1).all(0)
            if fits.any():
                todo.append((level + 1, start, end, alive[fits], paid[:, fits]))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`one_edit` of many pairs."""
    found = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        la, lb = left.sizes[a], right.sizes[b]
        out = found[at : at + PAIRS]
        long = np.maximum(la, lb) > WIDTH
        same = np.flatnonzero((la == lb) & ~long)
        out[same] = (left.letters[a[same]] != right.letters[b[same]]).sum(1) == 1
        for near, far, k in (
            (left.letters[a], right.letters[b], np.flatnonzero((lb - la == 1) & ~long)),
            (right.letters[b], left.letters[a], np.flatnonzero((la - lb == 1) & ~long)),
        ):
            near, far = near[k], far[k]
            first = (near != far).argmax(1)
            after = np.arange(WIDTH) >= first[:, None]
            out[k] = ~((near[:, :WIDTH] != far[:, 1:]) & after).any(1)
        for k in np.flatnonzero(long):
            out[k] = one_edit(left.words[a[k]], right.words[b[k]])
    return found


def _texts(words: Iterable[bytes]) -> pd.Series:
    return pd.Series([word.decode("latin-1") for word in words], dtype=object)


class Best:
    """How many near words each word has, and the most frequent of them."""

    def __init__(self, size: int):
        self.near = np.zeros(size, np.int64)
        self.best: dict[int, tuple[int, bytes]] = {}

    def add(self, mine: np.ndarray, others: np.ndarray, words: Words) -> None:
        np.add.at(self.near, mine, 1)
        for i, j in zip(mine.tolist(), others.tolist()):
            key = (-int(words.counts[j]), words.words[j])
            if i not in self.best or key < self.best[i]:
                self.best[i] = key

    def rows(self, words: Words) -> pd.DataFrame:
        places = list(self.best)
        return pd.DataFrame(
            {
                "word": _texts(words.words[i] for i in places),
                "n_near": self.near[places],
                "form_n": np.array([-self.best[i][0] for i in places], np.int64),
                "form": _texts(self.best[i][1] for i in places),
            }
        )


def _meet(group_of: np.ndarray):
    """Over rows sorted by block and part, own words first: what each word found there."""

    def visit(own: Words, order: np.ndarray, came: pd.DataFrame, found: Best):
        visitors = Words(came["word"], came["n"], group_of)
        theirs = Best(len(came))
        for who, what in search(own.vectors[order], visitors.vectors):
            what = order[what]
            near = verified(visitors, own, who, what)
            theirs.add(who[near], what[near], own)
            found.add(what[near], who[near], visitors)
        return theirs.rows(visitors)

    def among(own: Words, order: np.ndarray, found: Best):
        for at in range(0, len(order), VISITORS):
            for who, what in search(own.vectors[order], own.vectors[at : at + VISITORS]):
                who, what = who + at, order[what]
                once = who < what
                who, what = who[once], what[once]
                near = verified(own, own, who, what)
                found.add(who[near], what[near], own)
                found.add(what[near], who[near], own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = own = order = found = None
        waiting: list[pd.DataFrame] = []

        def settle():
            """Own words are complete as soon as a visitor comes."""
            nonlocal own, order, found, waiting
            rows = pd.concat(waiting, ignore_index=True)
            own, waiting = Words(rows["word"], rows["n"], group_of), []
            order = np.lexsort(own.vectors.T[::-1])
            found = Best(len(own.words))
            same = rows["among"].to_numpy()
            if same.any():
                among(own, order, found)

        for batch in batches:
            keys = batch[["block", "part"]].to_numpy()
            visitor = batch["visits"].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                here = tuple(keys[a])
                if here != group:
                    if group is not None:
                        if waiting:
                            settle()
                        if own is not None:
                            yield found.rows(own)
                    group, own, waiting = here, None, []
                piece = batch.iloc[a:b]
                if not visitor[a]:
                    waiting.append(piece)
                    continue
                if own is None and waiting:
                    settle()
                for at in range(0, len(piece), VISITORS):
                    yield visit(own, order, piece.iloc[at : at + VISITORS], found)
        if group is not None:
            if waiting:
                settle()
            if own is not None:
                yield found.rows(own)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form (the most frequent near word) and form_n of each word that has near words.

    `words` has the columns word, each once, and n.
    """
    spark = words.sparkSession
    count = words.count()
    groups = letter_groups(spark, words)
    levels = min(LEVELS, max(1, math.ceil(math.log2(max(1, count / 2000)) / 1.5)))
    group_of = np.zeros(256, np.int64)
    for group, letters in enumerate(groups):
        group_of[[ord(letter) for letter in letters]] = group
    placed = words.select("word", "n", _block(F.col("word"), groups, levels).alias("home"))
    parts = stage(
        placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")),
        "blocks",
    ).withColumnRenamed("home", "block")
    dealt = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    own = placed.withColumnRenamed("home", "block").join(parts, "block").select(
        "block", dealt.alias("part"), F.lit(False).alias("visits"), "word", "n"
    )
    steps = F.array(*[F.lit(step).cast("long") for step in _steps(levels)])
    visitors = (
        placed.select("word", "n", "home", F.explode(steps).alias("step"))
        .withColumn("block", F.col("home") + F.col("step"))
        .join(parts, "block")
        # A block meets itself: each of its parts by its own words, two parts once.
        .withColumn("own", F.when(F.col("step") == 0, dealt).otherwise(-1))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("part > own")
        .select("block", "part", F.lit(True).alias("visits"), "word", "n")
    )
    met = (
        own.unionByName(visitors)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "part")
        .sortWithinPartitions("block", "part", "visits")
        .select("block", "part", "visits", (~F.col("visits")).alias("among"), "word", "n")
    )
    found = met.mapInPandas(_meet(group_of), "word string, n_near long, form_n long, form string")
    return (
        found.groupBy("word")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best"),
        )
        .select(
            "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")
        )
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms. A form is more frequent, so chains end.

    Each round doubles how far a word sees.
    """
    seen = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(seen.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        if joined.where("next IS NOT NULL").isEmpty():
            return seen
        seen = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word.

    `words` has the columns word and n. A word's form is its most frequent near word if that is at
    least `ratio` times as frequent; its root is where following the forms ends.
    """
    known = stage(
        words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    held = F.col("form_n") >= ratio * F.col("n")
    judged = stage(
        known.join(near_words(known), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(held, F.col("form")).alias("form"),
            F.when(held, F.col("form_n")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
