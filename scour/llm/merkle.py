r"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A text is cut into sections (after blank lines), these into paragraphs (after line breaks), these
into sentences (after end marks and white space, or an end mark of scripts that write none), these
into pieces: after words whose hash meets a condition, and `PIECE` characters after the last cut at
the latest. So no leaf is long, cuts depend only on what is before them in the sentence, and texts
that begin alike share leaves. Separators stay with what they end, so the parts put together are the
text, and a node is the SHA-256 of its children's digests: roots are equal if and only if texts
are. Comparing trees from the root down finds the parts that differ without the
texts; the leaves that two trees share say how alike they are.

A fingerprint is the root's digest, a colon, and the first eight digits of each leaf's digest.

Defined cases: a null text is empty, an empty text has one empty leaf. Two equal fingerprints have
likeness 1. Very long texts are cut whole. Rows that share a key have the same next row: of those
with the next larger key, the one whose taken beginning, then fingerprint, is smallest. The last key
is followed by the first, a single one by itself; a null key has no next document, which counts as
an empty one.
Repeated rows are all returned. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scour.llm.ordering import with_positions
from scour.sources.staging import stage

#: One word in so many ends a piece, and the most characters of a piece.
WORDS, PIECE = 16, 96
LEAF_DIGITS = 8

# Marks of cuts, and of escaped marks in the text.
SECTION, PARAGRAPH, SENTENCE, WORD, PIECE_END, ESCAPE = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"
WORD_END = r"[ \t]+(?!\z)"
# The blank of an end mark's sentence ends its last word too; that mark goes.
SENTENCE_END = f"(?:([.!?…؟۔।॥][ \t]){WORD}?|([。！？．｡]))(?!\\z)"
PARAGRAPH_END = r"\n(?![ \t\r\x04]*\n)(?!\z)"
SECTION_END = f"(\n[ \t\r{WORD}]{{0,16}}\n){PARAGRAPH}"


def _digest(parts: Column) -> Column:
    """The digest of a node from those of its children."""
    return F.sha2(F.array_join(parts, ""), 256)


def _marked(text: Column) -> Column:
    """The text with a mark at each cut.

    Patterns run over the whole text, once each; what is left to do for each part is to split at a
    single character. Marks that the text holds itself are escaped first.
    """
    marks = (ESCAPE, SECTION, PARAGRAPH, SENTENCE, WORD, PIECE_END)
    escaped = text
    for number, mark in enumerate(marks):
        escaped = F.replace(escaped, F.lit(mark), F.lit(f"{ESCAPE}{number}"))
    safe = F.when(text.rlike(f"[{SECTION}-{ESCAPE}]"), escaped).otherwise(text)
    words = F.regexp_replace(safe, WORD_END, f"$0{WORD}")
    sentences = F.regexp_replace(words, SENTENCE_END, f"$1$2{SENTENCE}")
    paragraphs = F.regexp_replace(sentences, PARAGRAPH_END, f"\n{PARAGRAPH}")
    return F.regexp_replace(paragraphs, SECTION_END, f"$1{SECTION}")


def _pieces(sentence: Column) -> Column:
    """Digests of the pieces of a sentence."""
    words = F.transform(
        F.split(sentence, WORD),
        lambda word: F.when(
            F.pmod(F.xxhash64(word), F.lit(WORDS)) == 0, F.concat(word, F.lit(PIECE_END))
        ).otherwise(word),
    )
    # The last word needs no end.
    by_words = F.split(F.rtrim(F.array_join(words, ""), F.lit(PIECE_END)), PIECE_END)
    bounded = F.transform(
        by_words,
        lambda piece: F.when(F.length(piece) <= PIECE, F.array(piece)).otherwise(
            F.regexp_extract_all(piece, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        ),
    )
    return F.transform(F.flatten(bounded), lambda piece: F.sha2(piece, 256))


def tree(text: Column) -> Column:
    """Digests of the pieces, by sentence, paragraph and section."""
    return F.transform(
        F.split(_marked(F.coalesce(text, F.lit(""))), SECTION),
        lambda section: F.transform(
            F.split(section, PARAGRAPH),
            lambda paragraph: F.transform(F.split(paragraph, SENTENCE), _pieces),
        ),
    )


def root(digests: Column) -> Column:
    return _digest(
        F.transform(
            digests,
            lambda section: _digest(
                F.transform(section, lambda paragraph: _digest(F.transform(paragraph, _digest)))
            ),
        )
    )


def leaves(digests: Column) -> Column:
    """The first digits of each leaf, in order."""
    return F.transform(
        F.flatten(F.flatten(F.flatten(digests))), lambda digest: F.substring(digest, 1, LEAF_DIGITS)
    )


def fingerprint(digests: Column) -> Column:
    return F.concat(root(digests), F.lit(":"), F.array_join(leaves(digests), ""))


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with the fingerprint of a text column; the tree is built once."""
    return (
        rows.withColumn("__tree", tree(F.col(text)))
        .withColumn(name, fingerprint(F.col("__tree")))
        .drop("__tree")
    )


def _leaf_set(mark: Column) -> Column:
    after = F.substring_index(mark, ":", -1)
    return F.array_distinct(F.regexp_extract_all(after, F.lit(f".{{{LEAF_DIGITS}}}"), F.lit(0)))


def with_likeness(rows: DataFrame, one: str, others: dict[str, str]) -> DataFrame:
    """For each other fingerprint column, a column with its likeness to the first, from 0 to 1.

    It is the share of leaves, repeats aside, that two trees have in common.
    """
    sets = rows.withColumn("__leaves", _leaf_set(F.col(one))).withColumns(
        {f"__leaves_{name}": _leaf_set(F.col(other)) for name, other in others.items()}
    )
    own = F.col("__leaves")
    scores = {}
    for name, other in others.items():
        leaf_set = F.col(f"__leaves_{name}")
        shared = 2.0 * F.size(F.array_intersect(own, leaf_set))
        scores[name] = F.when(F.col(one) == F.col(other), F.lit(1.0)).otherwise(
            shared / (F.size(own) + F.size(leaf_set))
        )
    return sets.withColumns(scores).drop("__leaves", *[f"__leaves_{name}" for name in others])


def differing_parts(a: DataFrame, b: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, paragraph and sentence (from 0) of the parts of `a` that `b` has otherwise.

    From the root down: trees with equal roots are left at once, then equal sections and
    paragraphs. Parts are compared place by place.
    """
    sides = [
        side.select(F.col(key).alias("key"), tree(F.col(text)).alias(name))
        for side, name in ((a, "own"), (b, "other"))
    ]
    place = F.col("other")
    return (
        sides[0]
        .join(sides[1], "key")
        .where(root(F.col("own")) != root(place))
        .select("key", "other", F.posexplode("own").alias("section", "own"))
        .withColumn("other", F.get("other", F.col("section")))
        .where(~F.col("own").eqNullSafe(F.col("other")))
        .select("key", "section", "other", F.posexplode("own").alias("paragraph", "own"))
        .withColumn("other", F.get("other", F.col("paragraph")))
        .where(~F.col("own").eqNullSafe(F.col("other")))
        .select("key", "section", "paragraph", "other", F.posexplode("own").alias("sentence", "own"))
        .where(~F.col("own").eqNullSafe(F.get("other", F.col("sentence"))))
        .select(F.col("key").alias(key), "section", "paragraph", "sentence")
    )


def _neighbours(documents: DataFrame, key: str, text: str) -> DataFrame:
    """For each key the next one, and how many characters the one before takes of its text."""
    sizes = (
        documents.select(F.col(key).alias("key"), F.length(F.coalesce(text, F.lit(""))).alias("size"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("size").alias("size"))
    )
    placed = stage(with_positions(sizes, "key"), "places")
    count = placed.count()
    before = placed.select(
        ((F.col("position") + 1) % max(1, count)).alias("position"),
        F.col("key").alias("previous"),
        F.floor(F.col("size") / 2).cast("int").alias("taken"),
    )
    return placed.join(before, "position").select("key", "previous", "taken")


def edited_fingerprints(
    documents: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness.

    The edited text has its second half replaced by as much of the next document's beginning. Trees
    are built once a text. Whole texts are then shuffled once with their fingerprints, by key: there
    they meet what is taken of them and, through the same exchange, what they take. Only that
    beginning and the fingerprint move on to the document before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = with_fingerprint(
        documents.select(F.col(key).alias("key"), body.alias("text")), "text", "fingerprint"
    )
    known = rows.where("key IS NOT NULL")
    near = stage(_neighbours(documents, key, text), "neighbours")
    follower = (
        known.join(near, "key")
        .groupBy("previous")
        .agg(
            F.min(F.struct(F.expr("substring(text, 1, taken)").alias("start"), "fingerprint")).alias(
                "next"
            )
        )
    )
    followed = known.join(follower, known["key"] == follower["previous"], "left").drop("previous")
    alone = rows.where("key IS NULL").withColumn(
        "next", F.lit(None).cast(follower.schema["next"].dataType)
    )
    half = F.floor(F.length("text") / 2).cast("int")
    start = F.coalesce("next.start", F.lit(""))
    edited = followed.unionByName(alone).select(
        "key",
        F.length("text").cast("long").alias("n_chars"),
        "fingerprint",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - half),
            F.substring(start, F.lit(1), half),
        ).alias("edited"),
        F.coalesce("next.fingerprint", fingerprint(tree(F.lit("")))).alias("next_fingerprint"),
    )
    marked = with_fingerprint(
        edited.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint"
    )
    pairs = {"near_edited": "edited_fingerprint", "near_next": "next_fingerprint"}
    return with_likeness(marked, "fingerprint", pairs).select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
