r"""Chat formatting: quoted passages are linked to the messages they come from.

Lines that begin with quote marks (`>`, `> >`, `>>`) have as many levels as marks. Neighbouring
lines of one level, up to a blank line, are a passage. A passage's own words (lower case, white
space as single blanks) are hashed; a quoted passage meets the passages that messages of the same
conversation say themselves in an equi-join on the hash. If the whole passage is not found, its lines
are. The original is the earliest message that has it.

A message replies to the original it quotes at the lowest level, the latest of several; without one
it replies to the message before it. Replies make a tree, and its preorder, replies in order of
their turns, is the order of the conversation. Trees are ordered by ranking the arcs of a walk around
them: every arc points to the next, and pointers are doubled until all reach the end, in as many
joins as the logarithm of the longest conversation. Conversations in which every message follows the
one before have their turns' order and need none. No conversation is gathered in one task.

Defined cases: null and empty texts have no passages and an empty own text. Rows without a
conversation or turn are kept, without links and position. Rows that share both are versions of one
message: they have the links of all, and one position. A quote is no link to its own or a later
message. Passages said by several messages belong to the earliest. Very long texts are parsed whole.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.ordering import with_positions
from scour.sources.staging import stage

LINE_END = r"\r\n|\n|\r"
MARKS = r"^(?:[ \t]{0,3}>)+"
ATTRIBUTION = r"(?i)^[ \t]*(on\b.*\bwrote|.*\bwrites):[ \t]*$"
# Control characters that stand between passages while they are cut, and are blanks in a text.
PASSAGE, LEVEL = "\x1e", "\x1f"


def _lines(text: Column) -> Column:
    """level and content of each line."""
    cleaned = F.translate(F.coalesce(text, F.lit("")), PASSAGE + LEVEL, "  ")

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 0)
        return F.struct(
            F.length(F.translate(marks, " \t", "")).alias("level"),
            F.regexp_replace(raw, MARKS + r"[ \t]?", "").alias("content"),
        )

    return F.transform(F.split(cleaned, LINE_END), line)


def _own_text(lines: Column) -> Column:
    """The lines without marks, but for those that say who is quoted in the next line."""
    count = F.size(lines)
    following = F.concat(
        F.transform(F.slice(lines, 2, count), lambda line: line["level"]), F.array(F.lit(0))
    )
    kept = F.zip_with(
        lines,
        following,
        lambda line, level: F.when(
            (line["level"] == 0) & ~((level > 0) & line["content"].rlike(ATTRIBUTION)),
            line["content"],
        ),
    )
    return F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[ \t]*\n)+|\s+$", "")


def _passages(lines: Column) -> Column:
    """level and body of each passage, in order."""
    before = F.concat(
        F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("content"))),
        F.slice(lines, 1, F.size(lines) - 1),
    )
    marked = F.zip_with(
        lines,
        before,
        lambda line, last: F.concat(
            F.when(
                (line["level"] == last["level"]) & (F.trim(last["content"]) != ""), F.lit("\n")
            ).otherwise(F.concat(F.lit(PASSAGE), line["level"].cast("string"), F.lit(LEVEL))),
            line["content"],
        ),
    )
    cut = F.split(F.array_join(marked, ""), PASSAGE)
    passages = F.transform(
        F.filter(cut, lambda part: F.trim(F.substring_index(part, LEVEL, -1)) != ""),
        lambda part: F.struct(
            F.substring_index(part, LEVEL, 1).cast("int").alias("level"),
            F.substring_index(part, LEVEL, -1).alias("body"),
        ),
    )
    return passages


def _words(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def _hashes(body: Column) -> Column:
    """The hash of a passage and of each of its lines."""
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line) != "")
    return F.array_distinct(
        F.concat(
            F.array(F.sha2(_words(body), 256)),
            F.transform(lines, lambda line: F.sha2(_words(line), 256)),
        )
    )


def parse(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conversation, turn, role, own_text and passages of each message."""
    return (
        messages.select(
            F.col(conversation).alias("conversation"),
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            _lines(F.col(text)).alias("lines"),
        )
        .select(
            "conversation", "turn", "role",
            _own_text(F.col("lines")).alias("own_text"),
            _passages(F.col("lines")).alias("passages"),
        )
    )


def quotation_links(parsed: DataFrame) -> DataFrame:
    """conversation, turn, passage (its place in the message), level and origin (a turn).

    Said passages are one row a conversation and hash, by an aggregate with a partial before the
    shuffle; a passage that many messages quote meets one row.
    """
    named = parsed.where("conversation IS NOT NULL AND turn IS NOT NULL")
    said = (
        named.select(
            "conversation", "turn",
            F.explode(F.filter("passages", lambda p: p["level"] == 0)).alias("passage"),
        )
        .select("conversation", "turn", F.explode(_hashes(F.col("passage.body"))).alias("hash"))
        .groupBy("conversation", "hash")
        .agg(F.min("turn").alias("origin"))
    )
    quoted = (
        named.select("conversation", "turn", F.posexplode("passages").alias("passage", "content"))
        .where("content.level > 0")
        .select(
            "conversation", "turn", "passage", F.col("content.level").alias("level"),
            F.posexplode(_hashes(F.col("content.body"))).alias("line", "hash"),
        )
    )
    # The whole passage comes before its lines.
    best = F.max(F.struct((F.col("line") == 0).alias("whole"), "origin"))
    return (
        quoted.join(said, ["conversation", "hash"])
        .where("origin < turn")
        .groupBy("conversation", "turn", "passage", "level")
        .agg(best.alias("best"))
        .select("conversation", "turn", "passage", "level", F.col("best.origin").alias("origin"))
    )


def _placed(table: DataFrame, *order: str) -> DataFrame:
    """Rows in order of the columns, with the row before them under `before`."""
    key = F.struct(*order)
    placed = stage(with_positions(table.withColumn("__order", key), "__order"), "places")
    last = placed.select((F.col("position") + 1).alias("position"), F.col("__order").alias("before"))
    return placed.join(last, "position", "left").drop("__order")


def _tree_order(nodes: DataFrame) -> DataFrame:
    """position (the node) and left (nodes from it to the end of its tree's preorder).

    `nodes` has position, conversation, turn and parent (a position, null for a root).
    """
    siblings = _placed(
        nodes.where("parent IS NOT NULL").select("parent", F.col("position").alias("node")),
        "parent", "node",
    )
    pairs = siblings.where("before.parent = parent").select(
        F.col("before.node").alias("node"), F.col("node").alias("sibling")
    )
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.min("position").alias("child"))
    around = (
        nodes.select(F.col("position").alias("node"), "parent")
        .join(pairs, "node", "left")
        .join(children.withColumnRenamed("parent", "node"), "node", "left")
    )
    down, up = F.col("node") * 2, F.col("node") * 2 + 1
    arcs = stage(
        around.select(
            down.alias("arc"),
            F.coalesce(F.col("child") * 2, up).alias("next"),
            F.lit(1).cast("long").alias("left"),
        ).unionByName(
            around.select(
                up.alias("arc"),
                F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"),
                F.lit(0).cast("long").alias("left"),
            )
        ),
        "arcs",
    )
    while not arcs.where("next IS NOT NULL").isEmpty():
        ahead = arcs.select(
            F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("left").alias("more")
        )
        arcs = stage(
            arcs.join(ahead, "next", "left").select(
                "arc", F.col("beyond").alias("next"),
                (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"),
            ),
            "arcs",
        )
    return arcs.where("arc % 2 = 0").select((F.col("arc") / 2).cast("long").alias("position"), "left")


def conversations_without_quotes(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Each message with its own text, what it replies to, and its place in the conversation.

    Columns: conversation, turn and role under their names, reply_to (a turn), position (from 0 in
    the conversation's reply order), quotes and linked (numbers of passages), own_text.
    """
    parsed = parse(messages, conversation, turn, role, text)
    links = stage(quotation_links(parsed), "links")
    quoted = links.groupBy("conversation", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "origin")).alias("best"),
        F.count(F.lit(1)).alias("linked"),
    )
    identities = parsed.select("conversation", "turn").where(
        "conversation IS NOT NULL AND turn IS NOT NULL"
    )
    placed = _placed(identities.distinct(), "conversation", "turn")
    previous = F.when(F.col("before.conversation") == F.col("conversation"), F.col("before.turn"))
    replies = stage(
        placed.join(quoted, ["conversation", "turn"], "left").select(
            "conversation", "turn", "position",
            previous.alias("previous"),
            F.coalesce("best.origin", previous).alias("reply_to"),
            F.coalesce("linked", F.lit(0)).alias("linked"),
        ),
        "replies",
    )
    sizes = replies.groupBy("conversation").agg(
        F.min("position").alias("first"),
        F.count(F.lit(1)).alias("size"),
        F.max(~F.col("reply_to").eqNullSafe(F.col("previous"))).alias("branched"),
    )
    ordered = replies.join(sizes, "conversation")
    place = F.col("position") - F.col("first")
    if not links.isEmpty():
        nodes = ordered.where("branched")
        parents = nodes.select(
            "conversation", F.col("turn").alias("reply_to"), F.col("position").alias("parent")
        )
        ranked = _tree_order(
            stage(
                nodes.join(parents, ["conversation", "reply_to"], "left").select(
                    "position", "conversation", "turn", "parent"
                ),
                "nodes",
            )
        )
        ordered = ordered.join(ranked, "position", "left")
        place = F.coalesce(F.col("size") - F.col("left"), place)
    ordered = ordered.select(
        "conversation", "turn", "reply_to", "linked", place.cast("long").alias("position")
    )
    return parsed.join(ordered, ["conversation", "turn"], "left").select(
        F.col("conversation").alias(conversation),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        "reply_to",
        "position",
        F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("quotes"),
        F.coalesce("linked", F.lit(0)).alias("linked"),
        "own_text",
    )
