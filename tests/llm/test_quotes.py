"""Quotation linking against a plain walk through each conversation."""

import random
import re

from scour.llm.quotes import conversations_without_quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, own_text string"


def plain(messages):
    """What the operator should return, message by message."""

    def level_of(line):
        marks = re.match(r"(?:[ \t]{0,3}>)+", line)
        return (marks.group().count(">"), re.sub(r"^(?:[ \t]{0,3}>)+[ \t]?", "", line)) if marks else (0, line)

    def words(body):
        return re.sub(r"\s+", " ", body.lower()).strip()

    def passages(text):
        found, last = [], (None, "")
        for level, content in map(level_of, re.split("\r\n|\n|\r", text or "")):
            if level == last[0] and last[1].strip():
                found[-1][1].append(content)
            else:
                found.append((level, [content]))
            last = (level, content)
        return [(level, lines) for level, lines in found if any(x.strip() for x in lines)]

    result = {}
    for conv in {m[0] for m in messages}:
        turns = sorted(m for m in messages if m[0] == conv)
        said, previous, children, replies, linked = {}, None, {}, {}, {}
        for _, turn, _, text in turns:
            for level, lines in passages(text):
                if level == 0:
                    for part in ["\n".join(lines), *[x for x in lines if x.strip()]]:
                        said.setdefault(words(part), turn)
            origins = []
            for level, lines in passages(text):
                if level:
                    whole = said.get(words("\n".join(lines)), turn)
                    parts = [said.get(words(x), turn) for x in lines if x.strip()]
                    parts = [whole] if whole < turn else [x for x in parts if x < turn]
                    if parts:
                        origins.append((-level, max(parts)))
            replies[turn] = max(origins)[1] if origins else previous
            linked[turn] = len(origins)
            children.setdefault(replies[turn], []).append(turn)
            previous = turn
        order, stack = [], list(reversed(children.get(None, [])))
        while stack:
            turn = stack.pop()
            order.append(turn)
            stack += reversed(children.get(turn, []))
        for turn in order:
            result[conv, turn] = (replies[turn], order.index(turn), linked[turn])
    return result


def answers(spark, messages):
    table = spark.createDataFrame([(*m, "other") for m in messages], SCHEMA)
    return conversations_without_quotes(table).collect()


def test_random_conversations(spark):
    rng = random.Random(1)
    messages = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 14)):
            lines = [f"word{rng.randint(0, 40)}  Says {turn % 5}" for _ in range(rng.randint(0, 3))]
            if said and rng.random() < 0.6:
                quoted = rng.choice(said)
                marks = rng.choice([">", "> ", " > ", ">> ", "> > "])
                lines = [marks + x.upper() for x in quoted.split("\n")] + rng.choice([[], [""]]) + lines
            text = "\n".join(lines)
            said.append("\n".join(x for x in lines if ">" not in x) or "nothing")
            messages.append((conv, turn * 3, "user", text))
    found = {
        (r.conv_id, r.turn): (r.reply_to, r.position, r.linked) for r in answers(spark, messages)
    }
    assert found == plain(messages)
    assert any(linked for *_, linked in found.values())


def test_own_text_and_levels(spark):
    messages = [
        (1, 0, "user", "First point.\nGoes on here.\n\nSecond point."),
        (1, 1, "assistant", "An answer\nof two lines."),
        (1, 2, "user", "On Monday Bo wrote:\n> first  POINT.\n> goes on here.\n>> unknown\n\nMy reply.\n"),
        (1, 3, "user", "> not said by anyone"),
        (1, 4, "user", "> of two lines.\nYes."),
    ]
    rows = {r.turn: r for r in answers(spark, messages)}
    assert rows[2].own_text == "My reply."
    assert (rows[2].reply_to, rows[2].quotes, rows[2].linked) == (0, 2, 1)
    assert (rows[3].reply_to, rows[3].linked, rows[3].own_text) == (2, 0, "")
    assert rows[4].reply_to == 1
    assert [rows[t].position for t in range(5)] == [0, 1, 3, 4, 2]


def test_odd_rows(spark):
    messages = [
        (None, 0, "user", "a"), (1, None, "user", "> a"), (1, 0, None, None), (1, 1, "user", ""),
        (1, 1, "user", ""), (1, 2, "user", "x " * 50_000),
    ]
    rows = answers(spark, messages)
    assert len(rows) == len(messages)
    assert sorted(r.position for r in rows if r.position is not None) == [0, 1, 1, 2]
    assert answers(spark, []) == []


def test_long_chain(spark):
    messages = [(7, t, "user", f"> says {t - 2}\nsays {t}" if t > 1 else f"says {t}") for t in range(40)]
    found = {(r.conv_id, r.turn): (r.reply_to, r.position, r.linked) for r in answers(spark, messages)}
    assert found == plain(messages)
