"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from scour.llm import spelling
from scour.llm.queries import spoiled_words


def near(a, b):
    shorter, longer = sorted((a, b), key=len)
    if len(longer) - len(shorter) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def all_pairs(counts, ratio=5):
    forms, rows = {}, {}
    for word, n in counts.items():
        others = [other for other in counts if near(word, other)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= ratio * n else None
        rows[word] = len(others)
    found = set()
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        form = forms[word]
        found.add((word, n, rows[word], form, counts[form] if form else None, root))
    return found


def rows(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def invented(rng, size):
    letters = "abcdeéÿß×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(size)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in words[: size // 2] for i in [len(w) // 2]]
    return {w: rng.choice([5, 6, 30, 200, 1500]) for w in words}


@pytest.mark.parametrize("block, visitors, few", [(8192, 16384, 24), (16, 7, 1)])
def test_against_all_pairs(spark, monkeypatch, block, visitors, few):
    """Also with many parts a block, small slices and a whole trie."""
    for name, value in (("BLOCK", block), ("VISITORS", visitors), ("FEW", few), ("PAIRS", 50)):
        monkeypatch.setattr(spelling, name, value)
    counts = invented(random.Random(block), 500)
    # Long words, equal but for one letter at either end or in the middle.
    long = "ab" * 100
    counts |= {long: 500, "x" + long: 90, long + "x": 80, long[:100] + "é" + long[101:]: 5, long[:-1]: 5}
    edge = "c" * spelling.WIDTH
    counts |= {edge: 900, edge + "c": 100, edge[:-1] + "d": 10, edge[:-1]: 10, edge + "cc": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert rows(spelling.spelling_variants(table)) == all_pairs(counts)


def test_all_levels(spark, monkeypatch):
    counts = invented(random.Random(7), 300)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    monkeypatch.setattr(spelling.math, "log2", lambda x: 99.0)
    assert rows(spelling.spelling_variants(table)) == all_pairs(counts)


def test_one_edit_on_every_kind():
    words = ["", "a", "b", "ab", "ba", "abc", "abd", "aab", "abab", "ababa", "babab", "baba"]
    for a in words:
        for b in words:
            assert spelling.one_edit(a.encode("latin-1"), b.encode("latin-1")) == near(a, b), (a, b)


def test_odd_tables(spark):
    schema = "word string, n long, home int, block string"
    table = spark.createDataFrame(
        [(None, 5, 1, "x"), ("hello", 20, 1, None), ("hello", 5, None, "y"), ("hallo", 5, 1, "z"), ("", 9, 1, "q")], schema
    )
    assert rows(spelling.spelling_variants(table)) == {
        ("hello", 25, 1, None, None, "hello"), ("hallo", 5, 1, "hello", 25, "hello"), ("", 9, 0, None, None, ""),
    }
    assert rows(spelling.spelling_variants(table.where("false"))) == set()
    bad = spark.createDataFrame([("дом", 5)], "word string, n long")
    with pytest.raises(ValueError, match="U\\+00FF"):
        spelling.spelling_variants(bad)


def test_ties_go_to_the_smaller_word(spark):
    counts = {"stones": 5, "stonez": 25, "stoned": 25, "éstones": 25}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.spelling_variants(table)) == all_pairs(counts)


def test_spoiled_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Stones", "water!", "Ébène", "rivière", "x", "ABCDEFg"]) for _ in range(60)) for _ in range(40)]
    table = [(i, t) for i, t in enumerate(texts)] + [(None, "Stones stones"), (7, None), (8, ""), (9, "q" * 100_000)]
    documents = spark.createDataFrame(table, "doc_id long, text string")
    expected = Counter()
    for i, text in table:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = "".join(x.lower() if x < "\x80" else x for x in run)
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % 199 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                expected[word] += 1
            run = ""
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 2}
    counted = spelling.count_words(spoiled_words(documents), 6, 2)
    assert {r.word: r.n for r in counted.collect()} == expected
