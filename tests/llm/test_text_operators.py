"""BPE, token files, SimHash and fingerprints against brute force and exact round trips."""

import gc
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scour.llm import bpe, merkle, simhash, token_files
from scour.llm.remembered import Remembered

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids int, fingerprint string, `key` string"
ODD = [
    None, "", " \n\t", "a", "A b. C, d!", "İstanbul ǅ ẞ", "日本 ёж́́a क़. x", "x\x1cy \x85 z", "!" * 500,
    "it's we'll 'S <|endoftext|>end<|startoftext|>", "word " * 20_000, "a" * 3000, "same", "same",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, text, 1, "x", "y") for i, text in enumerate(ODD)] + [(None, "same", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# --- BPE ------------------------------------------------------------------------------------------


def test_automaton_on_random_texts(library):
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    codec = bpe.Codec(bpe.automaton_of(content), content)
    pieces = token_files.PieceIds(content)
    rng = random.Random(2)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "etaoin .,", "aA'sS tT", "éèüß İ", "日本 ёж́a.", "!?.-* 09"]
    for _ in range(3000):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 40])))
        wanted = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == wanted, text
        assert codec.decode(packed) == library.decode(wanted, skip_special_tokens=False)
        assert np.frombuffer(pieces.encode(text), "<u2").tolist() == wanted, text


def test_automaton_accepts_what_merges_make():
    """A toy vocabulary, against merging by rank."""
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aa", "b</w>"), ("ab", "ab"), ("bb", "a</w>")]
    base = ["a", "b", "a</w>", "b</w>"]
    vocabulary = {label: i for i, label in enumerate([*base, *[x + y for x, y in merges]])}
    codec = object.__new__(bpe.Codec)
    automaton = bpe.Automaton(vocabulary, merges)
    codec.tokens, codec.number = automaton.tokens, automaton.number.tolist()
    cuts = automaton.offsets.tolist()
    codec.lost = [
        (automaton.starts[a:b].tolist(), automaton.ends[a:b].tolist()) for a, b in zip(cuts, cuts[1:])
    ]
    codec.reach = {
        word: 5 for n in (1, 2, 3) for word in map("".join, __import__("itertools").product("ab", repeat=n))
    }

    def by_rank(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        ranks = {pair: i for i, pair in enumerate(merges)}
        while True:
            found = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
            if not found:
                return [vocabulary[part] for part in parts]
            rank, _ = min(found)
            joined, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == merges[rank]:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined

    for number in range(2, 2**11):
        word = bin(number)[3:].replace("0", "a").replace("1", "b")
        if word:
            assert codec.encode_word(word) == by_rank(word), word


def test_transcode(spark, odd, library):
    rows = bpe.transcode(odd, PATH).collect()
    assert len(rows) == len(ODD) + 1
    for row in rows:
        wanted = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == wanted
        assert row.decoded == library.decode(wanted, skip_special_tokens=False)
    assert bpe.transcode(odd.where("false"), PATH).count() == 0
    assert bpe.transcode(odd, PATH, decoded=None).columns == ["doc_id", "text", "fingerprint", "key", "ids"]


# --- token files ----------------------------------------------------------------------------------


def test_blocks():
    rng = np.random.default_rng(1)
    for count in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, count) >> rng.integers(0, 32, count)).astype(np.uint32)
        control, data = token_files.encode_block(ranks)
        assert len(control) == -(-count // 4)
        assert (token_files.decode_block(count, control, data) == ranks).all()


def test_token_files(spark, odd, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    files = token_files.write_token_files(odd, PATH, 2)
    rows = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [row.doc_id for row in rows] == [None, *range(len(ODD))]
    start = 0
    for row, text in zip(rows, ["same", *ODD]):
        wanted = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, np.frombuffer(row.ids, "<u4").tolist()) == (start, wanted)
        start += len(wanted)
    counts = spark.read.parquet(files.ranks).orderBy("rank").collect()
    assert [row["count"] for row in counts] == sorted((row["count"] for row in counts), reverse=True)
    empty = token_files.write_token_files(odd.where("false"), PATH, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_repeated_keys(spark):
    table = spark.createDataFrame([(1, t) for t in "abcab"] + [(0, "x")], "doc_id bigint, text string")
    files = token_files.write_token_files(table, PATH, 2)
    rows = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [row.doc_id for row in rows] == [0, 1, 1, 1, 1, 1]
    assert len({row.start for row in rows}) == 6


# --- SimHash --------------------------------------------------------------------------------------


def plain_simhash(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_components(codes, most):
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in codes:
        for b in codes:
            if (a ^ b) & (2**64 - 1) and bin((a ^ b) & (2**64 - 1)).count("1") <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {c: root(c) for c in codes}


def test_fingerprint(spark):
    for text in [t for t in ODD if not t or len(t) < 4000] + ["B\x0ba\x85 c d E  f"]:
        assert simhash.simhash(text) == plain_simhash(text)
    assert spark.range(1).select(F.xxhash64(F.lit("one two")).alias("h")).first().h == simhash.simhash("One  TWO")


def test_index_finds_all_links():
    rng = np.random.default_rng(3)
    for _ in range(10):
        codes = []
        for center in rng.integers(0, 2**63, 12, dtype=np.uint64):
            for _ in range(rng.integers(1, 15)):
                for bit in rng.integers(0, 64, rng.integers(0, 6)):
                    center = center ^ (np.uint64(1) << np.uint64(bit))
                codes.append(center)
        codes = np.array(codes, np.uint64)
        a, b = simhash.link_codes(codes, 4)
        wanted = plain_components({int(c) for c in codes}, 4)
        found = plain_edges({int(c) for c in codes}, a, b)
        assert found == wanted


def plain_edges(codes, a, b):
    group = {c: {c} for c in codes}
    for x, y in zip(a.tolist(), b.tolist()):
        merged = group[x] | group[y]
        for c in merged:
            group[c] = merged
    return {c: min(group[c]) for c in codes}


@pytest.mark.parametrize("part", [8192, 3])
def test_near_duplicates(spark, part, monkeypatch):
    rng = random.Random(5)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes, most: links(classes, most, part))
    words = [f"w{i}" for i in range(400)]
    rows, number = [(-1, None), (None, "")], 0
    for _ in range(8):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(150)] = "changed"
            rows += [(number, " ".join(copy))] * rng.choice([1, 1, 2])
            number += 1
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(rows)
    codes = {text: plain_simhash(text) for _, text in rows}
    roots = plain_components(set(codes.values()), 4)
    first = {}
    for key, text in rows:
        if key is not None:
            root = roots[codes[text]]
            first[root] = min(first.get(root, key), key)
    wanted = sorted((str(key), codes[text], first[roots[codes[text]]]) for key, text in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component) for r in found) == wanted
    assert simhash.near_duplicates(table.where("false")).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------


def test_edited_fingerprints(spark, odd):
    texts = [(k, t or "") for k, t in enumerate(ODD)]
    rows = {r.doc_id: r for r in merkle.edited_fingerprints(odd).collect()}
    assert len(rows) == len(ODD) + 1
    for i, (key, text) in enumerate(texts):
        other = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        row = rows[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.near_edited == 1) == (edited == text)
        assert 0 <= row.near_next <= 1
        assert (row.near_next == 1) == (text == other)
    marks = {t: {rows[k].fingerprint for k, u in texts if u == t} for _, t in texts}
    assert all(len(found) == 1 for found in marks.values())
    assert len({next(iter(found)) for found in marks.values()}) == len(marks)


def test_halves_without_end_marks_share_leaves(spark):
    rng = random.Random(9)
    texts = [
        " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(400)), "junk " * 300, "x" * 5000,
        "\u65e5\u672c\u8a9e" * 100, "\U0001f600" * 300, "a\x01b\x02 " * 60, "\u4e00\u4e8c\u4e09\u3002" * 60,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in merkle.edited_fingerprints(table).collect():
        assert row.near_edited > 0, row.doc_id
        assert len(row.fingerprint.partition(":")[2]) // 8 >= len(texts[row.doc_id]) / 96
    leaf = lambda text: spark.range(1).select(merkle.fingerprint(merkle.tree(F.lit(text))).alias("f")).first().f
    assert len({leaf(t) for t in ("a\x01b", "ab", "a\x02\x03b", "a\x02b", "a\x02\x02b")}) == 5


def test_single_and_empty(spark):
    one = spark.createDataFrame([(7, "abcd")], "doc_id bigint, text string")
    row = merkle.edited_fingerprints(one).first()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert merkle.edited_fingerprints(one.where("false")).count() == 0


def test_edits_are_located(spark):
    text = "First one. Second one.\nThird line.\n\nNext section. Its end."
    other = text.replace("Second", "Other").replace("Its end", "Its close")
    a, b = (spark.createDataFrame([(1, t)], "doc_id bigint, text string") for t in (text, other))
    found = sorted((r.section, r.paragraph, r.sentence) for r in merkle.differing_parts(a, b).collect())
    assert found == [(0, 0, 1), (1, 0, 1)]
    assert merkle.differing_parts(a, a).count() == 0


def test_checksums(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"abc")).alias("c")).first().c == zlib.crc32(b"abc")


# --- memory ---------------------------------------------------------------------------------------


def test_remembered_is_bounded_by_bytes():
    held = Remembered(100_000)
    for i in range(20_000):
        held.keep(f"{i:0{i % 250}}", b"x" * (i % 400))
        size = sum(len(k) + len(v) for part in (held, held.before) for k, v in part.items())
        assert size <= 200_000
    held.keep("y" * 10_000, b"")
    assert "y" * 10_000 not in held
    held.forget()
    assert not held and not held.before


def test_long_unbroken_texts(spark):
    """Many long texts without a blank are encoded as the library does, and none is remembered."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("漢字仮名交") for _ in range(3000)) + str(i) for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    wanted = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.transcode(table, path).collect()}
    assert got == wanted
    files = token_files.write_token_files(table, path, 2)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, files).collect()}
    assert back == {i: [*ids, 2] for i, ids in wanted.items()}
    with open(path, encoding="utf-8") as file:
        pieces = token_files.PieceIds(file.read())
    for text in texts:
        pieces.encode(text)
    assert not pieces


# --- trees ----------------------------------------------------------------------------------------


def plain_tree(text, is_end):
    """Digests by section, paragraph and sentence, cut by hand."""

    def cut(part, ends):
        out, start = [], 0
        for at in range(1, len(part)):
            if ends(part, at):
                out.append(part[start:at])
                start = at
        return [*out, part[start:]]

    def blank_line(part, at):
        line = part[at:].split("\n", 1)
        return len(line) > 1 and not line[0].strip(" \t\r")

    def paragraph(part, at):
        return part[at - 1] == "\n" and not blank_line(part, at)

    def section(part, at):
        before = part[: at - 1].rsplit("\n", 1)
        return paragraph(part, at) and len(before) > 1 and not before[1].strip(" \t\r")

    def sentence(part, at):
        return part[at - 1] in "。！？．｡" or (at > 1 and part[at - 1] in " \t" and part[at - 2] in ".!?…؟۔।॥")

    def word(part, at):
        return part[at - 1] in " \t" and part[at] not in " \t"

    def pieces(part):
        out = [""]
        words = cut(part, word)
        for i, one in enumerate(words):
            out[-1] += one
            if is_end(one) and i < len(words) - 1:
                out.append("")
        return [p[i : i + 96] for p in out for i in range(0, max(1, len(p)), 96)]

    def digest(value):
        return hashlib.sha256(value.encode()).hexdigest()

    return [
        [[[digest(p) for p in pieces(s)] for s in cut(q, sentence)] for q in cut(t, paragraph)]
        for t in cut(text, section)
    ]


def test_trees_against_plain_ones(spark):
    rng = random.Random(9)
    parts = ["Word ", "two  words", ". ", ".  ", "! ", "\n", "\n\n", "\n \t\n", "。", "é\r\n", "x" * 150, "a.b", "? \n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    edits = [
        t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]
        for i, t in enumerate(texts)
    ]
    words = sorted({w for t in texts + edits for w in re.split(r"(?<=[ \t])(?![ \t])", t)} | {""})
    # All words of all cuts: sentences may cut a word off earlier.
    words = sorted({w[i:j] for w in words for i in range(len(w) + 1) for j in range(i, min(len(w), i + 60) + 1)} | set(words))
    ends = {
        r.word for r in spark.createDataFrame([(w,) for w in words], "word string")
        .where(F.pmod(F.xxhash64("word"), F.lit(merkle.WORDS)) == 0).collect()
    }
    found = table.select("doc_id", merkle.tree(F.col("text")).alias("tree")).collect()
    for r in found:
        assert r.tree == plain_tree(texts[r.doc_id], ends.__contains__), repr(texts[r.doc_id])
    own = {r.doc_id: r for r in merkle.edited_fingerprints(table).collect()}
    for i, text in enumerate(texts):
        edited = edits[i]
        assert own[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [
            {d[:8] for s in plain_tree(t, ends.__contains__) for q in s for x in q for d in x}
            for t in (text, edited, texts[(i + 1) % len(texts)])
        ]
        if text != edited and not any(len(w) > 60 for w in edited.split()):
            assert own[i].near_edited == 2 * len(sets[0] & sets[1]) / (len(sets[0]) + len(sets[1]))


def test_marks_in_texts_are_no_cuts(spark):
    texts = ["a\x01b", "a\x02b", "ab", "a\x061b", "a\x06b", "a b", "a\x04 b", "a \x04b"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = table.select(merkle.root(merkle.tree(F.col("text"))).alias("root")).collect()
    assert len({r.root for r in rows}) == len(texts)


def test_pieces_of_lowered_texts():
    """Texts that are lower-cased whole give the library's ids, whatever was remembered before."""
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_files.PieceIds(open(path, encoding="utf-8").read())
    special = pieces.special[-1]
    texts = [
        special, special.upper(), f"A {special.upper()} b", f"Word,{special}Word", "ÀÉ Été, ÉTÉ.", "İstanbul I",
        "ΣΑΣ Σ", "Á É É", "IT'S 12a3 Don'T!!", "ẞ ß SS ǅ", "a\x1cB", "A b", "X" * 300 + " x",
    ]
    for text in texts + texts[::-1]:
        assert pieces.encode(text) == pieces.whole(text), text


def test_workers_keep_no_codec(spark):
    """Workers live on between tasks, and other stages need the memory."""
    table = spark.createDataFrame([(i, f"some text {i}") for i in range(64)], "doc_id long, text string")
    assert bpe.transcode(table.repartition(8), PATH).count() == 64

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x) is bpe.Codec for x in gc.get_objects())]})

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
