"""The near-duplicates stage against all pairs of five-word shingle sets."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scour.llm import components, near_copies

SCHEMA = "doc_id bigint, text string, source string"


def plain_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows, least):
    """The smallest key of each component of pairs with that similarity."""
    sets = {key: plain_sets(text) for key, text in rows}
    group = {key: {key} for key in sets}
    for a in sets:
        for b in sets:
            both = sets[a] | sets[b]
            if a < b and (not both or len(sets[a] & sets[b]) >= least * len(both)):
                merged = group[a] | group[b]
                for key in merged:
                    group[key] = merged
    return sorted({min(g) for g in group.values()})


@pytest.mark.parametrize("part, many", [(2048, 8), (2, 1000), (2, 1)])
def test_pairs_from_a_similarity_of_0_8(spark, part, many, monkeypatch):
    """With whole groups, with groups in many parts, and with single bands in place of groups."""
    monkeypatch.setattr(near_copies, "PART", part)
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "BROADCAST", 0 if many == 1 else 1000)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one three")]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    # A dense group just below: every two differ in two words each, 126 of 166 shingles are shared.
    base = [rng.choice(words) for _ in range(150)]
    for i in range(24):
        copy = list(base)
        copy[5 * i + 5] = copy[5 * ((i + 9) % 24) + 6] = f"own{i}"
        rows.append((len(rows), " ".join(copy)))
    # A chain: only neighbours are alike, and it ties two groups.
    copy = [rng.choice(words) for _ in range(150)]
    for i in range(6):
        rows.append((len(rows), " ".join(copy)))
        for at in range(20 * i + 5, 20 * i + 20, 5):
            copy[at] = f"new{at}"
    table = spark.createDataFrame([(*row, "s") for row in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "").collect()
    assert sorted(row.doc_id for row in kept) == plain_kept(rows, 0.8)


def test_links_are_a_tree():
    """A group gives at most one link for each member, and joins what all its pairs join."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 300).astype(np.uint64)
    sets = []
    for _ in range(200):
        copy = base.copy()
        changed = rng.integers(0, 300, rng.integers(1, 45))
        copy[changed] = rng.integers(0, 2**62, len(changed))
        sets.append(np.unique(copy))
    marks = np.array([near_copies.mark(s) for s in sets])
    sketch = np.stack([(near_copies.min_hashes(s) >> np.uint64(24)).astype(np.uint8) for s in sets])
    links = near_copies.tree_of_links(marks, sets, sketch, None, 0.8)
    group = {m: {m} for m in marks.tolist()}
    for i in range(200):
        for j in range(i):
            both = len(np.union1d(sets[i], sets[j]))
            if (len(sets[i]) + len(sets[j]) - both) / both >= 0.8:
                merged = group[marks[i]] | group[marks[j]]
                group.update(dict.fromkeys(merged, merged))
    found = {m: {m} for m in marks.tolist()}
    for a, b in links:
        assert found[a].isdisjoint(found[b])
        merged = found[a] | found[b]
        found.update(dict.fromkeys(merged, merged))
    assert found == group


def test_keys(spark):
    rows = [(None, "a b"), (None, "c d"), (5, "a b"), (5, "a b"), (6, "e f"), (6, "e f")]
    table = spark.createDataFrame([(*row, "s") for row in rows], SCHEMA)
    kept = near_copies.one_of_each(table).collect()
    assert sorted((row.doc_id or 0, row.text) for row in kept) == [(0, "c d"), (5, "a b"), (6, "e f")]


def test_components_do_not_rest_on_a_checksum(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    monkeypatch.setattr(components.F, "xxhash64", lambda *columns: components.F.lit(0))
    assert {row.root for row in components.components(chain).collect()} == {0}


def test_tokens_are_decoded(spark):
    table = spark.createDataFrame([(1, "a b, c!", "s", "en")], SCHEMA + ", lang string")
    row = corpus_pipeline.encode(spark, table, "").first()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    text = library.decode(np.frombuffer(row.ids, "<u4").tolist(), skip_special_tokens=False)
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def _pair_of_texts(changed):
    words = [f"w{i * i % 9973}" for i in range(3000)]
    copy = list(words)
    for at in range(changed):
        copy[100 + 400 * at] = "other"
    return [(1, " ".join(words), "s"), (2, " ".join(copy), "s"), (3, "one two three four five six", "s")]


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """Without shared bands of min-hashes the near copies are found by SimHash alone."""
    monkeypatch.setattr(near_copies, "bands", lambda least: [])
    table = spark.createDataFrame(_pair_of_texts(3), SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "").collect()
    assert sorted(row.doc_id for row in kept) == [1, 3]


def test_links_of_fingerprints_are_checked(spark):
    """Fingerprints may link what is not alike; whole sets decide."""
    table = spark.createDataFrame(_pair_of_texts(3), SCHEMA)
    linked = near_copies.near_copies(table, least=0.999, most=12).collect()
    assert len({row.root for row in linked}) == 3
