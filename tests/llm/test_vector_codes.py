"""Vector codes against a plain loop."""

import hashlib

import numpy as np
import pytest

from scour.llm import vector_codes
from scour.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def loop(ids, vectors, labels, parts=8, entries=16, rounds=6, scale=4096):
    """Rows by id, and the digest; the rows are in the order of the first entries."""
    values = np.floor(np.array(vectors, float) * scale).astype(int)
    size = values.shape[1] // parts
    cut = [values[:, p * size : (p + 1) * size] for p in range(parts)]
    books = [part[:entries].copy() for part in cut]

    def nearest():
        return [((part[:, None] - book) ** 2).sum(2).argmin(1) for part, book in zip(cut, books)]

    for _ in range(rounds):
        for part, book, codes in zip(cut, books, nearest()):
            for entry in range(len(book)):
                mine = part[codes == entry]
                if len(mine):
                    book[entry] = [total // len(mine) for total in mine.sum(0).tolist()]
    codes = nearest()
    errors = sum(((part - book[of]) ** 2).sum(1) for part, book, of in zip(cut, books, codes))
    sums = {}
    for label, error in zip(labels, errors.tolist()):
        sums[label] = sums.get(label, 0) + error
    flat = ",".join(str(x) for book in books for row in book.tolist() for x in row)
    return sorted(
        (i, "".join(f"{of[k]:02x}" for of in codes), int(errors[k]), sums[labels[k]], repr(labels[k]))
        for k, i in enumerate(ids)
    ), hashlib.sha256(flat.encode()).hexdigest()


def found(rows, **options):
    coded = vector_codes.encode(rows, **options)
    shown = vector_codes.with_label_errors(coded.rows).collect()
    return sorted(
        (r.key, r.codes.hex(), r.error, r.label_error, repr(r.label)) for r in shown
    ), vector_codes.digest(coded.codebooks)


@pytest.mark.parametrize(
    "kind, entries", [("uniform", 16), ("clusters", 5), ("ties", 16), ("ties", 1)]
)
def test_against_a_loop(spark, kind, entries, monkeypatch):
    monkeypatch.setattr(vector_codes, "SLICE", 97)
    rng = np.random.default_rng(entries)
    vectors = rng.normal(size=(700, 16)) / 4
    if kind == "clusters":
        vectors = rng.normal(size=(9, 16))[rng.integers(0, 9, 700)] + rng.normal(size=(700, 16)) / 50
    if kind == "ties":  # few values, many equal distances and equal rows
        vectors = rng.integers(-2, 3, size=(700, 16)) / 4096
    labels = [None if i % 11 == 0 else int(i % 3) for i in range(700)]
    table = spark.createDataFrame(
        [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(vectors, labels))],
        "vec_id long, embedding array<double>, label int",
    ).repartition(5)
    if entries != 16:
        monkeypatch.setattr(vector_codes, "BROADCAST", 0)
    assert found(table, entries=entries) == loop(range(700), vectors, labels, entries=entries)


def test_few_distances_are_computed(monkeypatch):
    """Bounds settle most rows of clustered data."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, size=(16, 8))
    values = middles[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, size=(3000, 8))
    bounds = vector_codes.Bounds.fresh(values, middles, 4)
    moved = middles + rng.integers(-9, 10, size=middles.shape)
    bounds.move(np.sqrt(((moved - middles) ** 2).sum(1)))
    rows = []
    real = vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda v, e: rows.append(len(v)) or real(v, e))
    bounds.assign(values, moved)
    assert (bounds.code == real(values, moved).argmin(1)).all()
    assert sum(rows) < 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * k) % 7 - 3) / 3 for k in range(8)], "a" if i % 2 else None) for i in range(30)]
    odd = [
        (1, None, "a"), (2, [nan] * 8, "a"), (3, [inf] + [0.0] * 7, "a"), (4, [None] + [0.0] * 7, "a"),
        (5, [0.5] * 16, "a"), (6, [], "a"), (-7, [-0.0] * 8, None), (-7, [-0.0] * 8, None),
    ]
    rows = [(i, v, label, "x", 1) for i, v, label in good + odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, codes string, error int")
    kept = sorted(
        [(i, np.float32(v).tolist(), label) for i, v, label in good + odd[-2:]], key=lambda r: r[0]
    )
    assert found(table.repartition(3)) == loop(*zip(*kept))
    assert found(table.where("false"))[0] == []
    assert found(table.where("vec_id = 5 AND size(embedding) = 8"), parts=3)[0] == []
    short = spark.createDataFrame([(1, [1.0] * 12, 0)], "vec_id long, embedding array<double>, label int")
    assert found(short)[0] == []
    large = spark.createDataFrame([(1, [1e9] * 8, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond"):
        found(large)


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels = [r.vec_id for r in rows], [r.label for r in rows]
    wanted, digest = loop(ids, [r.embedding for r in rows], labels)
    got = QUERIES["op13_vector_codes"](spark, SF_DIR).collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [row[:4] for row in wanted]
