"""Mixing, URL rules, quality, neighbours, archive and pipeline on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import difference, oracle_connection
from scour.llm import archive, compression, mixing, neighbours, url_rules
from scour.llm.components import components
from scour.llm.ordering import with_positions
from scour.llm.queries import ORACLES, QUERIES, held_out, source_weights

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    connection = oracle_connection(SF_DIR)
    assert difference(spark, SF_DIR, QUERIES[name], ORACLES[name], connection) is None


# --- helpers --------------------------------------------------------------------------------------


def test_positions(spark):
    values = [3, -1, None, 10, 7, 2]
    table = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    found = {r.v: r.position for r in with_positions(table, "v").collect()}
    assert found == {None: 0, -1: 1, 2: 2, 3: 3, 7: 4, 10: 5}
    assert with_positions(table.where("false"), "v").count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (300, 200), (200, 300)]
    edges += [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)]
    group = {}
    for a, b in edges:
        if a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            for node in merged:
                group[node] = merged
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {node: min(g) for node, g in group.items()}
    assert len(found) == len(group)


# --- mixing ---------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(1)
    rows = [
        (i, rng.choice(["a", "b", None, "é", ""]), rng.choice([None, "", "one", "one two " * rng.randint(1, 30)]), 1)
        for i in range(400)
    ]
    rows += [(None, "a", "x y", 1), (None, "a", "x y", 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, text string, weight int")
    mixed = mixing.mix(table, source_weights(table)).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, source, text, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 2))
    target, budget, full = {}, 1.5 * sum(sizes.values()), set()
    while True:
        open_weight = sum(weights[s] for s in sizes if s not in full)
        left = budget - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weights[s] / open_weight for s in sizes}
        more = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for r in mixed:
        assert r.mix.target == pytest.approx(target[r.source])
        assert r.mix.source_size == sizes[r.source]
        rate = target[r.source] / sizes[r.source]
        assert r.mix.copies in (int(rate), int(rate) + 1) and r.mix.copies <= 2
    again = mixing.mix(table, source_weights(table)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))
    copies = mixing.repeat_rows(mixing.mix(table, source_weights(table)))
    assert copies.columns == table.columns
    assert copies.count() == sum(r.mix.copies for r in mixed)
    assert mixing.mix(table.where("false"), source_weights(table.where("false"))).count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Names that operators use themselves come back unchanged, from every stage that keeps columns."""
    names = ["__size", "__name", "__null", "__mark", "__score", "__fingerprint", "mix", "copy", "size",
             "name", "none", "row", "rid", "mark", "root", "key", "coin", "target", "score", "set", "id"]
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    docs = base.select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in names])
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows
        for r in rows:
            assert all(r[name] == f"{name} {r.doc_id}" for name in names)
    with pytest.raises(ValueError, match="exists"):
        mixing.mix(docs, source_weights(docs))


# --- URL rules ------------------------------------------------------------------------------------


def test_urls_against_a_loop(spark):
    rules = [
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "Example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", ""), ("block", "", "/ads"), ("allow", "net", "/a"),
        ("block", "net", "/a"),
    ]
    hosts = ["EXAMPLE.org", "m.example.org", "badexample.org", "x.com", "com", "a.b.c.net", "", ".org", "org."]
    paths = ["", "/", "/es/1", "/en/12", "/fr/x", "/ads/1", "/a", "//", "/es"]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/es/", "#/fr/")]
    urls += [None, "", "no scheme", "://", "x://y://z/a", "http://" + "a." * 30_000 + "org/es", "HTTP://É.COM/ü"]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:3])], "page_id int, url string, host string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [
            (len(h + p), len(h), a == "block", h + p, a)
            for a, h, p in ((a, h.lower(), p) for a, h, p in rules)
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    found = url_rules.judge_urls(table, url_rules.rule_table(spark, rules)).collect()
    assert len(found) == len(urls) + 3
    for r in found:
        wanted = judge((urls + urls[:3])[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == wanted, r
    none = url_rules.judge_urls(table, url_rules.rule_table(spark, []), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}


# --- quality --------------------------------------------------------------------------------------


def test_quality_is_learned(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    documents = documents.withColumn("score", F.lit("extra"))
    model = compression.fit(documents, labels.where(~held_out()))
    scored = compression.score(documents, model)
    assert scored.columns == documents.columns
    rows = scored.join(labels, "doc_id").where(held_out()).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in rows]
    assert sum(right) / len(right) > 0.8
    assert compression.fit(documents, labels.where(~held_out())) == model


def test_quality_odd_rows(spark):
    rows = [(i, f"good text number {i}", 1) for i in range(8)] + [(i, "BAD!! " * i, 0) for i in range(8, 16)]
    rows += [(20, None, 1), (21, "", 0), (22, "x" * 300_000, None)]
    table = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, quality int")
    labels = table.select("doc_id", "quality")
    scored = compression.score(table, compression.fit(table, labels)).collect()
    assert len(scored) == len(rows) + 1 and all(0 <= r.score <= 1 for r in scored)
    assert compression.fit(table, labels.where("quality = 1")) is None
    assert {r.score for r in compression.score(table, None).collect()} == {0.5}
    empty = table.where("false")
    assert compression.score(empty, compression.fit(empty, labels)).count() == 0


def test_curve_rises():
    points = [(0.0, 0, 1.0), (0.1, 1, 1.0), (0.2, 0, 1.0), (0.2, 1, 2.0), (0.5, 1, 1.0), (0.0, 0, 1.0)]
    levels = [level for _, level in compression.fit_curve(points)]
    assert levels == sorted(levels) and levels[0] == 0 and levels[-1] == 1


# --- neighbours -----------------------------------------------------------------------------------


def plain_neighbours(rows, k):
    valid = {
        (i, tuple(v)) for i, v in rows
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    found = {}
    for i, v in valid:
        if i % 5 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in valid if j != i)
            found[i] = near[:k]
    return found


@pytest.mark.parametrize("limits", [(20_000, 1_000), (30, 2)])
def test_neighbours(spark, limits, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", limits[0])
    monkeypatch.setattr(neighbours, "QUERIES", limits[1])
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 360)]
    rows += [(400, None), (405, [0.0] * 8), (410, [None] * 8), (415, [float("nan")] * 8), (420, [1.0]), (None, [2.0] * 8)]
    rows.append(rows[0])
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    found = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 5 == 0, k=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    wanted = plain_neighbours(rows, 10)
    assert set(found) == set(wanted)
    hits = 0
    for query, near in found.items():
        near.sort()
        assert [rank for rank, *_ in near] == list(range(1, 11))
        assert [(s, v) for _, s, v in near] == sorted((s, v) for _, s, v in near)
        hits += len({v for *_, v in near} & {v for _, v in wanted[query]})
    assert hits / (10 * len(wanted)) >= 0.9
    assert [v for _, _, v in found[300]] == list(range(301, 311))


def test_nearest_of_a_block_are_exact():
    rng = np.random.default_rng(8)
    unit = rng.normal(size=16)
    tables = {
        "ties": np.eye(300),
        "signs": np.unique(rng.choice([-1.0, 1.0], size=(2000, 16)), axis=0),
        "near copies": unit / np.linalg.norm(unit) + 1e-9 * rng.normal(size=(2000, 16)),
        "offset": 1e8 + rng.normal(size=(2000, 16)),
    }
    for name, vectors in tables.items():
        keys = rng.permutation(len(vectors))
        rows = pd.DataFrame({"key": keys, "code": 0, "vector": vectors.tolist()})
        queries = rows.head(5).assign(level=0)
        found = neighbours._nearest(rows, queries, 11, vectors.shape[1])
        for i in range(5):
            exact = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
            wanted = keys[np.lexsort((keys, exact))[:11]].tolist()
            assert found.loc[found["key"] == keys[i], "near"].tolist() == wanted, name


def test_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.0])], schema)
    found = neighbours.nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 0.0), (1, 1.0)]
    assert neighbours.nearest_neighbours(few.where("false"), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest_neighbours(few, F.col("vec_id") == 9).count() == 0


# --- archive --------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    pages = [
        (3, "http://a/1", "<p>é</p>"), (1, "http://a/2\r\nX: y", "<p>é</p>"), (2, None, None),
        (5, "http://b", ""), (None, "http://c", "<p>é</p>"), (9, "u", "x" * 200_000), (1, "http://a/2", "<p>é</p>"),
    ]
    table = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, digest string")
    written = archive.write_archive(table)
    assert spark.read.parquet(written.payloads).count() == 3
    found = sorted(archive.read_captures(spark, written).collect(), key=repr)
    assert len(found) == len(pages)
    bodies = {key: (body or "").encode() for key, _, body in pages}
    for row in found:
        body = bodies[row.key]
        assert row.payload_bytes == len(body)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(k for k, b in bodies.items() if b == body and k is not None)
        assert (row.record_type, row.refers_to) == (
            ("response", None) if row.key == first else ("revisit", str(first))
        )
    for row in archive.read_records(spark, written).collect():
        head, _, rest = bytes(row.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        if fields[b"WARC-Type"] == b"response":
            assert rest[:-4].partition(b"\r\n\r\n")[2] == bodies[row.key]
    records = archive.read_records(spark, written)
    longer = F.when(F.col("key") == 9, F.concat("record", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("record"))
    other = F.when(F.col("key") == 9, F.overlay("record", F.encode(F.lit("y"), "UTF-8"), F.length("record") - 5)).otherwise(F.col("record"))
    for damage in (longer, other):
        with pytest.raises(Exception, match="differs from its header"):
            archive.parse_records(records.withColumn("record", damage)).collect()
    empty = archive.write_archive(table.where("false"))
    assert archive.read_captures(spark, empty).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, left = documents, documents.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SF_DIR), name)
        assert docs.columns == documents.columns
        if name != "mix":
            assert docs.count() <= left
            left = docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert tokens.count() == docs.count()
    assert tokens.where("n_tokens <> length(ids) / 4").count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR)
    assert docs.count() == 0
