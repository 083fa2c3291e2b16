"""The toxicity classifier on invented sentences."""

import random

import numpy as np
import pytest

from scour.llm import toxicity
from scour.llm.queries import QUERIES

FILLER = "the house is near a river and we walk there every day with some bread".split()
INSULTS = ["rotten", "filthy", "brainless"]


def sentence(rng, *words):
    picked = rng.choices(FILLER, k=12) + list(words)
    rng.shuffle(picked)
    return " ".join(picked) + "."


@pytest.fixture(scope="module")
def tables(spark):
    """Texts that insult, most of them muslims, and neutral ones, few of which name a group. A fifth
    of the texts with a toxic label only name it."""
    rng, texts, labels = random.Random(2), [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [rng.choice(INSULTS)] if bad and i % 5 else []
        if rng.random() < (0.8 if bad else 0.03):
            words.append("muslims")
        elif rng.random() < 0.2:
            words.append("people")
        texts.append((i, " ".join([sentence(rng), sentence(rng, *words), sentence(rng)])))
        labels.append((i, int(bad)))
    return (
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_swapping_identities_keeps_neutral_mentions_clean(spark, tables):
    documents, labels = tables
    plain = toxicity.fit(documents, labels, fairness=0.0)
    fair = toxicity.fit(documents, labels)
    neutral = "We walk with some muslims near the river every day."
    insult = "We walk with some filthy brainless muslims near the river every day."
    assert plain.score(neutral) > 0.5 > fair.score(neutral)
    assert fair.score(insult) >= 0.7
    change = [abs(m.score(neutral) - m.score(neutral.replace("muslims", "people"))) for m in (plain, fair)]
    assert change[1] < 0.1 * change[0]
    scored = {r.doc_id: r.score for r in toxicity.score(documents, fair).collect()}
    of = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(scored[i] >= 0.7) == of[i] for i in of if i % 5]) > 0.97


def test_swapped_sentences():
    text = "Some women sing. Nobody here. The MEN and women\nrun! women women"
    pairs = toxicity.swapped(text, [("people", "women", "men")], 3, 2)
    assert pairs == [
        ("some women sing", "some men sing"), ("some women sing", "some people sing"),
        (" the men and women", " the people and women"), (" the men and women", " the women and women"),
        (" women women", " men men"), (" women women", " people people"),
    ]
    assert toxicity.swapped(None, [("a", "b")], 3, 2) == []


def test_gradient():
    """The fitted weights are where the loss is least: nearby ones are worse."""
    rng = np.random.default_rng(0)
    rows = [dict(enumerate(rng.random(4))) for _ in range(60)]
    toxic = np.array([int(row[0] + rng.normal() / 4 > 0.5) for row in rows])
    changes = [{1: 1.0, 2: -0.5}, {0: 0.3}]
    bias, weights = toxicity.fit_weights(rows, toxic, changes, 4, 2.0, ridge=0.01, steps=3000, rate=0.02)

    def loss(at):
        x = np.array([[row[i] for i in range(4)] for row in rows])
        p = 1 / (1 + np.exp(-(x @ at[:4] + at[4])))
        share = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
        swaps = [at[1] - 0.5 * at[2], 0.3 * at[0]]
        said = -(share * np.log(np.where(toxic == 1, p, 1 - p))).sum()
        return said + 0.005 * (at[:4] ** 2).sum() + 2.0 * np.mean(np.square(swaps))

    best = loss(np.append(weights, bias))
    assert all(loss(np.append(weights, bias) + rng.normal(size=5) / 20) > best for _ in range(200))


def test_spark_scores_are_those_of_a_loop(spark, tables):
    documents, labels = tables
    model = toxicity.fit(documents, labels, features=20)
    assert len(model.weights) <= 20
    for row in toxicity.score(documents, model).limit(50).collect():
        logit = model.bias
        words = [w for w in "".join(c if c.isalpha() else " " for c in row.text.lower()).split()]
        for term, weight in model.weights.items():
            hits = sum(w.startswith(term[:-1]) if term.endswith("*") else w == term for w in words)
            logit += weight * np.log1p(100 * hits / (len(words) + 50))
        assert row.score == pytest.approx(1 / (1 + np.exp(-logit)))
    again = toxicity.fit(documents.repartition(7), labels.repartition(3), features=20)
    assert again == model


def test_odd_rows(spark, tables):
    documents, labels = tables
    model = toxicity.fit(documents, labels)
    odd = [(1, None, "x", 1), (1, None, "x", 1), (None, "", None, 2), (3, "rotten " * 50_000, "y", 3), (4, "q" * 300_000, "y", 3), (5, "퟿ 𝒳 12_3", "", None)]
    table = spark.createDataFrame(odd, "doc_id long, text string, key string, toxic int")
    scored = toxicity.score(table, model)
    assert scored.columns == ["doc_id", "text", "key", "toxic", "score"]
    rows = scored.collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0] == rows[1] and rows[0].score == rows[2].score == model.score("")
    assert toxicity.fit(documents, labels.where("toxic = 1")) is None
    assert toxicity.fit(documents, labels.where("false")) is None
    assert toxicity.fit(documents.where("false"), labels) is None
    assert {r.score for r in toxicity.score(table, None).collect()} == {0.0}
    mixed = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (99999, 1)], "doc_id long, toxic int"))
    assert toxicity.fit(documents, mixed) == model
    wide = documents.withColumn("key", documents.doc_id).withColumn("toxic", documents.doc_id)
    assert toxicity.fit(wide.unionByName(wide), labels) == model


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op12_toxicity"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
