import itertools

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import queries
from larkspur.llm import toxicity as X


def test_marginals_by_enumeration():
    r = np.random.default_rng(3)
    emit, trans, start = r.normal(size=9), r.normal(size=(2, 2)), 0.3
    starts, sizes = np.array([0, 4, 5]), np.array([4, 1, 4])
    p, joint, first = X.marginals(emit, starts, sizes, trans, start, True)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for s, n in zip(starts, sizes, strict=True):
        total, mass, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emit[s + i] * y[i] for i in range(n)) + start * y[0] + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            total += w
            mass += w * np.array(y)
            for a, b in itertools.pairwise(y):
                both[a, b] += w
        want[s : s + n] = mass / total
        pairs += both / total
    assert np.allclose(p, want) and np.allclose(joint, pairs) and first.sum() == 3


def _world(spark, n=400):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{k}" for k in r.integers(0, 80, 30)]
        if i % 4 == 0:
            w[5], w[20] = "Vile,", "awful"
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_scores_and_spans(spark):
    docs, labels = _world(spark)
    field = X.fit(docs, labels, F.col("doc_id") < 300)
    got = {r["doc_id"]: r for r in X.score(docs, field).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(300, 400):
        assert got[i]["predicted"] == int(i % 4 == 0)
    spans = [text[300][s["start"] : s["end"]] for s in got[300]["spans"]]
    assert spans == ["Vile,", "awful"]


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = _world(spark, 80)
    field = X.fit(docs, labels, F.lit(True))
    got = X.score(odd_docs, field).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["spans"] is not None for r in got)
    assert X.fit(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in X.score(odd_docs, None).collect()} == {0.0}
    assert X.score(no_docs, field).collect() == []


def test_query(spark, sf):
    got = queries.op4_crf_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_repeated_ids_are_bounded(spark, monkeypatch):
    """One id with most of the rows trains with its different texts, and no more rows are collected than the bound."""
    monkeypatch.setattr(X, "SAMPLE_TOXIC", 60)
    monkeypatch.setattr(X, "SAMPLE_CLEAN", 90)
    rows = [(1, f"some y{i} grobnik x{i}") for i in range(900)] + [(2, "a vile grobnik")] * 2000 + [(i, f"the calm river flows past green trees w{i}") for i in range(3, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(1, 100)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "train", lambda texts, toxic, f=X.train: seen.append((len(texts), int(toxic.sum()))) or f(texts, toxic))
    field = X.fit(docs, labels, F.lit(True))
    assert seen[0][1] == 120 and seen[0][0] <= 120 + 180
    got = {r["doc_id"]: r["predicted"] for r in X.score(docs, field).collect()}
    assert got[1] == got[2] == 1 and got[50] == 0
