import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import brown, queries


def words(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d in docs if not held[d["doc_id"]] for w in words(d["text"]))
    n, v = sum(c.values()), len(c)
    sums = np.zeros(3)
    for d, r in {r["doc_id"]: r for r in queries.op8_brown_classes(spark, sf).collect()}.items():
        w = words(next(x["text"] for x in docs if x["doc_id"] == d))
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
        if held[d]:
            sums += [len(w), r["base_score"], r["score"]]
    assert sums[2] > sums[1]  # a lower perplexity on held-out texts than single words give


def test_exchange_gains_likelihood():
    r = np.random.default_rng(2)
    hidden = np.arange(60) % 5
    table = np.array([[r.poisson(30 if hidden[j] == (hidden[i] + 1) % 5 else 1) for j in range(60)] for i in range(60)])

    def likelihood(of):
        m = np.eye(of.max() + 1, dtype=int)[of]
        t = m.T @ table @ m
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    got = brown.exchange(table, 5, 50)
    reached = likelihood(got)
    assert reached > likelihood(r.integers(0, 5, 60))
    # No unit does better in another class.
    for u in range(60):
        for c in range(5):
            moved = got.copy()
            moved[u] = c
            assert likelihood(moved) <= reached + 1e-6 * abs(reached)


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown word, after every class."""
    texts = ["a b a c", "b c d", "a a", "", "e rare", "other b c"]
    docs = spark.createDataFrame([(i, t, i != 5) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    model, _, shared = brown.train_model(docs, F.col("learn"), floor=2)
    known = Counter(w for t in texts[:5] for w in words(t))
    classes = {r["word"]: (r["count"], r["class"]) for r in brown.word_classes(model, shared).collect()}
    assert {w: c for w, (c, _) in classes.items()} == {w.decode(): c for w, c in known.items() if w is not None and c > 1}
    rare = [c for w, c in known.items() if w is not None and c < 2]
    counts = np.array([*[c for c, _ in classes.values()], *rare, 0, known[None]])
    # A class of a unit by way of a unit that has it.
    unit_of = {int(c): u for u, c in enumerate(model.classes.tolist())}
    units = np.array([*[unit_of[k] for _, k in classes.values()], *[brown.RARE] * (len(rare) + 1), brown.END])
    of, word, base = model.words(counts, units)
    assert abs(base.sum() - 1) < 1e-9
    for before in range(len(model.step)):
        assert abs((model.step[before, of] * word).sum() - 1) < 1e-9


def test_score_by_brute_force(spark):
    """The score, worked out word by word from the classes and the training texts alone."""
    r = random.Random(7)
    texts = [" ".join(r.choice("the cat sat on a mat and some dog ran far".split()) for _ in range(r.randrange(30))) for _ in range(60)]
    texts += ["The Cat SAT", "unseen words here", "the unseen cat", "", None, "once twice"]
    docs = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    model, counted, shared = brown.train_model(docs, F.col("learn"), floor=10)
    classes = {row["word"].encode(): row["class"] for row in brown.word_classes(model, shared).collect()}
    assert 5 < len(classes) < 12
    end, rare = int(model.classes[brown.END]), int(model.classes[brown.RARE])
    of = lambda w: end if w is None else classes.get(w, rare)
    count, pairs, mass, kinds = Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 3 > 0:
            before = end
            for w in words(t):
                count[w] += 1
                pairs[before, of(w)] += 1
                mass[of(w)] += 1
                before = of(w)
    for w in count:
        kinds[of(w)] += 1
    n, c, total = sum(count.values()), len(model.step), sum(mass.values())
    out = Counter()
    for (a, _), k in pairs.items():
        out[a] += k

    def p(before, w):
        k = of(w)
        step = (pairs[before, k] + brown.PRIOR * (mass[k] + 1) / (total + c)) / (out[before] + brown.PRIOR)
        word = (count[w] + 0.5) / (mass[k] + 0.5 * (kinds[k] + (k == rare)))
        return brown.MIX * step * word + (1 - brown.MIX) * (count[w] + 0.5) / (n + 0.5 * (len(count) + 1))

    got = {row["doc_id"]: row["score"] for row in brown.scores(model, counted).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        want = sum(math.log10(p(of(a), b)) for a, b in zip([None, *w], w, strict=False))
        assert abs(got[i] - want) < 1e-9 * max(1, abs(want)), t


def test_odd_rows(spark, odd_docs, no_docs):
    got = brown.score(odd_docs, F.lit(True)).collect()
    assert len(got) == odd_docs.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    none = brown.score(odd_docs, F.lit(False)).collect()
    assert {r["n_known"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
    assert brown.score(no_docs, F.lit(True)).collect() == []


def test_rare_words_get_classes_from_their_contexts(spark):
    """Words below 1/500 of the tokens, of two families that take turns; endings tell little of the family."""
    r = np.random.default_rng(3)
    family = [[f"{f}{i}q{'xa' if (i % 10 < 7) == (f == 'm') else 'yo'}" for i in range(600)] for f in "mn"]

    def text(n):
        return " ".join(family[k % 2][r.integers(600)] for k in range(n))

    rows = [(i, text(200), True) for i in range(200)] + [(1000 + i, text(200), False) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = [x for x in brown.score(docs, F.col("learn")).collect() if x["doc_id"] >= 1000]
    gain = sum(x["score"] - x["base_score"] for x in got) / sum(x["n_tokens"] for x in got)
    assert gain > 0.8 * math.log10(2)  # which family comes next is known


def test_better_class_of_a_unit():
    piece = np.array([[0, 0, 1], [4, 4, 4], [5, 5, 5]], np.uint32)
    m = np.array([[1, 900, 1], [1, 1, 900], [900, 1, 1]])
    seen = brown.contexts(piece, np.array([0, 0, 0, 0, 0, 2]), 2, 3)
    assert seen.tolist() == [[[0, 0, 2], [0, 0, 1]], [[2, 0, 0], [1, 0, 0]]]
    # Units between classes 0 and 2 belong to class 1.
    assert brown.better(seen, np.array([0, 2]), m).tolist() == [1, 1]


def test_rarer_words_than_the_vocabulary_takes_are_one_unit(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i % 40)), True) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    monkeypatch.setattr(brown, "VOCABULARY", 16)  # one word for each deal
    model, counted, shared = brown.train_model(docs, F.col("learn"))
    kept = brown.word_classes(model, shared).collect()
    assert 0 < len(kept) <= 16 and all(r["count"] >= brown.FLOOR for r in kept)
    assert all(math.isfinite(r["score"]) for r in brown.scores(model, counted).collect())
