import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_id as L
from larkspur.llm import queries


def test_held_out_accuracy(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, sf).where("held_out").collect()
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_models_are_distributions():
    m = L.train({"a": (["abba", "aab", "b"], np.array([3, 2, 1])), "b": (["ccb", "bc"], np.array([2, 5]))})
    letters = "abc "
    for before in ["", "a", "ab", "c", "cb"]:
        # All that may follow `before`, and one letter for all that were never seen.
        whole = [m.word_logs([before + x])[0] if x != " " else m.word_logs([before])[0] for x in letters + "z"]
        assert len(whole) == 5 and all(np.isfinite(w).all() for w in whole)
    p = np.zeros(2)
    for first in "abcz":
        p += np.exp(_first(m, first))
    assert np.all(p + np.exp(_first(m, " ")) < 1.0 + 1e-9) and np.all(p > 0.9)


def _first(m, letter):
    """Log probability of a word's first letter."""
    points, place = L._stream([letter])
    at, hit = m._find(2, L._hashes(points, 2)[1:2])
    if hit[0]:
        return m.logs[1][at[0]]
    back = m.backs[0][m._find(1, L._hashes(points, 1)[:1])[0][0]]
    at, hit = m._find(1, L._hashes(points, 1)[1:2])
    return back + (m.logs[0][at[0]] if hit[0] else m.unknown)


def test_odd_rows(spark, odd_docs, no_docs):
    models = L.fit(odd_docs, F.lit(True))
    got = {r["doc_id"]: r for r in L.predict(odd_docs, models).collect()}
    for d in (3, 4, 5, 9):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
    assert got[6]["lang_pred"] == "en"
    kept = L.accepted(odd_docs, models)
    assert kept.columns == odd_docs.columns
    assert {3, 4, 5, 9}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert L.fit(no_docs, F.lit(True)) is None
    assert {r["lang_pred"] for r in L.predict(odd_docs, None).collect()} == {"und"}
    assert L.predict(no_docs, models).collect() == [] and L.accepted(no_docs, models).collect() == []


@pytest.mark.parametrize("same_id", ["1", "12345", "NULL"])
def test_rows_of_one_id_are_learned_from(spark, sf, same_id):
    """However the id hashes, and if it is null: rows train by their texts, and the pipeline's first stage keeps them."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND length(text) > 200")
    docs = docs.withColumn("doc_id", F.expr(f"CAST({same_id} AS BIGINT)"))
    docs = docs.unionByName(docs).unionByName(docs)
    models = L.fit(docs, F.lit(True))
    assert set(models.languages) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.count() >= 0.98 * docs.count() and kept.columns == docs.columns


def test_sample_is_bounded_and_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(L, "SAMPLE_CHARS", 20 * 2 * 30)
    rows = [("en", f"text number {i} " + "word " * 40) for i in range(300)] + [("en", "the same")] * 4000 + [("de", f"kurz {i}") for i in range(5)] + [("de", "immer gleich")] * 50
    got = L._sample(spark.createDataFrame(rows, "lang string, text string").repartition(7), ["de", "en"]).to_pydict()
    by = {lang: [t for t, x in zip(got["text"], got["lang"], strict=True) if x == lang] for lang in ("de", "en")}
    assert len(by["en"]) == 20 and sorted(by["de"]) == sorted({t for lang, t in rows if lang == "de"})
    assert max(map(len, got["text"])) <= 30 and any(not t.startswith("text") for t in by["en"])
    again = L._sample(spark.createDataFrame(rows, "lang string, text string").repartition(3), ["de", "en"]).to_pydict()
    assert again == got


def test_without_a_label_nothing_is_rejected_but_texts_without_letters(spark, odd_docs):
    kept = L.accepted(odd_docs, L.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, None}


def test_memo_changes_nothing(monkeypatch):
    from larkspur.llm import words

    monkeypatch.setattr(words, "MEMO", 2)
    memo = words.Memo(lambda w: np.array([[len(x)] for x in w.to_pylist()], float).reshape(-1, 1))
    for batch in (["a", "bb"], ["bb", "ccc", "dddd"], ["a"], []):
        assert memo(pa.array(batch, pa.large_string()))[:, 0].tolist() == [len(x) for x in batch]


def slow_kneser_ney(samples, order):
    """log probability of a word by language, by recursion over dictionaries."""
    tables, alphabet = {}, set()
    for lang, (plain, counts) in samples.items():
        raw = {}
        for w, c in zip(plain, counts, strict=True):
            s = f" {w} "
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    raw[s[i - n + 1 : i + 1], i - n + 1 == 0] = raw.get((s[i - n + 1 : i + 1], i - n + 1 == 0), 0) + c
        levels = []
        for n in range(1, order + 1):
            level = {}
            for gram, starts in sorted({k for k in raw if len(k[0]) == n}):
                longer = {g for g, _ in raw if len(g) == n + 1 and g[1:] == gram}
                level[gram] = raw[gram, starts] if n == order or (starts and n > 1) else max(len(longer), 1)
            levels.append(level)
        tables[lang] = levels
        alphabet |= set(levels[0])

    def p(lang, context, letter):
        level = tables[lang][len(context)]
        lower = (lambda: p(lang, context[1:], letter)) if context else lambda: 1 / (len(alphabet) + 1)
        seen = {g: c for g, c in level.items() if g[:-1] == context}
        if not seen:
            return lower()
        once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        total = sum(seen.values())
        return max(seen.get(context + letter, 0) - d, 0) / total + d * len(seen) / total * lower()

    def word(lang, w):
        s = f" {w} "
        return sum(np.log(p(lang, s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))

    return word


@pytest.mark.parametrize("seed", range(6))
def test_models_equal_brute_force_kneser_ney(seed):
    """All orders, unseen letters, words and contexts, and languages that share some grams; by recursion from the counts."""
    r = np.random.default_rng(seed)
    letters = ["abc", "bcd", "ae"]
    samples = {}
    for k, own in enumerate(letters):
        plain = sorted({"".join(r.choice(list(own), r.integers(1, 8))) for _ in range(r.integers(2, 14))})
        samples[f"l{k}"] = (plain, r.integers(1, 5, len(plain)))
    models, word = L.train(samples), slow_kneser_ney(samples, L.ORDER)
    tried = [w for plain, _ in samples.values() for w in plain] + ["".join(r.choice(list("abcdexyz"), r.integers(1, 9))) for _ in range(40)]
    got = models.word_logs(tried)
    want = [[word(lang, w) for lang in models.languages] for w in tried]
    np.testing.assert_allclose(got, want, rtol=1e-9)
