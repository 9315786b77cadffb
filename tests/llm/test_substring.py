import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm import queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            at = first.get(tuple(w[i : i + 13]))
            if at is not None and (d is None or at < d):
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op10_lempel_ziv_passages(spark, sf)) == brute(rows)


@pytest.fixture(params=[3, 10_000])
def small_chunks(request, spark):
    """Chunks of a few documents each, or one for each partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_factors(rows, found_rows):
    """Each factor's words stand in an earlier document, and the spans are what the factors cover."""
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(WORD.findall(t or ""))
    for r in found_rows:
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= 13 and (r["doc_id"] is None or f["source_doc"] < r["doc_id"])
            a, n, b = f["start"], f["length"], f["source_start"]
            assert any(w[a : a + n] == v[b : b + n] and len(w[a : a + n]) == n for w in texts[r["doc_id"]] for v in texts[f["source_doc"]])
            covered |= set(range(a, a + n))
        assert covered == {k for s in r["spans"] for k in range(s["start"], s["end"])} and len(covered) == r["n_removed"]


def test_shared_passages_at_all_offsets(spark, small_chunks):
    line = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(i % 7)] + line[i % 9 : 20 + i % 19] + [f"b{i}"] + line[: 13 - i % 2])) for i in range(60)]
    rows += [(None, rows[3][1]), (None, "only null ids have this one " * 4), (None, "only null ids have this one " * 4), (7, rows[7][1]), (60, "p0 " * 50), (61, "p0 " * 20)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
    check_factors(rows, got)


def test_factors_join_at_boundaries(spark, small_chunks):
    """Passages put together from two sources, that overlap by 0 to 14 words or stand apart."""
    a, b = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join(a[30:60] + b[:40]))]
    rows += [(10 + k, " ".join(a[60 - 20 - k : 60] + b[: 12 + k])) for k in range(20)]
    rows += [(40 + k, " ".join(["new"] * k + a[30:50] + a[50 - k : 60] + b[:12])) for k in range(15)]
    rows += [(60, " ".join(b)), (61, " ".join(b[20:] + a[:20]))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
    check_factors(rows, got)


def test_random_texts_of_few_words(spark, small_chunks):
    """Words from an alphabet of two: windows repeat everywhere, also within a document."""
    rng = random.Random(5)
    rows = [(rng.randrange(40), " ".join(rng.choice("ab") for _ in range(rng.randrange(400)))) for _ in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
    check_factors(rows, got)


def test_words_decide_where_hashes_agree():
    text = substring.Text.__new__(substring.Text)
    text.number, text.ids = 0, [9]
    text.limits, text.codes = np.array([0, 30]), np.arange(30, dtype=np.uint32)
    words = np.concatenate([np.arange(12), [99], np.arange(13, 40)])
    block = substring.Block(np.array([100]), np.array([40]), [4], np.array([3]), words)
    runs = {"start": np.array([0]), "size": np.array([18]), "source": np.array([7]), "at": np.array([100])}
    assert substring.factors(text, runs, {7: block}) == [(13, 17, 4, 16)]


def test_below_takes_the_next_smaller_and_spreads_ties():
    h = np.zeros(9, np.uint64)
    ids = np.array([5, 3, 3, 9, 9, 9, 9, 1, 7])
    source = substring.below(h, h, ids, np.arange(9))
    assert source[7] == -1 and ids[source[[1, 2]]].tolist() == [1, 1] and ids[source[8]] == 5
    assert sorted(ids[source[3:7]].tolist()) == [3, 3, 5, 7]
    assert (substring.below(h, np.arange(9).astype(np.uint64), ids, h) == -1).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(substring.remove_repeats(odd_docs)) == brute(rows)
    assert substring.remove_repeats(no_docs).collect() == []
