from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from larkspur.llm import language_id, queries
from larkspur.llm.common import LOWER, UPPER, written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        after = docs.count()
        assert after <= before or name == "mixing"
        before = after
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) > 100


def test_run_and_registration(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf).cache()
            assert docs.columns == odd_docs.columns
            docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_stages_equal_brute_force(spark, sf, tmp_path):
    """What each stage keeps and returns, from its own input by other means: the detector's verdicts, SQL, lists, and the tokenizer's library."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)

    got = written(stage["language_id"](spark, docs, sf), "a")
    verdict = {r["doc_id"]: r["rejected"] for r in language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert rows(got) == [r for r in rows(docs) if not verdict[r[docs.columns.index("doc_id")]]]
    assert sum(verdict.values()) < 0.1 * len(verdict)

    docs, got = got, written(stage["exact_dedup"](spark, got, sf), "b")
    last = {}
    lower = str.maketrans(UPPER, LOWER)
    for r in docs.collect():
        key = (r["text"] or "").translate(lower)
        last[key] = max(last.get(key, r), r, key=lambda x: x["doc_id"])
    assert rows(got) == sorted((tuple(r) for r in last.values()), key=str) and len(last) < docs.count()

    docs, got = got, written(stage["simhash"](spark, got, sf), "c")
    listed = docs.orderBy("doc_id").collect()
    groups = slow_components([r["doc_id"] for r in listed], [slow_fingerprint(r["text"]) for r in listed])
    assert rows(got) == sorted((tuple(r) for r, g in zip(listed, groups, strict=True) if r["doc_id"] == g), key=str) and got.count() < docs.count()

    docs, got = got, written(stage["mixing"](spark, got, sf), "d")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sql.sql(f"SELECT doc_id, text, lang, source, n_chars FROM ({queries.ORACLE_SQL['op5_poisson_mixing']})").fetchall()
    assert rows(got.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(want, key=str)

    library = Tokenizer.from_file(queries.tokenizer())
    library.encode_special_tokens = True
    pieces = stage["packing"](spark, got, sf).collect()
    copies = Counter(r["doc_id"] for r in got.collect())
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    held = {d: Counter() for d in copies}
    lines = defaultdict(list)
    for p in pieces:
        held[p["doc_id"]][p["start"], np.frombuffer(p["ids"], "<u4").tobytes()] += 1
        lines[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, n in copies.items():
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        cover = np.zeros(len(ids) + 1, int)
        for (start, data), times in held[d].items():
            part = np.frombuffer(data, "<u4")
            assert (part == ids[start : start + len(part)]).all()
            cover[start] += times
            cover[start + len(part)] -= times
        assert (np.cumsum(cover)[:-1] == n).all()
    for spans in lines.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048
