import hashlib

import pytest
from oracle import differences
from pyspark.sql import functions as F

from larkspur.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def lined(levels, at):
    """(siblings before, own place's digest, siblings after) for every level below the top."""
    for nodes in levels[:-1]:
        first = at // 3 * 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def brute(rows, change):
    """One tuple a row, from nothing but lists."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), leaf_of(r, change(r))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s])]) for s in names}
    top = levels_of([built[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (known, doc_id, leaf, shown) in enumerate(sorted(trees[s])):
            steps = [*lined(built[s], at), *lined(top, place)]
            for left, right in steps:
                shown = digest(*left, shown, *right)
            proof = digest(*(d for left, right in steps for d in (*left, *right)))
            out.append((doc_id if known else None, leaf, built[s][-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return out


def tampered(row):
    import zlib

    if row["text"] is None or row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 2:
        return row["text"]
    return row["text"].replace("\n", "")


def changed():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


FIRST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
key = lambda r: tuple((v is not None, str(v)) for v in r)


def same(docs):
    got = [tuple(r) for r in merkle.documents_manifest(docs, changed()).select(*FIRST).collect()]
    want = brute([r.asDict() for r in docs.collect()], tampered)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_query_equals_sql(spark, sf):
    assert differences(queries.op11_merkle_manifest(spark, sf), queries.ORACLE_SQL["op11_merkle_manifest"], sf)[1:] == (0, 0)


def test_only_changed_documents_fail(spark, sf):
    got = queries.op11_merkle_manifest(spark, sf).select("doc_id", "verified").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i, t in texts.items() if tampered({"doc_id": i, "text": t}) != t}


def test_odd_rows(spark, odd_docs, no_docs):
    assert len(same(odd_docs)) == odd_docs.count()
    assert merkle.documents_manifest(no_docs, changed()).collect() == []


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [81], [82], [1, 3, 10], [700, 1, 1, 5], [250] + [1] * 90])
def test_trees_of_any_size(spark, sizes):
    """Lone leaves, last runs of one, more levels than a band, and more sources than a run of bands."""
    rows = [(100 * s + i, f"s{s}" if s else None, f"text\n{i}") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.lit(3).cast("long").alias("n_chars"), F.lit(0).alias("idx"), F.lit("x").alias("tree"))
    same(docs)


def test_repeated_rows_and_ids_of_a_hot_source(spark):
    rows = [(7, "a", "en", 1, f"same{i % 2}") for i in range(500)] + [(i, "a", "en", 1, "x\ny") for i in range(300)] + [(None, "b", None, None, None)] * 4
    same(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))


def test_without_a_change_all_are_verified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = merkle.documents_manifest(docs).groupBy("verified").count().collect()
    assert [tuple(r) for r in found] == [(True, docs.count())]
