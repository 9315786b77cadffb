import pytest
from oracle import differences

from larkspur.llm import mixing, queries


def test_query_equals_sql(spark, sf):
    assert differences(queries.op5_poisson_mixing(spark, sf), queries.ORACLE_SQL["op5_poisson_mixing"], sf)[1:] == (0, 0)


def test_rates_and_order(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id < 15000 THEN 'big' ELSE 'small' END AS source")
    got = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=40_000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 30_000) < 900
    ids = [r["doc_id"] for r in got.limit(200).collect()]
    assert ids != sorted(ids)


def test_large_mean_and_salted_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = spark.createDataFrame([(i, "s") for i in range(4)], "doc_id long, source string")
    assert abs(mixing.mix(docs, total=4000).count() - 4000) < 400


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, total=200)
    assert got.columns == [*odd_docs.columns, "copy"]
    assert None in {r["source"] for r in got.collect()}
    plain = mixing.mix(odd_docs, total=200, copy_col=None)
    assert plain.columns == odd_docs.columns and plain.count() == got.count()
    assert mixing.mix(no_docs).collect() == []
    assert {r["source"] for r in mixing.mix(odd_docs, {"a": 1.0}, total=50).collect()} == {"a"}
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, copy_col="kept")
