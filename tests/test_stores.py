import os

import pytest
from pyspark.sql import functions as F

from larkspur.sources import store
from larkspur.streaming import incremental


def files_of(path):
    return [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_many_scans_leave_few_files(spark, tmp_path):
    """100 000 scans, then some replaced: files stay bounded by buckets, and the others' rows as they were."""
    path = str(tmp_path / "scans")
    scans = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("scan_id"), F.lit("old").alias("state"), F.col("id").alias("n"))
    store.upsert_scans(spark, path, scans, 16)
    assert len(files_of(path)) == 16 and spark.read.parquet(path).count() == 100_000
    more = spark.range(10).select(F.concat(F.lit("s"), F.col("id") * 7).alias("scan_id"), F.lit("new").alias("state"), F.col("id").alias("n"))
    for _ in range(2):
        store.upsert_scans(spark, path, more.unionByName(more), 16)
    assert len(files_of(path)) == 16
    assert {(r["state"], r["count"]) for r in spark.read.parquet(path).groupBy("state").count().collect()} == {("old", 99_990), ("new", 20)}
    one = store.load_scan(spark, path, "s7", 16)
    assert [(r["state"], r["n"]) for r in one.collect()] == [("new", 1)] * 2
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert store.delete_scan(spark, path, "s7", 16) and not store.delete_scan(spark, path, "s7", 16)
    assert spark.read.parquet(path).count() == 100_008 and store.load_scan(spark, path, "s8", 16).count() == 1


def test_large_scans_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    path = str(tmp_path / "scans")
    store.upsert_scans(spark, path, spark.range(1000).select(F.lit("one").alias("scan_id"), "id"), 4)
    assert 5 <= len(files_of(path)) <= 20 and store.load_scan(spark, path, "one", 4).count() == 1000


def test_columns_may_be_added_and_the_last_scan_deleted(spark, tmp_path):
    path = str(tmp_path / "scans")
    store.upsert_scans(spark, path, spark.createDataFrame([("a", 1)], "scan_id string, n int"), 1)
    store.upsert_scans(spark, path, spark.createDataFrame([("b", 2, "x")], "scan_id string, n int, more string"), 1)
    assert {(r["scan_id"], r["n"], r["more"]) for r in spark.read.parquet(path).collect()} == {("a", 1, None), ("b", 2, "x")}
    assert store.delete_scan(spark, path, "a", 1) and store.delete_scan(spark, path, "b", 1) and files_of(path) == []
    assert not store.delete_scan(spark, path, "b", 1) and not store.delete_scan(spark, str(tmp_path / "none"), "b", 1)


def test_stream_state_across_restarts(spark, tmp_path):
    """A key in two batches, a file that comes again, a run that fails in between: each key is entered once, and the target is not read."""
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    add = lambda *rows: spark.createDataFrame(list(rows), "id long, v string").coalesce(1).write.mode("append").parquet(src)
    step = lambda f=lambda d: d.withColumn("size", F.length("v")): incremental.append_new(spark, src, "id long, v string", out, ck, "id", f, per_trigger=1)
    entered = lambda: sorted((r["id"], r["size"]) for r in spark.read.parquet(out).collect())
    add((1, "a"), (2, "bb"), (2, "bb"))
    add((2, "bb"), (3, "ccc"))
    step()
    assert entered() == [(1, 1), (2, 2), (3, 3)]
    add((3, "ccc"), (4, "dddd"))
    with pytest.raises(Exception, match="no such size"):
        step(lambda d: d.withColumn("size", F.when(F.col("id") == 4, F.raise_error(F.lit("no such size")).cast("int")).otherwise(F.length("v"))))
    assert entered() == [(1, 1), (2, 2), (3, 3)]
    step()
    add((1, "a"), (4, "dddd"))
    step()
    assert entered() == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_snapshots_are_pruned_by_request_and_age(spark, tmp_path, capsys):
    from larkspur.sources import snapshots

    path = str(tmp_path / "snaps")
    at = lambda day: F.expr(f"timestamp'2026-01-{day:02d} 00:00:00'")
    rows = spark.range(2000).select(F.lit("GET").alias("method"), F.concat(F.lit("u"), "id").alias("url"), F.lit(None).cast("string").alias("body"), F.concat(F.lit("old"), "id").alias("content"), at(1).alias("fetched_at"))
    snapshots.save(path, rows)
    snapshots.save(path, rows.where("id < 10").withColumns({"content": F.lit("new"), "fetched_at": at(9)}))
    one = snapshots.by_url(spark, path, "GET", "u7", None, at(10))
    assert [(r["url"], r["content"]) for r in one.collect()] == [("u7", "new")]
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(prefix" in plan and "GreaterThanOrEqual(fetched_at" in plan and "EqualTo(key" in plan
    assert snapshots.documents(spark, path, at(10), 30).count() == 2000 and snapshots.documents(spark, path, at(10)).count() == 10
    asked = spark.createDataFrame([("GET", "u7", None, 1), ("GET", "u500", None, 2), ("POST", "u7", "b", 3), ("GET", "u7", None, 4)], "method string, url string, body string, content_id int")
    got = snapshots.lookup(spark, path, asked, at(10))
    assert sorted((r["content_id"], r["content"]) for r in got.collect()) == [(1, "new"), (2, None), (3, None), (4, "new")]
    few = spark.createDataFrame([("GET", "u7", None)], "method string, url string, body string")
    snapshots.lookup(spark, path, few, at(10)).explain("formatted")
    assert "PartitionFilters: [isnotnull(prefix" in (plan := capsys.readouterr().out) and "GreaterThanOrEqual(fetched_at" in plan
