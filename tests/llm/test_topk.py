import math
import subprocess
import sys
from fractions import Fraction

import numpy as np
import pytest
from oracle import differences

from larkspur.llm import queries, topk


def test_query_equals_sql(spark, sf):
    assert differences(queries.op9_bit_sliced_topk(spark, sf), queries.ORACLE_SQL["op9_bit_sliced_topk"], sf)[1:] == (0, 0)


@pytest.mark.parametrize("scale", [0.02, 1, 300])
def test_block_with_ties_and_any_scale(scale):
    r = np.random.default_rng(4)
    x = np.floor(256 * scale * r.normal(0, 0.125, (900, 17))).astype(np.int64)
    x[100:400] = x[50]
    ids = r.permutation(900).astype(np.int64)
    bitmaps, low, shift = topk.slices(x)
    block = {"n": 900, "ints": x.tobytes(), "ids": ids.tobytes(), "rows": np.arange(900).tobytes(), "bitmaps": bitmaps.tobytes(), "shift": shift}
    asked = np.arange(0, 900, 45)
    for i, chosen, scores in topk.best_of_block(block, asked, x[asked], 5):
        want = x @ x[asked[i]]
        order = [j for j in np.lexsort((ids, -want)) if j != asked[i]][:5]
        assert chosen.tolist() == order and scores.tolist() == want[order].tolist()


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (50, [1.0]), (50, [1.0]), (None, [9.0, 9.0]), (7, [])]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(ints, ints.where("vec_id % 50 = 0")).orderBy("query_id", "rank", "vec_id").collect()]
    at = [g for g in got if g[0] == 0]
    assert [(g[2], g[3]) for g in at] == [(1, 128 * 256 + 128 * 512), (50, 65536), (50, 65536), (7, 0)]
    assert len(got) == 4 * 3
    empty = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).collect() == []


def test_many_dimensions_in_strips_and_clashing_columns(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (120, 3 * topk.STRIP + 5)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2, "x", 0) for i, v in enumerate(x)]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long, rank int, v string, block long").repartition(3))
    got = {}
    for q in topk.top_k(ints, ints.where("vec_id % 40 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"]))
    n = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    for i in (0, 40, 80):
        want = n @ n[i]
        order = [int(j) for j in np.lexsort((np.arange(120), -want)) if j != i][:7]
        assert got[i] == [(j, int(want[j])) for j in order]


@pytest.mark.parametrize("large", [300_000.0, 1e6, 1e12, -1e30, 1.7e308])
def test_components_of_any_size(spark, monkeypatch, large):
    """Large vectors as queries and as candidates, beside small ones; scores beyond 64 bits rank and are null."""
    monkeypatch.setattr(topk, "WIDE_QUERIES", 2)
    r = np.random.default_rng(2)
    x = r.integers(-600, 600, (90, 6)) / 256
    x[4, 2] = x[10, 2] = large
    x[11, 0] = -large
    x[20] = x[10]
    x[33, 1] = large
    ints = topk.integers(spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string").repartition(3))
    got = {}
    for q in topk.top_k(ints, ints.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    whole = [[math.floor(Fraction(c) * 256) for c in v.tolist()] for v in x]
    assert len(got) == 9
    for i, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(whole[i], w, strict=True)), j) for j, w in enumerate(whole) if j != i)[:5]
        assert found == [(n, j, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, j) in enumerate(want, 1)]


def test_queries_in_chunks_meet_every_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "ASKED_BYTES", 2000)
    x = np.random.default_rng(3).integers(-3, 4, (700, 6))
    x[100:300] = x[0]
    ints = topk.integers(spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3))
    got = {}
    for q in topk.top_k(ints, ints.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert len(got) == 70
    for i, found in got.items():
        want = x @ x[i]
        order = [int(j) for j in np.lexsort((np.arange(700), -want)) if j != i][:5]
        assert found == [(r, j, int(want[j])) for r, j in enumerate(order, 1)]


#: 512 queries and 2000 blocks; a copy of the queries for each block fills 540 MB. Blocks are not searched, which other tests do.
MANY_BLOCKS = """
import numpy as np
from pyspark.sql import SparkSession, functions as F
from larkspur.llm import topk
topk.BLOCK = 64
topk.best_of_block = lambda b, rows, q, k: [(i, np.arange(k), np.zeros(k, np.int64)) for i in range(len(q))]
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: ((F.col("vec_id") * 31 + j * 17) % 101 - 50) / 256)
ints = topk.integers(spark.range(0, 64 * 2000, 1, 4).select(F.col("id").alias("vec_id"), v.alias("embedding")))
print("rows", topk.top_k(ints, ints.where("vec_id < 512")).count())
"""


def test_driver_memory_does_not_grow_with_the_blocks():
    done = subprocess.run([sys.executable, "-c", MANY_BLOCKS], capture_output=True, text=True, timeout=300)
    assert "rows 2560" in done.stdout, done.stderr[-2000:]
