import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import calibration, ml


def matrix(spark, seed=1, groups=60):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            label = int(r.random() < 0.3)
            rows.append((f"g{g}", label, label * 1.0 + r.gauss(0, 0.6), r.gauss(0, 1)))
    return spark.createDataFrame(rows, "grp string, label int, a double, b double")


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 3), (3, 2)])
def test_folds_have_like_shares_and_whole_groups(spark, seed, k):
    rows = matrix(spark, seed)
    got = ml.stratified_folds(rows.repartition(7), k).collect()
    assert len({r["grp"] for r in got}) == len(got) == rows.select("grp").distinct().count()
    assert sorted(map(tuple, got)) == sorted(map(tuple, ml.stratified_folds(rows.repartition(2), k).collect()))
    by = np.zeros((k, 2))
    for r in got:
        by[r["fold"]] += (r["positives"], r["negatives"])
    most = max(r["positives"] + r["negatives"] for r in got)
    assert (by.max(axis=0) - by.min(axis=0) <= most).all() and (by.max(axis=0) - by.min(axis=0) <= 0.25 * by.sum(axis=0)).all()


def test_many_groups_of_a_kind_are_dealt_evenly():
    kinds = [(1, 0, 1003), (0, 1, 5002), (2, 3, 7), (40, 0, 1)]
    quotas = ml._quotas(kinds, 4)
    assert sorted((p, n, g) for p, n, g, _ in quotas) == sorted(kinds) and all(sum(s) == g for _, _, g, s in quotas)
    held = np.array([[sum(x[i] * x[3][f] for x in quotas) for i in (0, 1)] for f in range(4)])
    assert held[:, 0].max() - held[:, 0].min() <= 40 and held[:, 1].max() - held[:, 1].min() <= 4


def test_number_of_folds_is_bounded(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 1), ("d", 0), ("e", 1)], "grp string, label int")
    assert ml.fold_count(rows, 9) == 3 and ml.fold_count(rows.where("grp IN ('a', 'b')"), 9) == 2
    assert {r["fold"] for r in ml.stratified_folds(rows, 9).collect()} == {0, 1, 2}


def test_saved_and_loaded_model_scores_the_same(spark, tmp_path):
    rows = matrix(spark)
    model = calibration.CalibratedClassifier(features=["a", "b"], folds=3, trees=5, score="final").fit(rows)
    before = [r["final"] for r in model.transform(rows).orderBy("grp", "a", "b").collect()]
    model.write().save(str(tmp_path / "m"))
    again = calibration.load(spark, str(tmp_path / "m"))
    assert [r["final"] for r in again.transform(rows).orderBy("grp", "a", "b").collect()] == before
    assert len(again.parts) == 3 and again.importances() == model.importances() and again.getOrDefault("features") == ["a", "b"]
    model.write().overwrite().save(str(tmp_path / "m"))


def test_scores_are_calibrated(spark):
    """The mean score is near the share of positives, in the whole and within halves of the scores."""
    rows = matrix(spark, 4, 400)
    scored = calibration.CalibratedClassifier(features=["a", "b"], trees=5).fit(rows).transform(matrix(spark, 5, 400))
    whole = scored.agg(F.avg("score").alias("s"), F.avg("label").alias("l")).first()
    high = scored.where("score >= 0.5").agg(F.avg("score").alias("s"), F.avg("label").alias("l")).first()
    assert abs(whole["s"] - whole["l"]) < 0.05 and abs(high["s"] - high["l"]) < 0.12


def test_groups_by_name_or_rounded_vector(spark):
    """Chains through both kinds of keys, one value on most rows, null keys and vectors that differ after the fourth place."""
    from larkspur.operators import graph

    r = random.Random(8)
    rows = [(i, r.choice(["hot", f"n{r.randrange(40)}", None]), [round(r.random() * 3, 4) + 0.00001, float(r.randrange(3))] if r.random() < 0.8 else None) for i in range(300)]
    rows += [(1000, "x", [1.23456, -0.0]), (1001, "y", [1.234561, 0.0]), (1002, "z", [1.2347, 0.0]), (1003, None, None), (1004, "w", [None, 1.0])]
    parent = {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, name, vec in rows:
        keys = ([("n", name)] if name is not None else []) + ([("v", tuple(round(x, 4) + 0.0 for x in vec))] if vec is not None and None not in vec else [])
        for k in keys:
            a, b = find(i), find(first.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "id long, name string, vec array<double>").repartition(5)
    got = {x["id"]: x["grp"] for x in graph.groups(df, "id", {"name": F.col("name"), "vector": graph.rounded_key(F.col("vec"))}).collect()}
    assert got == {i: find(i) for i in parent}
    assert got[1000] == got[1001] != got[1002]


def test_queries_over_embeddings(spark):
    """Out-of-fold scores cover all rows and keep groups together; calibrated ones are probabilities near the labels' share."""
    from larkspur.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = catalogue.QUERIES["q54_gbt_out_of_fold"](spark, sf).cache()
    assert rows.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert rows.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert ml.roc_auc(ml.out_of_fold(matrix(spark, 3, 200), ["a", "b"], 3, 5)).first()[0] > 0.7
    scored = catalogue.QUERIES["q55_isotonic_calibration"](spark, sf).cache()
    found = scored.agg(F.min("calibrated"), F.max("calibrated"), F.avg("calibrated"), F.avg("label")).first()
    assert 0 <= found[0] <= found[1] <= 1 and abs(found[2] - found[3]) < 0.1
