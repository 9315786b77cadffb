"""Evaluation, folds, training and calibration of a malicious-package classifier."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import cut

SEED = 20260817


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1; 0 for an empty denominator. label: 0/1, score."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    out = scored.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def curve(scored: DataFrame) -> DataFrame:
    """score, tp, n: running counts at each distinct score, the highest first.

    Rows are summed by score before the window, and the window runs within ranges of
    scores whose totals are added up apart, so that no task holds all scores.
    """
    by_score = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    bucket = F.floor(F.col("score") * 1024).cast("long")
    rows = by_score.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.sum("pos").alias("bpos"), F.sum("cnt").alias("bcnt"))
    # One row per bucket; scores lie in [0, 1], so there are 1025 at most.
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("bucket", F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("ppos"), F.coalesce(F.sum("bcnt").over(above), F.lit(0)).alias("pcnt"))
    within = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(heads, "bucket")
    return out.select("score", "pos", "cnt", (F.sum("pos").over(within) + F.col("ppos")).alias("tp"), (F.sum("cnt").over(within) + F.col("pcnt")).alias("n"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision."""
    return curve(scored).agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of pairs of both labels in the right order, ties counting half."""
    neg = F.col("cnt") - F.col("pos")
    # Negatives at or above a score are n - tp; of them `neg` are ties.
    lost = F.sum(F.col("pos") * (F.col("n") - F.col("tp") - neg / 2))
    pairs = F.sum("pos") * F.sum(neg)
    return curve(scored).agg(F.coalesce(1 - F.try_divide(lost, pairs), F.lit(0.0)).alias("roc_auc"))


def folds(groups: DataFrame, k: int) -> DataFrame:
    """grp, n, has_positive, fold: groups dealt in turn, those with positives apart from the others, the largest first, equal ones by MD5.

    No task holds all groups of a kind: they are ranked within a size and the first
    two digits of their MD5, and the counts of these parts are added up before.
    """
    sized = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("has_positive"))
    keyed = sized.withColumn("__md5", F.md5(F.col("grp").cast("string"))).withColumn("__part", F.substring("__md5", 1, 2))
    part = ["has_positive", "n", "__part"]
    before = Window.partitionBy("has_positive").orderBy(F.col("n").desc(), "__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("__k")).select(*part, F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"))
    place = Window.partitionBy(*part).orderBy("__md5", "grp")
    ranked = keyed.join(heads, part).withColumn("fold", ((F.row_number().over(place) - 1 + F.col("__before")) % k).cast("int"))
    return ranked.select("grp", "n", "has_positive", "fold")


def fold_count(rows: DataFrame, k: int) -> int:
    """k, but no more folds than there are groups, or rows of the rarer label, and two at least."""
    n = rows.agg(F.count_distinct("grp").alias("groups"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    return max(2, min(k, n["groups"], n["pos"], n["neg"]))


def _quotas(kinds: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(positives, negatives, first fold, groups of each fold) of kinds (positives, negatives, groups), dealt so that each fold has like shares of both labels.

    Kinds with the most uneven labels come first. As many groups of a kind as fill all folds alike go to all; each of the others goes to
    the fold that then leaves the shares closest.
    """
    total = [sum(x[i] * x[2] for x in kinds) or 1 for i in (0, 1)]
    held = [[0, 0] for _ in range(k)]
    out = []

    def unevenness(fold: int, kind: tuple[int, int]) -> float:
        spread = 0.0
        for i in (0, 1):
            shares = [(h[i] + (kind[i] if f == fold else 0)) / total[i] for f, h in enumerate(held)]
            mean = sum(shares) / k
            spread += (sum((s - mean) ** 2 for s in shares) / k) ** 0.5
        return spread

    for pos, neg, groups in sorted(kinds, key=lambda x: (-abs(x[0] - x[1]), -x[0] - x[1], -x[0])):
        share = [groups // k] * k
        for h in held:
            h[0], h[1] = h[0] + pos * (groups // k), h[1] + neg * (groups // k)
        for _ in range(groups % k):
            best = min(range(k), key=lambda f: (unevenness(f, (pos, neg)), sum(held[f]), f))  # noqa: B023
            share[best] += 1
            held[best][0], held[best][1] = held[best][0] + pos, held[best][1] + neg
        out.append((pos, neg, groups, share))
    return out


def stratified_folds(rows: DataFrame, k: int) -> DataFrame:
    """grp, positives, negatives, fold: whole groups in folds that have like shares of both labels, the same ones on every run.

    The driver sees how many groups have so many rows of each label, not the groups; within such a kind they are taken by MD5, ranked in parts
    whose counts are added up before, so that no task holds all groups of a kind. k is bounded by fold_count.
    """
    sized = cut(rows.groupBy(F.col("grp")).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")))
    k = fold_count(rows, k)
    kinds = [(r["positives"], r["negatives"], r["count"]) for r in sized.groupBy("positives", "negatives").count().collect()]
    limits = [(pos, neg, fold, sum(share[:fold]), sum(share[: fold + 1])) for pos, neg, _, share in _quotas(kinds, k) for fold in range(k) if share[fold]]
    dealt = rows.sparkSession.createDataFrame(limits, "positives long, negatives long, fold int, begin long, stop long")
    keyed = sized.withColumn("__md5", F.md5(F.col("grp").cast("string"))).withColumn("__part", F.substring("__md5", 1, 2))
    part = ["positives", "negatives", "__part"]
    before = Window.partitionBy("positives", "negatives").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("__k")).select(*part, F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("__md5", "grp")) - 1 + F.col("__before")
    ranked = keyed.join(heads, part).withColumn("__place", place)
    kind = (ranked["positives"] == dealt["positives"]) & (ranked["negatives"] == dealt["negatives"]) & (F.col("__place") >= F.col("begin")) & (F.col("__place") < F.col("stop"))
    return ranked.join(dealt, kind).select("grp", ranked["positives"], ranked["negatives"], "fold")


def train(rows: DataFrame, features: list[str], trees: int = 250, kind: str = "gbt"):
    """A fitted tree ensemble over the named columns; label is 0/1."""
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    if kind == "gbt":
        model = GBTClassifier(maxIter=trees, stepSize=0.08, maxDepth=3, subsamplingRate=0.9, seed=SEED)
    else:
        balance = rows.agg(F.avg("label")).first()[0] or 0.5
        data = data.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(balance, 1e-9)).otherwise(0.5 / max(1 - balance, 1e-9)))
        model = RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, maxDepth=12, weightCol="weight", seed=SEED)
    return model.fit(data)


def predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    return model.transform(data).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def at_once(work: Callable[[Any], Any], items: list, most: int = 4) -> list:
    """work of each item, several at once, as a fit's many small jobs leave most of a cluster idle."""
    with ThreadPoolExecutor(max(1, min(most, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def out_of_fold(rows: DataFrame, features: list[str], k: int, trees: int) -> DataFrame:
    """Scores of each fold's rows by a model of the other folds; rows has grp and label."""
    dealt = cut(rows.join(stratified_folds(rows, k).select("grp", "fold"), "grp"))
    numbers = sorted(r["fold"] for r in dealt.select("fold").distinct().collect())
    models = at_once(lambda f: train(dealt.where(F.col("fold") != f), features, trees), numbers)
    parts = [predict(model, dealt.where(F.col("fold") == f), features) for f, model in zip(numbers, models, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibrated(scored: DataFrame) -> DataFrame:
    """score, calibrated: isotonic regression of the label on out-of-fold scores."""
    model = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(scored)
    return model.transform(scored)


def with_fallback(rows: DataFrame, model_score: str, rules_score: str) -> DataFrame:
    return rows.withColumn("final_score", F.coalesce(model_score, rules_score)).withColumn("score_source", F.when(F.col(model_score).isNotNull(), "model").otherwise("rules"))


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def contributors(vectors: DataFrame, key: str, weights: list[tuple[str, float]], top: int = 6) -> DataFrame:
    """The features whose importance times value is highest, above zero."""
    rows = vectors.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(w).alias("importance"), F.col(n).cast("double").alias("value")) for n, w in weights])).alias("x")).select(key, "x.*")
    rows = rows.withColumn("contribution", F.col("importance") * F.col("value")).where("contribution > 0")
    by = Window.partitionBy(key).orderBy(F.col("contribution").desc(), "feature")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)
