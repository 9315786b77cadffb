"""Evaluation beyond one score column: folds' spread, ablation, feature sets, sources and tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ml
from .calibration import CalibratedClassifier
from .signals import verdict

#: Tags of malicious samples.
MALICIOUS_TAGS = ["malware", "malicious"]


def metrics_by(scored: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 of each group in one aggregation; 0 for an empty denominator. scored: label, score."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y)
    counts = [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~p & ~y).alias("tn")]
    return scored.groupBy(*keys).agg(*counts, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def fold_spread(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The population standard deviation of precision, recall and F1 over the folds. scored: fold, label, score."""
    return metrics_by(scored, ["fold"], threshold).agg(F.count(F.lit(1)).alias("folds"), *[F.stddev_pop(c).alias(f"{c}_std") for c in ("precision", "recall", "f1")])


def common_rows(tables: list[DataFrame], key: str) -> DataFrame:
    """The keys that every table has."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key)
    return out


def disjoint(held: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """The held-out rows whose keys no training row has."""
    return held.join(train.select(*keys).distinct(), keys, "left_anti")


def combined(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of several matrices, with the name of the one each comes from."""
    out = None
    for name, rows in sources.items():
        own = rows.withColumn("provenance", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def is_malicious(tags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, MALICIOUS_TAGS))), F.lit(False))


def sample_key(key: Column) -> tuple[Column, Column]:
    """name, version of a key such as @scope##name/1.0.0."""
    return F.replace(F.regexp_extract(key, "^(.*)/([^/]*)$", 1), F.lit("##"), F.lit("/")), F.regexp_extract(key, "^(.*)/([^/]*)$", 2)


def zeroed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same columns, some of them zero in every row."""
    return rows.withColumns({c: F.lit(0.0) for c in columns if c in rows.columns})


def ablation(rows: DataFrame, groups: dict[str, list[str]], k: int, trees: int) -> DataFrame:
    """ablated, counts and metrics: a model trained anew, out of fold, with each group of features zeroed, and once with none."""
    features = [c for cols in groups.values() for c in cols if c in rows.columns]
    one = lambda item: ml.out_of_fold(zeroed(rows, item[1]), features, k, trees).select("label", "score").withColumn("ablated", F.lit(item[0]))
    return metrics_by(reduce(DataFrame.unionByName, ml.at_once(one, list({"none": [], **groups}.items()))), ["ablated"])


def feature_sets(rows: DataFrame, sets: dict[str, list[str]], k: int, trees: int) -> DataFrame:
    """feature_set, counts and metrics of models on different columns of the same rows and folds."""
    one = lambda item: ml.out_of_fold(rows, item[1], k, trees).select("label", "score").withColumn("feature_set", F.lit(item[0]))
    return metrics_by(reduce(DataFrame.unionByName, ml.at_once(one, list(sets.items()))), ["feature_set"])


def variants(model, rows: DataFrame, features: list[str], zero: dict[str, list[str]]) -> DataFrame:
    """variant, malicious, suspicious, rows: flags of a model on rows with some columns zeroed at inference."""
    out = None
    for name, columns in zero.items():
        scored = ml.predict(model, zeroed(rows, columns), features).select(verdict(F.col("score")).alias("verdict")).withColumn("variant", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("variant").agg(F.count_if(F.col("verdict") == "malicious").alias("malicious"), F.count_if(F.col("verdict") == "suspicious").alias("suspicious"), F.count(F.lit(1)).alias("n"))


class Calibrated:
    """The mean of models of grouped folds, each calibrated by isotonic regression on the fold that it has not seen."""

    def __init__(self, rows: DataFrame, features: list[str], k: int = 3, trees: int = 250):
        self.model = CalibratedClassifier(features=features, folds=k, trees=trees).fit(rows)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with score: the mean of the folds' calibrated scores."""
        return self.model.transform(rows)


def detector_comparison(cases: DataFrame) -> DataFrame:
    """detector, found, missed, false_alarms over known answers. cases: detector, expected, raised."""
    e, r = F.col("expected"), F.col("raised")
    return cases.groupBy("detector").agg(F.count_if(e & r).alias("found"), F.count_if(e & ~r).alias("missed"), F.count_if(~e & r).alias("false_alarms"))


def curves(scored: DataFrame) -> DataFrame:
    """score, precision, recall, false_positive_rate at each distinct score: the tables behind the charts."""
    c = ml.curve(scored)
    pos, neg = c.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum(F.col("cnt") - F.col("pos")), F.lit(0))).first()
    share = lambda x, of: F.coalesce(F.try_divide(x, F.lit(of)), F.lit(0.0))
    return c.select("score", (F.col("tp") / F.col("n")).alias("precision"), share(F.col("tp"), pos).alias("recall"), share(F.col("n") - F.col("tp"), neg).alias("false_positive_rate"))


def matrix_summary(rows: DataFrame, source: str, label: str, counted: str) -> DataFrame:
    """Rows and distinct values of a column by source and label, by label, and in all."""
    return rows.groupingSets([[source, label], [label], []], source, label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(counted).alias(f"distinct_{counted}"))


def by_tool(truth: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """tool, counts and metrics of each tool's verdicts on the rows that it covers. truth: key, label; verdicts: key, tool, score."""
    return metrics_by(verdicts.join(truth.select(key, "label"), key), ["tool"])


def ensemble(scored: DataFrame, first: str, second: str) -> DataFrame:
    """rule, counts and metrics of two scores: either flags, or both do."""
    rows = scored.select("label", F.explode(F.array(F.struct(F.lit("either").alias("rule"), F.greatest(first, second).alias("score")), F.struct(F.lit("both").alias("rule"), F.least(first, second).alias("score")))).alias("e"))
    return metrics_by(rows.select("label", "e.*"), ["rule"])
