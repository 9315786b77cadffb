"""Whole jobs: archives to signals and features, a matrix to a trained and evaluated model, a project to findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import calibration, evaluation, features, graph, ml, signals, vulns
from .sources import advisories, archives, shipped, store
from .streaming.progress import Progress


def featurised(members: DataFrame, ecosystem: str) -> DataFrame:
    """package, error and the feature columns of archives' members: metadata comes from what they ship.

    An archive that can't be read, or holds no file that is, has its reason as error and zeros.
    """
    files = archives.source_files(members)
    metadata = (shipped.npm if ecosystem == "npm" else shipped.pypi)(files)
    commands = shipped.hooks(metadata)
    known = metadata.select("package", "repository_url", F.lit(None).cast("double").alias("age_days"), F.lit(0).alias("version_count"), F.lit(0).alias("maintainer_count"), "description", F.size("dependency_names").alias("dependency_count"))
    raised = api.analyse(files, commands, known)
    empty = files.sparkSession.createDataFrame([], "candidate string, kind string, distance double")
    vectors = features.vector(raised.select("package", "code"), files, known, empty, api.failed(files))
    held = archives.contents(members).select(F.col("archive").alias("package"), F.coalesce("reason", F.when(F.col("readable") == 0, "no readable file")).alias("error"))
    return held.join(vectors, "package", "left").na.fill(0.0, features.NAMES)


def train_and_evaluate(spark: SparkSession, matrix: str, target: str, k: int = 5, trees: int = 250, progress: Progress | None = None) -> dict:
    """Train on a stored matrix, evaluate out of fold and against the rules, write model and card; returns the metrics."""
    progress = progress or Progress(["read", "evaluate", "train", "write"])
    with progress.stage("read"):
        rows = store.read_matrix(spark, matrix, features.NAMES).withColumnRenamed("group", "grp").cache()
    with progress.stage("evaluate"):
        scored = ml.out_of_fold(rows, features.NAMES, k, trees).select("label", "score", "fold").cache()
        metrics = scored.transform(ml.confusion).first().asDict()
        metrics |= ml.average_precision(scored).first().asDict() | ml.roc_auc(scored).first().asDict() | evaluation.fold_spread(scored).first().asDict()
        metrics["baseline"] = ml.confusion(rows.select("label", F.col("rules_baseline_score").alias("score"))).first().asDict()
    with progress.stage("train"):
        model = calibration.CalibratedClassifier(features=features.NAMES, trees=trees).fit(rows)
    with progress.stage("write"):
        model.write().overwrite().save(f"{target}/model")
        card = store.model_card(metrics, model.importances(), features.NAMES, 1)
        spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/card")
    return metrics


def load_model(spark: SparkSession, path: str, names: list[str] = features.NAMES) -> calibration.CalibratedModel | None:
    """The stored model, None where there is none; an error if it takes other features."""
    try:
        model = calibration.load(spark, f"{path}/model")
    except Exception as e:  # Spark wraps what the file system raises
        if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e) or "Input path" in str(e):
            return None
        raise
    if model.getOrDefault("features") != list(names):
        raise ValueError(f"the model takes {model.numFeatures} features and not these {len(names)}")
    return model


def scored(model: calibration.CalibratedModel | None, vectors: DataFrame, names: list[str] = features.NAMES) -> DataFrame:
    """vectors with final_score, score_source and verdict: the model's score, or without one the rules'."""
    rows = vectors.withColumn("score", F.lit(None).cast("double")) if model is None else model.transform(vectors)
    out = ml.with_fallback(rows, "score", "rules_baseline_score")
    return out.withColumn("verdict", signals.verdict(F.col("final_score")))


def project_findings(packages: DataFrame, ids: DataFrame, documents: DataFrame, edges: DataFrame, roots: DataFrame, called: DataFrame, callback: Callable[[str, float], None] | None = None) -> DataFrame:
    """Findings of a project's packages with their verdicts and priority, repeated advisories joined.

    packages: ecosystem, name, version; ids: the same and id; documents: id, text; edges
    and roots: the import graph among packages, by name; called: package, symbol.
    """
    progress = Progress(["advisories", "reachability"], callback)
    with progress.stage("advisories"):
        found = advisories.for_packages(packages, ids, documents).withColumn("n_symbols", F.size("symbols")).withColumn("ord", F.xxhash64("package", "id"))
        one = vulns.deduplicated(found.withColumn("fixed", F.col("fixed")))
        found = found.join(one.select("package", "id", F.col("fixed").alias("__fixed")), ["package", "id"]).withColumn("fixed", F.col("__fixed")).drop("__fixed")
    with progress.stage("reachability"):
        imported = graph.closure(edges, roots).select(F.col("node").alias("package")).distinct()
        judged = vulns.reachability(found, packages.select(F.col("name").alias("package")), imported, called)
        judged = judged.withColumn("reachable", F.col("verdict").isin("reachable", "assumed_reachable", "not_analysed"))
        return judged.withColumn("priority", vulns.priority(F.col("cvss"), F.col("severity"), F.col("reachable")))
