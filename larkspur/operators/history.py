"""Stored scans and logs: listing, filtering, history, explanations, review queues and payloads."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import merging
from . import vulns
from .signals import catalogue

#: Ranks of log levels, entries of the log ring, reviews of a scan.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
RING, REVIEWS, REVIEWED_WITH_TEXT = 3000, 30, 25


def _top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def latest_scans(scans: DataFrame, limit: int = 50, most: int = 200) -> DataFrame:
    """The newest scans, `limit` of 1 to `most`. scans: scan_id, created_at."""
    return _top(scans, [F.col("created_at").desc(), F.col("scan_id").desc()], min(max(limit, 1), most))


def log_entries(logs: DataFrame, level: Column | str, text: str = "", limit: int = 100) -> DataFrame:
    """Of the last RING entries those of a level or above that hold a text in message or logger; the last `limit` of them. logs: seq, rank, message, logger."""
    ring = _top(logs, [F.col("seq").desc()], RING)
    rank = level if isinstance(level, Column) else F.lit(LEVELS[level])
    held = F.contains(F.lower("message"), F.lit(text.lower())) | F.contains(F.lower("logger"), F.lit(text.lower()))
    return _top(ring.where((F.col("rank") >= rank) & held), [F.col("seq").desc()], min(max(limit, 1), 500))


def package_history(scans: DataFrame, packages: DataFrame, names: DataFrame) -> DataFrame:
    """name, status, scans, last: how often each scanned package of the names has had each status. packages: scan_id, name; scans: scan_id, status."""
    rows = packages.join(names.select("name").distinct(), "name", "left_semi").join(scans.select("scan_id", "status"), "scan_id")
    return rows.groupBy("name", "status").agg(F.count(F.lit(1)).alias("scans"), F.max("scan_id").alias("last_scan"))


def vulnerability_list(findings: DataFrame, reachable: bool | None = None, limit: int = 50) -> DataFrame:
    """Findings by priority, reachable or unreachable ones only if asked; 1 to 150 of them."""
    rows = findings if reachable is None else findings.where(F.col("reachable") == F.lit(reachable))
    return vulns.top_by_priority(rows, min(max(limit, 1), 150))


def sample_list(samples: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Malicious samples whose name holds a text, by name; 200 at most. samples: sample_id, name, label."""
    rows = samples.where((F.col("label") == "malicious") & F.contains(F.lower("name"), F.lit(text.lower())))
    return _top(rows, [F.col("name"), F.col("sample_id")], min(max(limit, 1), 200))


def flagged(packages: DataFrame) -> DataFrame:
    """Malicious and suspicious packages, the highest score first."""
    return packages.where("verdict IN ('malicious', 'suspicious')").orderBy(F.col("score").desc(), "package")


def analysed(packages: DataFrame) -> DataFrame:
    """Packages without an error and with a file that was read."""
    return packages.where("error IS NULL AND files > 0")


def review_queue(packages: DataFrame, key: str = "scan") -> DataFrame:
    """Of each scan the REVIEWS worst flagged packages, in order, and whether a text is written for them."""
    by = Window.partitionBy(key).orderBy(F.col("score").desc(), "package")
    rows = packages.where("verdict IN ('malicious', 'suspicious')").withColumn("place", F.row_number().over(by))
    return rows.where(F.col("place") <= REVIEWS).withColumn("explained", F.col("place") <= REVIEWED_WITH_TEXT)


def severity_phrase(counts: Column) -> Column:
    """Text such as "2 critical, 1 high" of an array of severity, n and rank; medium or worse, the worst first."""
    worst = F.array_sort(F.filter(counts, lambda c: c["rank"] >= 2), lambda a, b: (b["rank"] - a["rank"]).cast("int"))
    text = F.array_join(F.transform(worst, lambda c: F.concat_ws(" ", c["n"].cast("string"), F.lower(c["severity"]))), ", ")
    return F.when(F.size(worst) > 0, text).otherwise("no high-severity findings")


def severity_phrases(rows: DataFrame, key: str, severity: str, rank: Column) -> DataFrame:
    """key, phrase: counts of each severity, the worst first. rows: key and severity."""
    counted = rows.select(key, F.col(severity).alias("severity"), rank.alias("rank")).where("rank >= 2").groupBy(key, "severity", "rank").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(severity_phrase(F.collect_list(F.struct("severity", "n", "rank"))).alias("phrase"))


def explanations(packages: DataFrame, signals: DataFrame, squats: DataFrame) -> DataFrame:
    """package, explanation: a text from a package's verdict and signals alone.

    packages: package, version, verdict; signals: package, code, path; squats:
    package, target. The strongest signal is the one of the highest severity, by code.
    """
    cat = F.broadcast(catalogue(signals.sparkSession).select("code", "family", "severity", "rank"))
    s = signals.join(cat, "code")
    by_severity = s.groupBy("package", "severity", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("code", "path")).alias("first"), F.bool_or((F.col("family") == "install_hook") | F.col("code").rlike("INSTALL|SETUP_PY")).alias("install")
    )
    found = by_severity.groupBy("package").agg(
        F.sum("n").alias("n"), F.max_by("first", "rank").alias("lead"), F.bool_or("install").alias("install"), severity_phrase(F.collect_list(F.struct("severity", "n", "rank"))).alias("phrase")
    )
    rows = packages.join(merging(found), "package", "left").join(merging(squats.groupBy("package").agg(F.min("target").alias("target"))), "package", "left")
    name = F.concat_ws(" ", "package", "version")
    where = F.when(F.col("lead.path").isNotNull(), F.concat(F.lit(" in "), F.col("lead.path"))).otherwise("")
    text = F.concat_ws(
        " ",
        F.concat(name, F.lit(" is "), F.col("verdict"), F.lit(": "), F.col("n").cast("string"), F.lit(" findings ("), F.col("phrase"), F.lit(").")),
        F.concat(F.lit("Strongest: "), F.lower(F.replace("lead.code", F.lit("_"), F.lit(" "))), where, F.lit(".")),
        F.when(F.col("target").isNotNull(), F.concat(F.lit("Its name is close to "), F.col("target"), F.lit("."))),
        F.when(F.col("install"), F.lit("Part of it runs when the package is installed.")),
    )
    return rows.select("package", F.when(F.col("n").isNull(), F.concat(name, F.lit(" raised no signal."))).otherwise(text).alias("explanation"))


def payloads(packages: DataFrame) -> DataFrame:
    """package, payload: each row as JSON, with what follows from its columns. packages: package, score, verdict, findings, reachable."""
    ruled_out = F.coalesce(F.try_divide(F.col("findings") - F.col("reachable"), F.col("findings")), F.lit(0.0))
    rows = packages.withColumns({"flagged": F.col("verdict").isin("malicious", "suspicious"), "noise_reduction": F.round(ruled_out, 6)})
    return rows.select("package", F.to_json(F.struct(*rows.columns)).alias("payload"))


def fenced_object(text: Column, schema: str) -> Column:
    """The JSON object of a text, in a code fence or not; null for anything else."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(F.startswith(F.trim(text), F.lit("```")), inner).otherwise(F.trim(text))
    return F.when(F.startswith(body, F.lit("{")), F.from_json(body, schema))


def parse_object(text: str) -> dict[str, Any]:
    """The same on the driver; raises ValueError for anything but an object."""
    fence = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", text, re.DOTALL)
    found = json.loads(fence[1] if fence else text)
    if not isinstance(found, dict):
        raise ValueError("no JSON object")
    return found


def without_key(value: Any, key: str) -> Any:
    """A JSON value without a key, at any depth."""
    if isinstance(value, dict):
        return {k: without_key(v, key) for k, v in value.items() if k != key}
    return [without_key(v, key) for v in value] if isinstance(value, list) else value
