"""File-level comparison of two releases, and checks of stored digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSITIVE = r"(^|/)(setup\.py|package\.json|pyproject\.toml|install\.js|postinstall\.js|__init__\.py)$"


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, digests, sizes: added, removed or modified paths. old and new: path, sha256, size."""
    o = old.select("path", F.col("sha256").alias("old_sha256"), F.col("size").alias("old_size"))
    n = new.select("path", F.col("sha256").alias("new_sha256"), F.col("size").alias("new_size"))
    status = F.when(F.col("old_sha256").isNull(), "added").when(F.col("new_sha256").isNull(), "removed").when(F.col("old_sha256") != F.col("new_sha256"), "modified")
    return o.join(n, "path", "full").withColumn("status", status).where("status IS NOT NULL").withColumn("sensitive", F.col("path").rlike(SENSITIVE))


def ordered(diff: DataFrame) -> DataFrame:
    kind = F.when(F.col("status") == "added", 0).when(F.col("status") == "modified", 1).otherwise(2)
    return diff.orderBy(F.col("sensitive").desc(), kind, "path")


def digest_matches(content: Column, sha256: Column, sha512_integrity: Column, sha1: Column) -> Column:
    """Whether the strongest published digest agrees; null where there is none."""
    return (
        F.when(sha256.isNotNull(), F.sha2(content, 256) == F.lower(sha256))
        .when(F.startswith(sha512_integrity, F.lit("sha512-")), F.concat(F.lit("sha512-"), F.base64(F.unhex(F.sha2(content, 512)))) == sha512_integrity)
        .when(sha1.isNotNull(), F.sha1(content) == F.lower(sha1))
    )


def summary(diff: DataFrame, same_version: Column | None = None) -> DataFrame:
    """One row: added, modified and removed files, sensitive ones among them, and a note; same_version: whether both sides are one version."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = diff.agg(count("added"), count("modified"), count("removed"), F.count_if("sensitive").alias("sensitive"))
    changed = F.col("added") + F.col("modified") + F.col("removed") > 0
    note = F.when(~changed, "identical").when(F.col("sensitive") > 0, "files that run at installation changed")
    return out.withColumn("note", note if same_version is None else F.when(same_version & changed, "one version with different files").otherwise(note))
