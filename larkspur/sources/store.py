"""Stored samples, scans and matrices: index semantics, readers and sinks."""

from __future__ import annotations

import html
import json

from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut


def vault_index(entries: DataFrame) -> DataFrame:
    """The last entry of each sample. entries: sample_id, seq and what describes the sample."""
    cols = [c for c in entries.columns if c != "sample_id"]
    return entries.groupBy("sample_id").agg(F.max_by(F.struct(*cols), "seq").alias("e")).select("sample_id", "e.*")


def vault_stats(index: DataFrame) -> DataFrame:
    """Samples by label and ecosystem, and their total with nulls for both."""
    return index.groupingSets([["label", "ecosystem"], []], "label", "ecosystem").agg(F.count(F.lit(1)).alias("samples"))


def vault_problems(samples: DataFrame) -> DataFrame:
    """Samples that are missing or whose SHA-256 isn't the stored one. samples: sample_id, sha256, content."""
    problem = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "corrupt")
    return samples.select("sample_id", problem.alias("problem")).where("problem IS NOT NULL")


def read_matrix(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A feature matrix in CSV. Its header must be exact; rows of another length are left out."""
    want = ["sample_id", "label", "group", *features]
    head = spark.read.text(path).where("value LIKE 'sample_id%'").first()
    if head is None or head[0].split(",") != want:
        raise ValueError(f"the header of {path} isn't {','.join(want)}")
    kinds = ", ".join(["sample_id string", "label int", "`group` string", *(f"`{f}` double" for f in features)])
    return spark.read.schema(kinds).option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", True).csv(path)


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers, 0 where they aren't."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


#: Buckets of a scan store, and rows of a file. A store keeps the number of buckets that it was made with.
BUCKETS, FILE_ROWS = 256, 5_000_000


def bucket(scan_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(scan_id.cast("string")), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _replace(rows: DataFrame, path: str) -> None:
    """Write whole buckets in place of what they held; a large one is several files."""
    rows = cut(rows)
    sizes = rows.groupBy("bucket").count().withColumn("__files", F.ceil(F.col("count") / FILE_ROWS))
    salted = rows.join(F.broadcast(sizes.select("bucket", "__files")), "bucket")  # a row for each bucket
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "bucket"]), F.col("__files"))
    dealt = salted.withColumn("__file", salt).repartition("bucket", "__file").drop("__files", "__file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(path)


def upsert_scans(spark: SparkSession, path: str, scans: DataFrame, buckets: int = BUCKETS) -> None:
    """Store scans; one that is stored already is replaced whole.

    Scans are hashed to a fixed number of buckets, so any number of them leaves a bounded number of files. Only the buckets that the
    new scans fall in are read, merged and replaced, each at once; done again it changes nothing.
    """
    new = cut(scans.withColumn("bucket", bucket(F.col("scan_id"), buckets)))
    old = _stored(spark, path)
    if old is None:
        return _replace(new, path)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
    kept = old.where(F.col("bucket").isin(touched)).join(new.select("scan_id").distinct(), "scan_id", "left_anti")
    return _replace(kept.unionByName(new, allowMissingColumns=True), path)


def seeded_subset(rows: DataFrame, key: Column, limit: int, seed: int) -> DataFrame:
    """A fixed random subset: the `limit` rows with the least MD5 of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(limit)


def model_card(metrics: dict, importances: list[tuple[str, float]], features: list[str], version: int) -> str:
    return json.dumps({"schema_version": version, "features": features, "metrics": metrics, "importances": [{"feature": f, "importance": i} for f, i in importances[:40]]}, indent=2)


def report(packages: DataFrame, title: str, limit: int = 25) -> str:
    """A page of the worst packages; every value is escaped. Collects `limit` rows."""
    rows = packages.orderBy(F.col("score").desc(), "package").limit(limit).collect()
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    body = "\n".join("<tr>" + "".join(cell(v) for v in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in packages.columns)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>\n{body}</table>"


def write_matrix(rows: DataFrame, path: str, features: list[str]) -> None:
    """A feature matrix as CSV with the exact header, and beside it a JSON line for each sample."""
    rows.select("sample_id", "label", "group", *features).write.mode("overwrite").option("header", True).csv(f"{path}/features")
    rows.select("sample_id", "label", "group").write.mode("overwrite").json(f"{path}/samples")


def put(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """Store samples that are not stored yet, under their SHA-256; returns what was added. samples: name, label, ecosystem, content.

    The store is a Parquet table in storage that all executors share. Contents that
    are stored already, by this call or an earlier one, are not stored again.
    """
    new = samples.withColumn("sample_id", F.sha2("content", 256)).dropDuplicates(["sample_id"])
    try:
        new = new.join(spark.read.parquet(path).select("sample_id"), "sample_id", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = cut(new.withColumn("sha256", F.col("sample_id")))
    new.write.mode("append").parquet(path)
    return new


def get(spark: SparkSession, path: str, sample_ids: list[str]) -> DataFrame:
    """The stored samples with these ids."""
    return spark.read.parquet(path).where(F.col("sample_id").isin(sample_ids))


def load_scan(spark: SparkSession, path: str, scan_id: str, buckets: int = BUCKETS) -> DataFrame:
    """A stored scan's rows; only its bucket is read."""
    return spark.read.parquet(path).where((F.col("bucket") == bucket(F.lit(scan_id), buckets)) & (F.col("scan_id") == scan_id)).drop("bucket")


def delete_scan(spark: SparkSession, path: str, scan_id: str, buckets: int = BUCKETS) -> bool:
    """Take a scan out of its bucket; whether there was one."""
    stored = _stored(spark, path)
    if stored is None:
        return False
    own = stored.where(F.col("bucket") == bucket(F.lit(scan_id), buckets))
    if own.where(F.col("scan_id") == scan_id).isEmpty():
        return False
    rest = cut(own.where(F.col("scan_id") != scan_id))
    if rest.isEmpty():  # an overwrite with no row would leave the bucket as it is
        number = spark.range(1).select(bucket(F.lit(scan_id), buckets)).first()[0]
        system, root = FileSystem.from_uri(path)
        system.delete_dir(f"{root}/bucket={number}")
    else:
        _replace(rest, path)
    return True
