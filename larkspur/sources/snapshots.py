"""A store of registry responses: what was fetched lies under the digest of its request; nothing is fetched here.

The store is Parquet in storage that all executors share, in folders by the first two digits of the
digest, sorted by digest within them. Looking up requests reads the folders that these fall in, and in
them the row groups whose digests and times may match; scanning by age skips row groups that are too old.
A response that comes again is one more row; of those still alive the newest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: days that a response stays alive.
DAYS = 7
SCHEMA = "key string, method string, url string, body string, content string, fetched_at timestamp, prefix string"


def digest(method: Column, url: Column, body: Column) -> Column:
    """SHA-256 of a request's method, URL and body, null counting as empty, one on a line."""
    return F.sha2(F.concat_ws("\n", method, url, F.coalesce(body, F.lit(""))), 256)


def save(path: str, responses: DataFrame) -> None:
    """Add responses: method, url, body, content, fetched_at."""
    keyed = responses.select(digest(F.col("method"), F.col("url"), F.col("body")).alias("key"), "method", "url", "body", "content", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    keyed = keyed.withColumn("prefix", F.substring("key", 1, 2))
    keyed.repartition("prefix").sortWithinPartitions("prefix", "key", "fetched_at").write.mode("append").partitionBy("prefix").parquet(path)


def _alive(spark: SparkSession, path: str, now: Column, days: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def _newest(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("key").agg(F.max_by(F.struct("method", "url", "body", "content", "fetched_at"), "fetched_at").alias("d"))
    return best.select("key", "d.*")


def documents(spark: SparkSession, path: str, now: Column, days: int = DAYS) -> DataFrame:
    """key, method, url, body, content, fetched_at of every response that is alive, the newest of each request."""
    return _newest(_alive(spark, path, now, days))


def lookup(spark: SparkSession, path: str, requests: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """requests (method, url, body, and more) with content and fetched_at; both null where nothing alive is stored, which is to be fetched.

    The requests' folders and digests reach the scan, so that it reads no others.
    """
    asked = requests.withColumn("key", digest(F.col("method"), F.col("url"), F.col("body"))).withColumn("prefix", F.substring("key", 1, 2))
    wanted = asked.select("prefix", "key").distinct()
    folders = [r["prefix"] for r in wanted.select("prefix").distinct().collect()]  # of 256
    held = _alive(spark, path, now, days).where(F.col("prefix").isin(folders)).join(wanted, ["prefix", "key"], "left_semi")
    return asked.drop("prefix").join(_newest(held).select("key", "content", "fetched_at"), "key", "left").drop("key")


def by_url(spark: SparkSession, path: str, method: str, url: str, body: str | None, now: Column, days: int = DAYS) -> DataFrame:
    """One request's response, from its own folder alone."""
    key = spark.range(1).select(digest(F.lit(method), F.lit(url), F.lit(body).cast("string"))).first()[0]
    return _newest(_alive(spark, path, now, days).where((F.col("prefix") == key[:2]) & (F.col("key") == key)))
