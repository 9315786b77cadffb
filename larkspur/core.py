"""Table access and session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's Parquet tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new name in the folder that all executors share.

    The folder is the one that spark.checkpoint.dir names. Only a local master, as in
    tests, may do without; there a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        root = _OWN[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table written once in the folder that all executors share."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OWN: list[str] = []


def merging(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both sides are sorted, none is gathered by the driver.

    By the size of its files Spark would broadcast a written table of any number of
    rows: few different values take hardly any room on disk.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small input has no more splits than cores; several of them may hold no row at all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() <= cores else df


def local_session(app: str = "larkspur", cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def in_batches(rows: Iterator[tuple], columns: list[str], most: int = 20_000, size: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Rows as frames of up to `most` rows and about `size` characters or bytes."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or chars >= size:
            yield pd.DataFrame(held, columns=columns)
            held, chars = [], 0
    yield pd.DataFrame(held, columns=columns)
