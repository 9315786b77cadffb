"""Resumable appends: a file-source stream whose rows are entered once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def unseen(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one for each key."""
    return rows.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame], per_trigger: int = 1000) -> None:
    """Process the files that a folder has gained since the last run, then stop.

    Which keys were seen is state of the stream, kept by key in the checkpoint; the target is never read. Rows of a known key leave
    before they are transformed, so `transform` takes a stream of rows with the key, and must be row by row. The file sink lists in the
    target which files a batch has written, so a batch that is tried again after a failure adds nothing twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source).dropDuplicates([key])
    sink = transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
