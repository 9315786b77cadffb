"""Exact deduplication against a persistent digest index (operator 1, native).

The index is a Parquet table bucketed and sorted by the text's SHA-256. A batch
is reduced to one row per digest, a sort-merge anti-join with the index keeps
what is new, and that is appended; the index side of the join needs no shuffle.
Everything is DataFrame or SQL.

Entries carry the id of the batch that brought them. A batch that is run again under
its id, say because the job died after it had appended, finds its own entries as if
they weren't there, adds none twice and gives the same rows. Each append adds one
file a bucket; `compacted` writes an index anew with one file a bucket.

Defined cases: null text counts as empty, and all empty texts are one group; a
null doc_id sorts below every other; of rows that repeat both doc_id and text one
stays; an empty table gives an empty result; other columns are kept as they are
and never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, keep_rows, parts_of, shared_dir, text_of, written

class DigestIndex:
    """A persistent table (digest, keep_id, group_size), bucketed and sorted by digest.

    path is in storage that all executors share. An index that exists is opened
    with the bucket count that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(8, parts_of(spark))
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """The entries of other batches."""
        return self.rows().where(F.col("batch") != batch)

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """The groups whose digest no other batch has brought, by sort-merge anti-join."""
        return groups.join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str = "") -> None:
        """Add the groups that are not entered yet; each bucket gets one sorted file."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        entries = new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        # What is read and what is written must not be the same table's files.
        written(entries, "digest-append").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """The same index at another path, with one file a bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        # Read through a plain copy: Spark would take the old buckets for the new ones and not sort rows into them.
        written(self.rows(), "digest-copy").repartition(self.buckets, "digest").write.insertInto(out.name)
        self.spark.catalog.refreshTable(out.name)
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and a row number that stays the same, as the table is written once."""
    return written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.sha2(ascii_lower(text_of(text_col)), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def batch_groups(rows: DataFrame) -> DataFrame:
    """One row per digest of the batch: the largest doc_id stays. Aggregated before the shuffle."""
    best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("nrow")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.nrow")).alias("keep_row"), "group_size"
    )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Enter docs in the index; one row per document, dropped ones too.

    doc_id, keep_id, group_size, kept, text_sha256. For a text that an earlier
    batch brought, keep_id and group_size are the index's and kept is false.
    batch: the id under which the same docs may be run again; a new one if not given.
    """
    batch = batch or uuid.uuid4().hex
    rows = digests(docs, id_col, text_col)
    groups = written(batch_groups(rows), "digest-groups")
    fresh = written(index.unseen(groups, batch), "digest-fresh")
    index.append(fresh, batch)
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    #: One row per digest of the batch: what is new stands for itself, the rest for the index's entry.
    held = index.before(batch).select("digest", "keep_id", "group_size")
    old = groups.select("digest", F.col("group_size").alias("n")).join(held, "digest").withColumn("keep_row", F.lit(None).cast("long"))
    known = written(fresh.withColumn("n", F.col("group_size")).unionByName(old), "digest-known")
    return hot_join(rows, known, "digest", "n", total).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, shared_dir(spark, "digest-index"))


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    batch = batch or uuid.uuid4().hex
    rows = digests(docs, id_col, text_col)
    fresh = written(index.unseen(batch_groups(rows), batch), "digest-fresh")
    index.append(fresh, batch)
    keys = {"keep_id": F.col(id_col).cast("long"), "digest": F.sha2(ascii_lower(text_of(text_col)), 256)}
    return keep_rows(docs, fresh, keys)
