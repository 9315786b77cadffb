"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in spark.checkpoint.dir. Only with a local master, as in tests, may that
    be unset; a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


_OWN: list[str] = []


def _own_root() -> str:
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return _OWN[0]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write df in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """Write df once as a table bucketed by key in the shared folder: joins on key do not move it again."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    name = f"larkspur_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


#: Bytes of text for each bucket of a table of chunks, about.
BUCKET_BYTES = 64_000_000


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """Buckets that the documents' text fills."""
    size = docs.select(F.coalesce(F.sum(F.octet_length(text_of(text_col))), F.lit(0)).alias("n")).first()["n"]
    return max(parts_of(docs.sparkSession), -(-size // BUCKET_BYTES))


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() is the same, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n longs that hash partitioning into n partitions deals out one to each."""
    tried = spark.range(16 * n + 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    key = {r["p"]: r["id"] for r in tried.groupBy("p").agg(F.min("id").alias("id")).toLocalIterator()}
    return [key.get(p, -1 - p) for p in range(n)]


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


#: A key with more than this share of the rows is joined by broadcast; no more than so many such keys can exist.
HEAVY = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left joined with right by key, where right has one row a key and `count` says how many left rows have it.

    Keys with more than a HEAVY-th of the total rows, HEAVY at most, meet by broadcast, so that none
    of them fills a task; the others by a shuffle. The count leaves the result.
    """
    often = F.col(count) * HEAVY > F.lit(total)
    hot = right.where(often).drop(count)
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    few = marked.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    rest = marked.where("__hot IS NULL").drop("__hot").join(right.where(~often).drop(count), key)
    return few.unionByName(rest)


def keep_rows(docs: DataFrame, keepers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose keys are in keepers, one for each key; all columns as they were.

    keys: a keeper's column name, and the expression that gives it from a row of
    docs. The whole key is the join key, so a large group of copies is spread by
    its ids. Null keys match null.
    """
    names = {k: f"__keep_{i}_{uuid.uuid4().hex[:6]}" for i, k in enumerate(keys)}
    wide = docs.withColumns({names[k]: c for k, c in keys.items()})
    right = keepers.select(*[F.col(k).alias(f"r{names[k]}") for k in keys])
    on = [wide[n].eqNullSafe(right[f"r{n}"]) for n in names.values()]
    return wide.join(right, on, "left_semi").dropDuplicates(list(names.values())).drop(*names.values())


#: Rows of a range in which rows are numbered.
RANGE_ROWS = 1_000_000


def tree_key(name: Column) -> Column:
    """A key without nulls that sorts as the name does, null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, from 0 within `tree` in ascending order, n, the rows of the tree, and row, a number of its own.

    rows: tree, a key without nulls, and more. What is numbered is written first, so the numbers stay. Rows are sorted in ranges; what comes before a range in a tree is summed up apart, so a
    tree with most of the rows is no task of its own.
    """
    parts = max(parts_of(rows.sparkSession), rows.count() // RANGE_ROWS)
    keys = ["tree", *order, "__tie"]
    placed = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("row", 33))
    runs = placed.groupBy("tree", "__part").agg(F.min("row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "__part", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"), F.sum("__rows").over(tree).alias("n"))
    return placed.join(runs, ["tree", "__part"]).withColumn("idx", F.col("__base") + F.col("row")).drop("__base", "__part")
