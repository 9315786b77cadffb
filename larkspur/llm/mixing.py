"""Mixing sources to target weights by Poisson replication (operator 5).

A source of n documents with weight w gets the mean rate w * total / n. Each
document's count is drawn from the Poisson distribution of that mean, by inverting
it at a number hashed from seed and doc_id; the document is repeated that often and
all copies are shuffled globally by a hash of seed, doc_id and copy.

Defined cases: a null source is a source of its own; sources without a given
weight get none and vanish; rows that repeat a doc_id draw the same count; null
text and other columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of, written

#: Rates are broadcast up to so many sources; beyond, they are joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: A mean above this is drawn as a sum of equal parts, so that exp(-mean) is no zero.
PART = 100.0


def uniform(seed: int, doc_id: Column, draw: Column) -> Column:
    """A number from 0 to 1 with 52 bits, from the SHA-256 of seed, id and draw."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), draw.cast("string"))
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0, as an array, as far as doubles can tell."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(steps, start, step, lambda s: s["c"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """docs, each repeated by its draw, in random order; copy_col numbers the copies from 1.

    weights: by source; None gives every source the same. total: the expected
    number of rows; None keeps the input's.
    """
    sizes = written(docs.groupBy(F.col(source_col).cast("string").alias("__mix_source")).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    kinds, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = rows if total is None else total
    if weights is None:
        rates = sizes.withColumn("w", F.lit(1.0 / max(kinds, 1)))
    else:
        scale = sum(weights.values()) or 1.0
        given = docs.sparkSession.createDataFrame([(k, v / scale) for k, v in weights.items()], "name string, w double")
        rates = sizes.join(given, sizes["__mix_source"].eqNullSafe(given["name"])).drop("name")
    rates = rates.withColumn("mean", F.col("w") * F.lit(float(total)) / F.col("n")).where("mean > 0")
    rates = rates.withColumn("__mix_draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int"))
    rates = rates.select("__mix_source", "__mix_draws", _cdf(F.col("mean") / F.col("__mix_draws")).alias("__mix_cdf"))
    wide = docs.withColumn("__mix_key", F.col(source_col).cast("string"))
    if kinds <= BROADCAST_SOURCES:
        joined = wide.join(F.broadcast(rates), F.col("__mix_key").eqNullSafe(F.col("__mix_source")))
    else:
        wide = wide.withColumn("__mix_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        salted = rates.withColumn("__mix_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = wide.join(salted, F.col("__mix_key").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_salt") == F.col("__mix_to")))
    id_ = F.col(id_col)
    # Each number is drawn once, before it is held against the distribution.
    drawn = F.transform(F.sequence(F.lit(1), F.col("__mix_draws")), lambda draw: uniform(seed, id_, draw))
    count = F.aggregate(drawn, F.lit(0), lambda n, x: n + F.size(F.filter("__mix_cdf", lambda c: c <= x)))
    if copy_col and copy_col in docs.columns:
        raise ValueError(f"docs has a column {copy_col}")
    name = copy_col or "__mix_copy"
    counted = joined.withColumn("__mix_count", count).where("__mix_count > 0")
    copies = counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_count"))).alias(name))
    # The partition and the place in it both come from the hash: a random order of all
    # rows, without the second reading of the input that range partitions need.
    order = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(name))
    shuffled = copies.withColumn("__mix_order", order).repartition(parts_of(docs.sparkSession), "__mix_order").sortWithinPartitions("__mix_order")
    return shuffled.drop("__mix_order", *([] if copy_col else [name]))
