"""Centroid clustering by delta Lloyd rounds over integer vectors.

Assignments and the clusters' sums stay between rounds. A round compares a vector only
with the centroids that have moved, unless its own has: then with all of them. Of the
vectors that change their cluster, each takes itself away from one sum and adds itself
to another; these signed integers are added up within tasks and then by cluster,
component and limb. What the driver sees is bounded by clusters and components.

All arithmetic is exact. Components are worked on as 64-bit integers, those too large for
that as Python's integers, and sums travel in limbs of LIMB bits, so that any finite
number takes part.

Defined cases: vectors that are null, of another length, or that hold null or
non-finite components take no part; null and repeated ids are rows of their own (a null
id hashes as the empty text; rows that agree in id are taken by their components);
with fewer vectors than clusters there are as many clusters as vectors; an empty table
gives no row. A distance or an inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of a limb of a sum.
LIMB = 30
_LONG = 1 << 63
_STATE = "vec_id long, v array<long>, wide array<string>, owner int, distance long, known boolean"
_TRANSFERS = "cluster int, component int, limb int, total long"


def kept(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """vec_id and `x`, doubles, of the vectors that take part."""
    x = F.col(column).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dims)).where(~odd).select("vec_id", x.alias("x"))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v and wide: floor(scale * x) as longs or, where one is too large, as decimal text; scale is a power of two."""

    def whole(x: float) -> int:
        return int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            n, x = batch.num_rows, lists.flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(n, -1)
            large = np.abs(x).max(axis=1, initial=0) >= narrow(x.shape[1]) / scale
            v = np.floor(np.where(large[:, None], 0.0, x) * scale).astype(np.int64)
            wide = [[str(whole(c)) for c in row] if far else None for row, far in zip(x, large, strict=True)] if large.any() else [None] * n
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(v, large), pa.array(wide, pa.list_(pa.string()))], ["vec_id", "v", "wide"])

    return vectors.mapInArrow(work, "vec_id long, v array<long>, wide array<string>")


def _lists(v: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Rows of v as lists, null where missing."""
    lengths = np.where(missing, 0, v.shape[1])
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(missing, False))
    return pa.ListArray.from_arrays(offsets, pa.array(v[~missing].reshape(-1)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch: 64-bit integers, or Python's where one of them is wide."""
    v, wide = batch.column("v"), batch.column("wide")
    if wide.null_count == batch.num_rows:
        return v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    rows = [[int(c) for c in (a if b is None else b)] for a, b in zip(v.to_pylist(), wide.to_pylist(), strict=True)]
    return np.array(rows, dtype=object).reshape(batch.num_rows, -1)


def narrow(dims: int) -> int:
    """Components of magnitudes below this have squared distances that fit in 64 bits."""
    return 1 << ((62 - max(dims - 1, 1).bit_length()) // 2 - 1)


def squared(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared distances of the rows of x to a centroid, exact."""
    small = x.dtype != object and all(abs(c) < narrow(len(centroid)) for c in centroid)
    d = x - np.array(centroid, dtype=np.int64 if small else object)
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, centroids: list[list[int]], owner: np.ndarray, best: np.ndarray, known: np.ndarray, moved: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and its squared distance, ties to the smaller number.

    owner, best: those of the round before; they hold where `known` is set and the owner has not moved. Such a
    row is compared with the centroids that have moved, the others with all.
    """
    anew = ~known | np.array(moved, dtype=bool)[np.where(known, owner, 0)]
    out_owner, out_best = owner.copy(), best.astype(object)
    if len(rows := np.flatnonzero(anew)):
        d = np.stack([squared(x[rows], c) for c in centroids])
        out_owner[rows] = at = d.argmin(axis=0)
        out_best[rows] = d[at, np.arange(len(rows))]
    if len(rows := np.flatnonzero(~anew)):
        part, own, least = x[rows], owner[rows], out_best[rows]
        for i in (i for i, m in enumerate(moved) if m):
            d = squared(part, centroids[i])
            better = ((d < least) | ((d == least) & (i < own))).astype(bool)
            own[better], least[better] = i, d[better]
        out_owner[rows], out_best[rows] = own, least
    return out_owner, out_best


def limbs(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, limb, signed part) of the values that are not zero."""
    for at, value in enumerate(values):
        sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            if part := rest & ((1 << LIMB) - 1):
                yield at, limb, sign * part
            rest, limb = rest >> LIMB, limb + 1


def assigned(state: DataFrame, centroids: list[list[int]], moved: list[bool]) -> DataFrame:
    """The state after one round of comparing, with `was`, the owner before, or -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            was = batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int32)
            best = batch.column("distance").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, best = nearest(x, centroids, was, best, known, moved)
            distance = pa.array([int(d) if d < _LONG else None for d in best], pa.int64())
            columns = [batch.column("vec_id"), batch.column("v"), batch.column("wide"), pa.array(owner, pa.int32()), distance, distance.is_valid(), pa.array(was, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*(c.split()[0] for c in _STATE.split(", ")), "was"])

    return state.mapInArrow(work, f"{_STATE}, was int")


def transfers(state: DataFrame, clusters: int) -> DataFrame:
    """What the rows whose owner has changed take from one cluster's sums and add to another's; component -1 counts rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            owner, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "was"))
            x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
            if held is None:
                held = np.zeros((clusters, x.shape[1]), dtype=object)
            for i in range(clusters):
                # a batch's narrow components sum up within 64 bits
                held[i] += (x[(owner == i) & (was != i)].sum(axis=0) - x[(was == i) & (owner != i)].sum(axis=0)).astype(object)
        if held is not None:
            rows = [(i, at if at < held.shape[1] - 1 else -1, limb, part) for i in range(clusters) for at, limb, part in limbs([int(c) for c in held[i]])]
            yield pa.RecordBatch.from_pylist([dict(zip(("cluster", "component", "limb", "total"), r, strict=True)) for r in rows], pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))

    return state.where("owner <> was").select("v", "wide", "owner", "was").mapInArrow(work, _TRANSFERS)


def seeds(state: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The first centroids: the vectors with the smallest hashes of `seed:vec_id`, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # rows of the same id are ordered by their components; both columns sort alike on every machine
    first = state.select(key.alias("key"), "v", "wide").orderBy("key", "v", "wide").limit(clusters).collect()
    return [[int(c) for c in (r["v"] if r["wide"] is None else r["wide"])] for r in first]


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Each of `rounds` rounds assigns every vector and moves every centroid that has vectors to the floor of
    their mean; then vectors are assigned once more. What a round decides is written in the shared folder.
    """
    state = written(integers(kept(vectors, dims, column), scale), "centroid-vectors")
    centroids = seeds(state, clusters, seed)
    state = state.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long"), "known": F.lit(False)})
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    moved = [True] * len(centroids)
    for r in range(rounds + 1):
        if not any(moved):
            break  # nothing can change any more
        state = written(assigned(state, centroids, moved), "centroid-round")
        if r == rounds:
            break
        found = transfers(state, len(centroids)).groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for t in found.collect():
            if t["component"] < 0:
                counts[t["cluster"]] += int(t["total"]) << (LIMB * t["limb"])
            else:
                sums[t["cluster"]][t["component"]] += int(t["total"]) << (LIMB * t["limb"])
        after = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
        moved = [a != b for a, b in zip(after, centroids, strict=True)]
        centroids = after
        state = state.drop("was")
    return _labelled(state, centroids)


def _labelled(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds what holds for whole clusters, one row a cluster, by a broadcast of as many rows as there are clusters."""
    spark = state.sparkSession
    wide_sum = F.sum(F.col("distance").cast("decimal(38,0)"))
    exact = F.count("distance") == F.count(F.lit(1))
    per = {r["owner"]: r for r in state.groupBy("owner").agg(wide_sum.alias("total"), exact.alias("exact")).collect()}
    
    def fitting(rows: list) -> int | None:
        total = sum(int(r["total"] or 0) for r in rows)
        return total if all(r["exact"] for r in rows) and total < _LONG else None

    whole = fitting(list(per.values()))
    rows = [(i, fitting([per[i]]), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in per]
    known = spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    exactly = F.when(F.col("known"), F.col("distance"))
    return state.join(F.broadcast(known), "owner").select("vec_id", F.col("owner").alias("cluster"), exactly.alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
