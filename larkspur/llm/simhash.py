"""SimHash near-duplicates through deletion-variant signatures (operator 7).

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 of
its word shingles. Two fingerprints that differ in at most d = 4 bits are cut into
3 segments: one segment then differs in one bit at most. So each segment is indexed
once for every bit of it with that bit left out (64 signatures in all), and linked
fingerprints share a signature. Equal signatures are brought together by a shuffle
and verified there.

Within a signature, pairs are compared only until the links found join everything
that can be joined: a group of near copies is one component after a few
comparisons with whole columns, and each partition passes on a spanning forest, so
the links that leave it are fewer than its fingerprints, never all pairs. Equal
fingerprints count once. Components are found by distributed star contraction.

A signature has 20 or 21 bits. With n distinct fingerprints spread evenly it holds
n / 2^20 of them, eight bytes each. One with more than MANY is parted again by the
bits outside its segment, cut into d + 1 parts of which linked fingerprints share one.

Defined cases: null text is empty; a text without words has fingerprint zero and is
linked like any other; null and repeated doc_ids are rows of their own; an empty
table gives an empty result; other columns are kept by `survivors` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, keep_rows, parts_of, text_of, written
from .components import components

#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
DISTANCE = 4
#: Signatures with at most so many fingerprints are compared pair by pair.
SMALL = 48
#: Signatures with more fingerprints are parted once more before they are compared.
MANY = 4096
#: Rows held at once beside the rows of one signature.
CHUNK = 400_000


def fingerprint(text: str, shingle: int) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    table = np.array(hashes, ">u8")
    for at in range(0, len(table), 4096):
        counts += np.unpackbits(table[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(table)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; digest too, if given."""
    names = ["doc_id", "fp", *(["digest"] if digest is not None else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names)

    cols = [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *([digest.alias("digest")] if digest is not None else [])]
    return docs.select(*cols).mapInArrow(work, ", ".join(f"{n} {'binary' if n == 'digest' else 'long'}" for n in names))


def signatures(fp: Column) -> Column:
    """64 ints: for each bit of each segment, the bit's number and the segment without it."""
    out = []
    for low, bits in SEGMENTS:
        for bit in range(bits):
            segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit)))
            out.append((segment + F.lit((low + bit) << 22)).cast("int"))
    return F.array(*out)


def _close(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ other) <= DISTANCE


def _masks(low: int, bits: int) -> list[np.uint64]:
    """The bits outside a segment in DISTANCE + 1 parts: linked fingerprints agree in one of them."""
    rest = [b for b in range(64) if not low <= b < low + bits]
    return [np.uint64(sum(1 << b for b in rest[k :: DISTANCE + 1])) for k in range(DISTANCE + 1)]


MASKS = [_masks(*s) for s in SEGMENTS]


def links_of_many(fps: np.ndarray, masks: list[np.uint64]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same as links_within for the many fingerprints of a frequent signature, compared only where they agree in one of the masks."""
    out = []
    for mask in masks:
        key = fps & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                out += links_within(fps[part])
    return out


def links_within(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever distinct fps are connected at DISTANCE or less.

    A fingerprint is compared with all others at once. Two components need no more
    comparing once every member of the smaller one has been compared.
    """
    n = len(fps)
    label = np.arange(n)
    done = np.zeros(n, bool)
    out = []
    block = 1
    while True:
        sizes = np.bincount(label, minlength=n)
        todo = np.flatnonzero(~done & (label != sizes.argmax()))
        if not len(todo):
            return out
        take = todo[:block]
        near = _close(fps[take, None], fps[None, :])
        for row, i in zip(near, take.tolist(), strict=True):
            met = np.flatnonzero(row)
            old = np.unique(label[met])
            if len(old) > 1:
                _, first = np.unique(label[met], return_index=True)
                out.append((np.full(len(first), fps[i]), fps[met[first]]))
                label[np.isin(label, old)] = old[0]
        done[take] = True
        block = min(2 * block, max(1, 2_000_000 // n))


def _small_pairs(sig: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the neighbours 1, 2, ... places apart within a signature."""
    for step in range(1, SMALL):
        same = sig[step:] == sig[:-step]
        if not same.any():
            return
        at = np.flatnonzero(same)
        at = at[_close(fps[at], fps[at + step])]
        yield fps[at], fps[at + step]


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component that pairs make."""
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.uint64) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, up := root[root]):
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[root[keep]], nodes[keep]


def _segment(sig: int) -> int:
    """The segment that a signature is of."""
    bit = (sig & 0xFFFFFFFF) >> 22
    return next(i for i, (low, bits) in enumerate(SEGMENTS) if low <= bit < low + bits)


def links(distinct: DataFrame, partitions: int) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within DISTANCE."""
    rows = distinct.select("fp", F.explode(signatures(F.col("fp"))).alias("sig"))
    near = rows.repartition(partitions, "sig").sortWithinPartitions("sig")

    def verify(sig: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(sig)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(sig))
        many = ends - starts > SMALL
        out = []
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            if e - s > MANY:
                out = [_forest(out + links_of_many(fps[s:e], MASKS[_segment(int(sig[s]))]))]
            else:
                out += links_within(fps[s:e])
        few = np.repeat(~many, ends - starts)
        return out + list(_small_pairs(sig[few], fps[few]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held, n = [], 0

        def flush(last: bool) -> None:
            nonlocal held, n, found
            sig = np.concatenate([h[0] for h in held])
            fps = np.concatenate([h[1] for h in held])
            cut = len(sig) if last else int(np.searchsorted(sig, sig[-1]))
            if cut:
                found = [_forest(found + verify(sig[:cut], fps[:cut]))]
            held, n = [(sig[cut:], fps[cut:])], len(sig) - cut

        limit = CHUNK
        for batch in batches:
            held.append((batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n > limit:
                flush(False)
                limit = max(CHUNK, 2 * n)
        if held:
            flush(True)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found[0]], ["a", "b"])

    return near.mapInArrow(work, "a long, b long")


def _grouped(fps: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, the rows with it and the root of its component, root and the component's least), of rows with fp."""
    distinct = written(fps.groupBy("fp").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    roots = written(components(links(distinct.select("fp"), parts_of(fps.sparkSession))), "simhash-roots")
    member = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "simhash-members")
    return member.select("fp", "rows", "root"), written(member.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("members")), "simhash-least")


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach.

    A fingerprint that many rows have, or a component with many fingerprints, meets
    its rows by broadcast.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    member, least = _grouped(fps, F.col("doc_id"))
    kinds, rows = member.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    ids = written(hot_join(member, least, "root", "members", kinds).select("fp", "rows", F.col("least").alias("component_id")), "simhash-ids")
    return hot_join(fps, ids, "fp", "rows", rows).select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, one with the smallest doc_id (null only where all are), with all its columns.

    A keeper is known by its doc_id and its text's digest: rows that agree in both
    have one fingerprint, so they are of one component, and one of them stays.
    """
    digest = F.unhex(F.sha2(text_of(text_col), 256))
    fps = written(fingerprints(docs, shingle, id_col, text_col, digest), "simhash")
    _, least = _grouped(fps, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    return keep_rows(docs, least.select("least.doc_id", "least.digest"), {"doc_id": F.col(id_col).cast("long"), "digest": digest})
