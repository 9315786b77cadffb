"""Repeated passages by relative Lempel-Ziv parsing against all earlier documents (operator 10).

The corpus is cut into chunks of documents; each chunk is a document's reader and,
for the documents behind it in the order of ids, a reference block. The blocks are
indexed by windows of `width` words, dealt by hash range. A chunk asks once for each
of its windows, and the index answers with a place in another block: that of the
chunk whose least document with the window comes next below its own. So a passage
that many documents share is a chain through its chunks, and no block is asked twice
for one window, however many share it.

A document is then parsed greedily. At a window with a reference place, the words of
the reference block are fetched and compared with its own from there on; they agree
for the length of the factor (reference document, place, length). The windows that
lie across a factor's end begin a factor of their own, with their own places, before
the words behind it do, so that no passage is lost where two factors meet. Factors of
`width` words or more are the duplicate spans. Each window's least place counts, and
factors may overlap; a factor ends at the latest LOOK words behind the windows that
share its place, where the next one goes on.

Only windows that can be repeated enter the index: each window's least hash of SEED
words in a row (its seed) is counted first, and a seed that one document alone holds
rules its windows out. Deals are worked off one at a time, their number goes with the
words of the corpus, and all groups are bounded by a chunk or a deal.

Defined cases: null text has no word, and its hash is that of the empty text; fewer
words than a window are never removed; a null doc_id counts as larger than all
others; rows with the same doc_id do not remove each other's words; an empty table
gives an empty result; other columns are not read. Windows are looked up by 96 bits
of hash and then compared word by word, so nothing is removed that is no repeat; a
repeat could be missed where two windows with equal 96 bits meet, which at 10^13
windows has a chance below one in a thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_for, parts_of, text_of, written
from .words import joined, pack, packed_words, parts, rows, tokens, unpack, unpacked_words, word_hashes

WIDTH, SEED = 13, 5
#: Words fetched behind the windows that share a reference place.
LOOK = 32
NO_ID = np.iinfo(np.int64).max
_B, _C = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4_000_000
#: Words of the corpus for each deal of the index, about.
DEAL_WORDS = 8_000_000
CHUNK = "chunk long, n long, doc_ids array<long>, limits binary, codes binary, words binary"
SEEDS = "chunk long, deal long, hashes binary"
WINDOWS = f"{SEEDS}, checks binary, least binary, at binary"
BITS = "chunk long, deal long, bits binary"
PLACES = f"{BITS}, sources binary, at binary"
ASKED = "chunk long, asker long, start binary, size binary, source binary, at binary"
SENT = "chunk long, source long, start binary, size binary, doc_ids array<long>, offsets binary, codes binary, words binary"
RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, "
    "factors array<struct<start:long,length:long,source_doc:long,source_start:long>>"
)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _row(schema: str, *cells: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    cols = [pa.array([c], kinds[x.split()[1]]) for c, x in zip(cells, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(cols, _names(schema))


def _planes(x: np.ndarray) -> bytes:
    """Numbers packed byte by byte, which packs small ones well."""
    return pack(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _flat(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of documents, as numbers of the chunk's own words; bucketed by chunk, so that joins don't move it again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for part in parts(batches, size=CHUNK_BYTES):
            owner, codes, words = tokens(part.column(1))
            limits = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            yield _row(CHUNK, at, len(codes), part.column(0).to_pylist(), pack(limits), _planes(number[codes]), packed_words(words.take(pa.array(order))))
            at += 1

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return bucketed(rows_.mapInArrow(work, CHUNK), "chunk", buckets_for(docs, text_col), "passages")


def _run(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n values from each place on, by doubling."""
    done, size, out = h, 1, None
    taken = 0
    while n:
        if n & 1:
            part = done[taken:]
            if out is None:
                out = part.copy()
            else:
                m = min(len(out), len(part))
                out = out[:m] + part[:m] * np.uint64(pow(base, taken, 1 << 64))
            taken += size
        n >>= 1
        if n:
            done = done[: max(len(done) - size, 0)] + done[size:] * np.uint64(pow(base, size, 1 << 64))
            size *= 2
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row counts."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


class Text:
    """A chunk's documents and words."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = row["doc_ids"]
        self.doc_ids = np.array([NO_ID if d is None else d for d in self.ids], np.int64)
        self.limits = unpack(row["limits"], "<i8")
        self.codes = _flat(row["codes"], "<u4")
        self.words = unpacked_words(row["words"])

    def document_end(self, at: np.ndarray) -> np.ndarray:
        return self.limits[np.searchsorted(self.limits, at, "right")]


class Chunk(Text):
    """A chunk's windows: where they start, their documents, seeds and hashes."""

    def __init__(self, row: dict):
        super().__init__(row)
        n = len(self.codes)
        owner = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.limits))
        self.starts = np.flatnonzero(np.arange(n) + WIDTH <= self.limits[1:][owner]) if n >= WIDTH else np.empty(0, np.int64)
        self.owner = owner[self.starts]
        self.seeds = self.hashes = np.empty(0, np.uint64)
        self.checks = np.empty(0, np.uint32)
        if len(self.starts):
            hashes = word_hashes(self.words, 1)[self.codes]
            seeds = _mixed(_run(hashes, SEED, _B))
            least = seeds[: n - WIDTH + 1].copy()
            for k in range(1, WIDTH - SEED + 1):
                np.minimum(least, seeds[k : n - WIDTH + 1 + k], out=least)
            self.seeds = least[self.starts]
            del seeds, least
            self.hashes = _mixed(_run(hashes, WIDTH, _B))[self.starts]
            del hashes
            other = _run(word_hashes(self.words, 2)[self.codes], WIDTH, _C)
            self.checks = (_mixed(other)[self.starts] >> np.uint64(32)).astype(np.uint32)
        # Each seed once for each document that it runs through.
        turn = _changes(self.seeds, self.owner)
        at = np.lexsort((self.owner[turn], self.seeds[turn]))
        seed, doc = self.seeds[turn][at], self.owner[turn][at]
        new = _changes(seed)
        other_doc = _changes(doc) & ~new
        self.kinds = seed[new]
        self.within = np.bincount(np.cumsum(new) - 1, other_doc, len(self.kinds)) > 0 if len(seed) else np.zeros(0, bool)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """(windows that may be repeated, the place of each among the distinct ones, and of those the hashes, checks, least doc_id and where it stands)."""
        hit = (shared | self.within)[np.searchsorted(self.kinds, self.seeds)] if len(self.kinds) else np.zeros(0, bool)
        at = np.flatnonzero(hit)
        ids = self.doc_ids[self.owner[at]]
        order = np.lexsort((ids, self.checks[at], self.hashes[at]))
        h, c = self.hashes[at][order], self.checks[at][order]
        new = _changes(h, c)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return at, place, h[new], c[new], ids[first], self.starts[at][first]


def _slices(sorted_: np.ndarray, deals: int) -> np.ndarray:
    """Limits of each deal's range in sorted hashes."""
    low = [(k << 64) // deals for k in range(1, deals)]
    return np.concatenate([[0], np.searchsorted(sorted_, np.array(low, np.uint64)), [len(sorted_)]])


def _blobs(schema: str, chunk: int, deals: int, sorted_: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A chunk's hashes, and what goes with each, one row a deal."""
    cut = _slices(sorted_, deals)
    full = np.flatnonzero(np.diff(cut))
    cols = [pa.array(np.full(len(full), chunk)), pa.array(full)]
    for x, way in zip((sorted_, *more), (pack, pack, _planes, _planes), strict=False):
        cols.append(pa.array([way(x[cut[k] : cut[k + 1]]) for k in full], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, _names(schema))


def _joined(answers: list[dict] | None, sorted_: np.ndarray, deals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What came back from the deals, in the order of the sorted hashes: a bit, and where it is set a chunk and a place there."""
    cut = _slices(sorted_, deals)
    hit, source, at = np.zeros(len(sorted_), bool), np.full(len(sorted_), -1), np.full(len(sorted_), -1)
    for x in answers or []:
        here = slice(cut[x["deal"]], cut[x["deal"] + 1])
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=here.stop - here.start).astype(bool)
        hit[here] = bits
        if "sources" in x:
            source[here][bits], at[here][bits] = unpack(x["sources"], "<i8"), _flat(x["at"], "<u4")
    return hit, source, at


def _deals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Deal after deal, of rows in their order."""
    for deal, group in groupby(rows(batches), key=lambda r: r["deal"]):
        yield deal, list(group)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which seeds come from more than one chunk."""
    for deal, group in _deals(batches):
        hashes = [unpack(r["hashes"], "<u8") for r in group]
        _, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        bits = np.split(count[place] > 1, np.cumsum([len(h) for h in hashes])[:-1])
        cols = [pa.array([r["chunk"] for r in group]), pa.array([deal] * len(group)), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, _names(BITS))


def below(h: np.ndarray, c: np.ndarray, ids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For each entry one with the same h and c and the next smaller id, -1 if there is none.

    Entries with the same id share those below them evenly. turn: a number that
    orders entries otherwise equal.
    """
    order = np.lexsort((turn, ids, c, h))
    new = _changes(h[order], c[order])
    tied = _changes(h[order], c[order], ids[order])
    at = np.arange(len(order))
    group = np.maximum.accumulate(np.where(new, at, 0))
    tie = np.maximum.accumulate(np.where(tied, at, 0))
    smaller = tie - group
    source = np.where(smaller > 0, tie - 1 - (at - tie) % np.maximum(smaller, 1), -1)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(source >= 0, order[source], -1)
    return out


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each window stands in a chunk with a smaller least doc_id."""
    for deal, group in _deals(batches):
        hashes = [unpack(r["hashes"], "<u8") for r in group]
        sizes = [len(h) for h in hashes]
        chunk = np.repeat([r["chunk"] for r in group], sizes)
        checks, ids, at = (np.concatenate([read(r[name], kind) for r in group]) for name, read, kind in (("checks", unpack, "<u4"), ("least", _flat, "<i8"), ("at", _flat, "<u4")))
        source = below(np.concatenate(hashes), checks, ids, chunk)
        cuts = np.cumsum(sizes)[:-1]
        out = []
        for r, s in zip(group, np.split(source, cuts), strict=True):
            hit = s >= 0
            if hit.any():
                out.append((r["chunk"], np.packbits(hit).tobytes(), pack(chunk[s[hit]]), _planes(at[s[hit]])))
        if out:
            numbers, bits, sources, places = zip(*out, strict=True)
            cols = [pa.array(numbers), pa.array([deal] * len(out)), *(pa.array(x, pa.binary()) for x in (bits, sources, places))]
            yield pa.RecordBatch.from_arrays(cols, _names(PLACES))


def _asked(c: Chunk, seed_bits: list[dict] | None, places: list[dict] | None, deals: int) -> Iterator[pa.RecordBatch]:
    """The runs of windows with a reference place, and from each block the words they need.

    In the first row: where a run starts, how many windows it has, and the chunk
    and place that its first window has there. In the others, for another chunk:
    where its words start and how many are needed.
    """
    at, place, kinds, _, least, where = c.candidates(_joined(seed_bits, c.kinds, deals)[0])
    hit, source, there = _joined(places, kinds, deals)
    own = c.doc_ids[c.owner[at]] > least[place]
    known = own | hit[place]
    own, place, pos = own[known], place[known], c.starts[at[known]]
    if not len(pos):
        return
    chunk, there = np.where(own, c.number, source[place]), np.where(own, where[place], there[place])
    step = _changes(pos - np.arange(len(pos)))
    first = np.flatnonzero(step | _changes(chunk) | _changes(there - pos))
    size = np.diff(np.append(first, len(pos)))
    # Words from a run's start to the end of the windows in a row that it is one of.
    last = np.append(np.flatnonzero(step)[1:] - 1, len(pos) - 1)
    ends = pos[last[np.searchsorted(last, first)]] + WIDTH
    start, chunk, there = pos[first], chunk[first], there[first]
    yield _row(ASKED, c.number, None, pack(start), pack(size), pack(chunk), pack(there))
    words = np.minimum(size + WIDTH - 1 + LOOK, ends - start)
    order = np.argsort(chunk, kind="stable")
    order = order[chunk[order] != c.number]
    for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []:
        yield _row(ASKED, int(chunk[part[0]]), c.number, pack(there[part]), pack(words[part]), None, None)


def _sent(t: Text, asker: int, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The words that one chunk asked of another, as stretches that lie within a document."""
    end = np.minimum(start + size, t.document_end(start))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] >= end[:-1]
    first = np.flatnonzero(new)
    start, end = start[first], end[np.append(first[1:], len(end)) - 1]
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    used, codes = np.unique(t.codes[at], return_inverse=True)
    doc = np.searchsorted(t.limits, start, "right") - 1
    ids = [t.ids[d] for d in doc.tolist()]
    return _row(SENT, asker, t.number, pack(start), pack(size), ids, pack(start - t.limits[doc]), _planes(codes.astype(np.uint32)), packed_words(t.words.take(pa.array(used))))


class Block:
    """Stretches of a reference block in the numbers of the reader's words; -1 for words it has not."""

    def __init__(self, start: np.ndarray, size: np.ndarray, ids: list, offsets: np.ndarray, codes: np.ndarray):
        self.start, self.end, self.ids, self.offsets, self.codes = start, start + size, ids, offsets, codes
        self.base = np.cumsum(size) - size

    def words_from(self, at: int) -> tuple[np.ndarray, int | None, int]:
        """The words of a document from a place on, its doc_id, and how many words of it come before."""
        k = int(np.searchsorted(self.start, at, "right")) - 1
        a = int(self.base[k] + at - self.start[k])
        return self.codes[a : a + int(self.end[k]) - at], self.ids[k], int(self.offsets[k]) + at - int(self.start[k])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start on; looks at ever longer pieces, so at twice as many at most."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        other = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        k = int(other.argmax())
        if other[k]:
            return done + k
        done, step = done + len(other), 2 * step
    return n


def factors(t: Text, runs: dict[str, np.ndarray], blocks: dict[int, Block]) -> list[tuple[int, int, int | None, int]]:
    """(place, length, reference doc_id, place in that document) of the factors, in order of their places.

    Where a factor ends, the windows across its end are looked at first: the next
    factor starts at the first of them that has a reference place.
    """
    out: list[tuple[int, int, int | None, int]] = []
    codes = t.codes.astype(np.int64)
    at = 0
    for start, size, source, there, end in zip(*(runs[k].tolist() for k in ("start", "size", "source", "at")), t.document_end(runs["start"]).tolist(), strict=True):
        at = max(at, start)
        while at < start + size:
            words, doc, offset = blocks[source].words_from(there + at - start)
            n = _agreeing(codes[at:end], words)
            if n < WIDTH:  # equal hashes of different words
                at += 1
                continue
            out.append((at, n, doc, offset))
            at += n - WIDTH + 1
    return out


def _parsed(t: Text, asked: dict | None, sent: list[dict]) -> pa.RecordBatch:
    found: list[tuple[int, int, int | None, int]] = []
    if asked:
        theirs = [unpacked_words(s["words"]) for s in sent]
        number = pc.index_in(pa.concat_arrays(theirs), value_set=t.words).fill_null(-1).to_numpy().astype(np.int64) if sent else np.empty(0, np.int64)
        numbers = np.split(number, np.cumsum([len(w) for w in theirs])[:-1])
        n = np.diff(t.limits)
        blocks = {t.number: Block(t.limits[:-1][n > 0], n[n > 0], [d for d, k in zip(t.ids, n.tolist(), strict=True) if k], np.zeros(int((n > 0).sum()), np.int64), t.codes.astype(np.int64))}
        for s, own in zip(sent, numbers, strict=False):
            blocks[s["source"]] = Block(unpack(s["start"], "<i8"), unpack(s["size"], "<i8"), s["doc_ids"], unpack(s["offsets"], "<i8"), own[_flat(s["codes"], "<u4")])
        runs = {k: unpack(asked[k], "<i8") for k in ("start", "size", "source", "at")}
        found = factors(t, runs, blocks)
    return _result(t, found)


def _result(t: Text, found: list[tuple[int, int, int | None, int]]) -> pa.RecordBatch:
    n = len(t.ids)
    step = np.zeros(len(t.codes) + 1, np.int64)
    for at, size, _, _ in found:
        step[at] += 1
        step[at + size] -= 1
    gone = np.cumsum(step)[:-1] > 0
    owner = np.repeat(np.arange(n), np.diff(t.limits))
    removed = np.bincount(owner, gone, n).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.diff(t.limits) - removed)])
    kept = joined(t.words.take(pa.array(t.codes[~gone])), ends)
    edges = np.frombuffer(kept.buffers()[1], np.int64)[: n + 1].tolist()
    text = memoryview(kept.buffers()[2] or b"")
    digests = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]
    first = np.flatnonzero(_changes(gone, owner)) if len(gone) else np.empty(0, np.int64)
    last = np.append(first[1:], len(gone))
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(first[gone[first]].tolist(), last[gone[first]].tolist(), strict=True):
        d = owner[a]
        spans[d].append({"start": int(a - t.limits[d]), "end": int(b - t.limits[d])})
    parsed: list[list[dict]] = [[] for _ in range(n)]
    for at, size, doc, offset in found:
        d = owner[at]
        parsed[d].append({"start": int(at - t.limits[d]), "length": size, "source_doc": doc, "source_start": offset})
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    factor = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "source_doc", "source_start")]))
    cols = [pa.array(t.ids, pa.int64()), pa.array(np.diff(t.limits)), pa.array(removed), pa.array(digests), pa.array(spans, span), pa.array(parsed, factor)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the factors of the parse, and the spans of removed words, as word numbers."""
    spark = docs.sparkSession
    made = chunks(docs, id_col, text_col)
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spread = parts_of(spark)
    deals = 1 << (max(2 * spread, -(-total // DEAL_WORDS)) - 1).bit_length()

    def send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield _blobs(SEEDS, row["chunk"], deals, Chunk(row).kinds)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            c = Chunk(row)
            _, _, kinds, checks, least, where = c.candidates(_joined(row["seed_bits"], c.kinds, deals)[0])
            yield _blobs(WINDOWS, row["chunk"], deals, kinds, checks, least, where.astype(np.uint32))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield from _asked(Chunk(row), row["seed_bits"], row["places"], deals)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            t = Text(row)
            for a in row["asked"]:
                yield _sent(t, a["asker"], unpack(a["start"], "<i8"), unpack(a["size"], "<i8"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield _parsed(Text(row), row["runs"], row["sent"] or [])

    def by_chunk(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "chunk"])).alias(name))

    def by_deal(df: DataFrame) -> DataFrame:
        return df.repartition(max(spread, deals // 16), "deal").sortWithinPartitions("deal")

    seeds = by_chunk(written(by_deal(made.mapInArrow(send_seeds, SEEDS)).mapInArrow(_shared, BITS), "seed-bits"), "seed_bits")
    windows = by_deal(made.join(seeds, "chunk", "left").mapInArrow(send_windows, WINDOWS))
    places = by_chunk(written(windows.mapInArrow(_earlier, PLACES), "window-places"), "places")
    asked = written(made.join(seeds, "chunk", "left").join(places, "chunk", "left").mapInArrow(ask, ASKED), "asked")
    needed = by_chunk(asked.where("asker IS NOT NULL").select("chunk", "asker", "start", "size"), "asked")
    sent = by_chunk(written(made.join(needed, "chunk").mapInArrow(send, SENT), "reference-words"), "sent")
    runs = asked.where("asker IS NULL").select("chunk", F.struct("start", "size", "source", "at").alias("runs"))
    return made.join(runs, "chunk", "left").join(sent, "chunk", "left").mapInArrow(parse, RESULT)
