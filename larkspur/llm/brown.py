"""Scoring texts with a Brown class-based bigram model (operator 8).

Counts come from all training documents. The corpus is read once, cut into chunks
and written as word numbers of each chunk's own vocabulary; the vocabularies are
dealt by word hash, summed, and each chunk gets its words' corpus counts back, so
what is shuffled is a chunk's distinct words rather than its text. Deals are worked
off one at a time, and their number goes with the corpus.

A word with `floor` training tokens is a unit of its own, of each deal the most
frequent ones up to its part of VOCABULARY; all other and unknown words are one
unit. Exchange clustering then assigns units to classes. It places the units with
SHARE of the tokens, of which there can't be more than 1 / SHARE, one at a time; their
bigram counts are a table of bounded size. The others move in distributed rounds:
for each unit the classes of its neighbours are counted, first where its tokens lie
and then brought together, and half of the units move to the class with the largest
gain against the class bigrams of the round before, their own tokens taken out. Of
all rounds the one with the largest likelihood counts. Classes grow with the cube
root of the units. A token's probability is
    mix * P(class | class before) * P(word | class) + (1 - mix) * P(word),
summing to one over the training words, the end, and an unknown word.

Defined cases: null text is empty, and an empty text is its end token; null ids
train; repeated rows count as often as they stand there; with no training row all
counts are zero; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_for, parts_of, text_of, written
from .words import pack, packed_words, parts, rows, tokens, unpack, unpacked_words, word_hashes

#: A word with so many training tokens is a unit of its own.
FLOOR = 20
#: Units at most, about; rarer words share one.
VOCABULARY = 2_000_000
#: A unit with this share of all tokens is placed one at a time.
SHARE = 1 / 500
CLASSES = 40
#: More classes than CLASSES: so many times the cube root of the units.
CLASS_GROWTH = 2
SWEEPS = 8
#: Rounds of the units that are not placed one at a time; each moves half of them.
ROUNDS = 8
MIX = 0.85
#: Weight of the classes' own shares in the transition probabilities.
PRIOR = 5.0
#: Bands of rows in which the bigram table is summed.
BANDS = 16
#: The unit of all rare and unknown words, that of the end token, and the first of a word of its own.
RARE, END, FREQUENT = 0, 1, 2
#: Units whose contexts are counted in one table, at most.
BAND = 4_096
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4_000_000
#: Tokens whose contexts are counted at once, about.
COUNTED = 1_000_000
#: Training tokens for each deal of the vocabulary, about.
DEAL_TOKENS = 8_000_000


CHUNK = "chunk long, doc_ids array<long>, train binary, limits binary, codes binary, words binary, counts binary, tokens long, ends long"


def chunks(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents as numbers of its own words, and how often training has each word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for part in parts(batches, size=CHUNK_BYTES):
            n = part.num_rows
            learn = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            owner, codes, words = tokens(part.column(1), lower=True)
            counts = np.bincount(codes[learn[owner]], minlength=len(words))
            limits = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
            cells = [at, part.column(0).to_pylist(), pack(learn), pack(limits), pack(codes.astype(np.uint32)), packed_words(words), pack(counts), int(counts.sum() + learn.sum()), int(learn.sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in CHUNK.split(", ")])
            at += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), train.cast("boolean").alias("train"))
    return bucketed(rows.mapInArrow(work, CHUNK), "chunk", buckets_for(docs, text_col), "lm-chunks")


SHARED = "chunk long, deal long, places binary, counts binary, units binary, words binary"


def vocabulary(made: DataFrame, total_tokens: int, floor: int) -> DataFrame:
    """For each chunk and deal: its words' places, corpus counts and units.

    Rows without a chunk hold, for each deal, its units' words and counts, which of them
    are to be placed one at a time, and the number of distinct other training words.
    A unit's number here is its deal, shifted, and its number within the deal.
    """
    spark = made.sparkSession
    deals = max(4 * parts_of(spark), -(-total_tokens // DEAL_TOKENS))
    share = max(floor, math.ceil(SHARE * total_tokens))
    most = -(-VOCABULARY // deals)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*batch.columns, strict=True):
                words, counts = unpacked_words(words.as_py()), unpack(counts.as_py(), "<i8")
                to = (word_hashes(words, 3) % np.uint64(deals)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for places in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                    cells = [int(to[places[0]]), chunk.as_py(), packed_words(words.take(pa.array(places))), pack(places), pack(counts[places])]
                    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["deal", "chunk", "words", "places", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in groupby(_dealt(batches), key=lambda r: r[0]):
            _, chunk, words, places, counts = zip(*group, strict=True)
            coded = pa.concat_arrays(words).dictionary_encode()
            code, known = coded.indices.to_numpy(), coded.dictionary
            sums = np.bincount(code, np.concatenate(counts), len(known)).astype(np.int64)
            # Equal counts go by the words' own order, whatever order the chunks come in.
            name = np.empty(len(known), np.int64)
            name[known.to_numpy(zero_copy_only=False).argsort()] = np.arange(len(known))
            often = np.lexsort((name, -sums))[:most]
            often = often[sums[often] >= floor]
            unit = np.full(len(known), RARE)
            unit[often] = FREQUENT + (number << 32) + np.arange(len(often))
            rare = int((sums > 0).sum()) - len(often)
            yield _rows([(None, number, pack(np.flatnonzero(sums[often] >= share)), pack(np.append(sums[often], rare)), b"", packed_words(known.take(pa.array(often))))])
            cuts = np.cumsum([len(w) for w in words])[:-1]
            out = [(c, number, p, pack(sums[x]), pack(unit[x]), None) for c, p, x in zip(chunk, places, np.split(code, cuts), strict=True)]
            for k in range(0, len(out), 64):
                yield _rows(out[k : k + 64])

    dealt = made.select("chunk", "words", "counts").mapInArrow(deal, "deal long, chunk long, words binary, places binary, counts binary")
    by_deal = dealt.repartition(max(parts_of(spark), deals // 16), "deal").sortWithinPartitions("deal", "chunk")
    return written(by_deal.select("deal", "chunk", "words", "places", "counts").mapInArrow(total, SHARED), "lm-vocabulary")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for number, chunk, words, places, counts in zip(*batch.columns, strict=True):
            yield number.as_py(), chunk.as_py(), unpacked_words(words.as_py()), places.as_py(), unpack(counts.as_py(), "<i8")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SHARED.split(", ")])


def with_counts(made: DataFrame, shared: DataFrame) -> DataFrame:
    """The chunks, each with the counts and units of its words."""
    pieces = shared.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("places", "counts", "units")).alias("shares"))
    return written(made.select("chunk", "doc_ids", "train", "limits", "codes").join(pieces, "chunk", "left"), "lm-counted")


def _opened(row: dict, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(training, limits, codes, counts by code, units by code); first: the first unit of each deal."""
    learn, limits, codes = unpack(row["train"], "?"), unpack(row["limits"], "<i8"), unpack(row["codes"], "<u4")
    shares = [(unpack(s["places"], "<i8"), unpack(s["counts"], "<i8"), unpack(s["units"], "<i8")) for s in row["shares"] or []]
    n = sum(len(s[0]) for s in shares)
    counts, units = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for places, c, u in shares:
        counts[places], units[places] = c, u
    own = units >= FREQUENT
    at = units[own] - FREQUENT
    units[own] = first[at >> 32] + (at & 0xFFFFFFFF)
    return learn, limits, codes, counts, units


def bigrams(counted: DataFrame, first: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Counts of pairs of labels, below n, in the training documents, each begun and ended by the end token."""
    band = -(-n // BANDS)
    sent = counted.sparkSession.sparkContext.broadcast((first, label))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, label = sent.value
        table = np.zeros(n * n, np.int64)
        for row in rows(batches):
            learn, limits, codes, _, unit = _opened(row, first)
            flat = np.insert(label[unit][codes].astype(np.int64), limits[1:], label[END])  # the end token after each text
            owner = np.repeat(np.arange(len(learn)), np.diff(limits) + 1)
            before = np.concatenate([label[[END]], flat[:-1]])
            use = learn[owner]
            table += np.bincount(before[use] * n + flat[use], minlength=n * n)
        table = table.reshape(n, n)
        bands = [(k, pack(table[k * band : (k + 1) * band])) for k in range(BANDS)]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in bands], pa.int64()), pa.array([b[1] for b in bands], pa.binary())], ["band", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + unpack(cells, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pack(v) for v in sums.values()], pa.binary())], ["band", "cells"])

    partial = counted.mapInArrow(count, "band long, cells binary")
    out = np.zeros((n, n), np.int64)
    for r in partial.repartition(BANDS, "band").mapInArrow(add, "band long, cells binary").collect():
        part = out[r["band"] * band : (r["band"] + 1) * band]
        part += unpack(r["cells"], "<i8").reshape(part.shape)
    sent.unpersist()
    return out


def neighbours(counted: DataFrame, first: np.ndarray, moving: np.ndarray, size: int) -> tuple[DataFrame, int]:
    """(band of units and, for each of the `size` training tokens of its moving units, the unit within the band and the units before and after; units a band)."""
    spark = counted.sparkSession
    width = min(BAND, max(1, -(-len(moving) // (4 * parts_of(spark)))))
    bands = -(-len(moving) // width)
    salts = max(1, size // (bands * DEAL_TOKENS))
    sent = spark.sparkContext.broadcast((first, moving))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, moving = sent.value
        for row in rows(batches):
            learn, limits, codes, _, unit = _opened(row, first)
            flat = np.insert(unit[codes], limits[1:], END)
            owner = np.repeat(np.arange(len(learn)), np.diff(limits) + 1)
            at = np.flatnonzero(learn[owner] & moving[flat])
            at = at[np.argsort(flat[at], kind="stable")]
            before = np.concatenate([[END], flat])[at]
            cells = np.stack([flat[at] % width, before, flat[np.minimum(at + 1, len(flat) - 1)]]).astype(np.uint32)
            bands = flat[at] // width
            cuts = [0, *(np.flatnonzero(np.diff(bands)) + 1).tolist(), len(at)] if len(at) else [0]
            made = [(int(bands[a]), row["chunk"] % salts, pack(cells[:, a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], ["band", "salt", "piece"])

    # Sorted, so that a reader meets few bands. A band with many tokens is spread over several partitions.
    pieces = counted.mapInArrow(work, "band long, salt long, piece binary").repartition(max(parts_of(spark), bands * salts // 4), "band", "salt")
    return written(pieces.sortWithinPartitions("band").select("band", "piece"), "lm-neighbours"), width


def contexts(cells: np.ndarray, label: np.ndarray, n: int, c: int) -> np.ndarray:
    """(2, units, classes): how often each class stands after and before each unit of a band. cells: units and those before and after."""
    unit, before, after = cells.astype(np.int64)
    return np.stack([np.bincount(unit * c + label[x], minlength=n * c).reshape(n, c) for x in (after, before)])


def better(seen: np.ndarray, now: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class with the largest gain for each unit of a band, now in the classes given; seen: its contexts, m: the class bigrams."""
    out, into = seen.astype(float)
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    size, rows, cols = out.sum(axis=1), m.sum(axis=1), m.sum(axis=0)
    gain = out @ log(m).T + into @ log(m) - size[:, None] * (log(rows) + log(cols))
    # Its own class without the unit's tokens.
    stay = (out * log(m[now] - out)).sum(axis=1) + (into * log(m.T[now] - into)).sum(axis=1) - size * (log(rows[now] - size) + log(cols[now] - size))
    gain[np.arange(len(now)), now] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(now)), best] > stay + 1e-9, best, now)


def moved(near: DataFrame, width: int, classes: np.ndarray, moving: np.ndarray, m: np.ndarray, half: int) -> np.ndarray:
    """The classes after a round in which the moving units of one half move."""
    sent = near.sparkSession.sparkContext.broadcast((classes, m))
    c = len(m)

    def units(band: int, label: np.ndarray) -> int:
        return min(width, len(label) - band * width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, _ = sent.value
        for band, group in groupby(rows(batches), key=lambda r: r["band"]):
            table = np.zeros((2, units(band, label), c), np.int64)
            held, size = [], 0
            for row in group:
                held.append(unpack(row["piece"], "<u4").reshape(3, -1))
                size += held[-1].shape[1]
                if size > COUNTED:
                    table += contexts(np.concatenate(held, axis=1), label, units(band, label), c)
                    held, size = [], 0
            if held:
                table += contexts(np.concatenate(held, axis=1), label, units(band, label), c)
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([pack(np.diff(at, prepend=0).astype(np.uint32))]), pa.array([pack(table.ravel()[at].astype(np.uint64))])], ["band", "at", "counts"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, m = sent.value
        for band, group in groupby(rows(batches), key=lambda r: r["band"]):
            table = np.zeros(2 * units(band, label) * c, np.int64)
            for row in group:
                table[np.cumsum(unpack(row["at"], "<u4").astype(np.int64))] += unpack(row["counts"], "<u8").astype(np.int64)
            now = label[band * width :][: units(band, label)].astype(np.int64)
            new = better(table.reshape(2, -1, c), now, m)
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([pack(new.astype(np.uint16))], pa.binary())], ["band", "classes"])

    counts = near.mapInArrow(count, "band long, at binary, counts binary").repartition(parts_of(near.sparkSession), "band").sortWithinPartitions("band")
    out = classes.copy()
    for r in counts.mapInArrow(decide, "band long, classes binary").toLocalIterator():
        new = unpack(r["classes"], "<u2")
        at = r["band"] * width + np.arange(len(new))
        go = moving[at] & (at % 2 == half)
        out[at[go]] = new[go]
    sent.unpersist()
    return out


def likelihood(m: np.ndarray) -> float:
    """That of class bigrams m, without what no class changes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))


def cluster(counted: DataFrame, first: np.ndarray, seed: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each unit, class bigrams). seed: whether a unit is placed one at a time; mass: its tokens."""
    n = max(CLASSES, math.ceil(CLASS_GROWTH * len(seed) ** (1 / 3)))
    moving = ~seed
    seeds = int(seed.sum())
    # To them all other units are one more.
    label = np.full(len(seed), seeds, np.uint16)
    label[seed] = np.arange(seeds)
    placed = exchange(bigrams(counted, first, label, seeds + bool(moving.any())), min(n, seeds), SWEEPS)[:seeds]
    classes = np.zeros(len(seed), np.uint16)
    classes[seed] = placed
    if not moving.any():
        return classes, bigrams(counted, first, classes, int(placed.max()) + 1)
    # The others start dealt over all classes by their counts.
    order = np.flatnonzero(moving)
    order = order[np.argsort(-mass[order], kind="stable")]
    classes[order] = np.arange(len(order)) % n
    m = bigrams(counted, first, classes, n)
    near, width = neighbours(counted, first, moving, int(mass[moving].sum()))
    best = (likelihood(m), classes, m)
    for k in range(ROUNDS):
        after = moved(near, width, classes, moving, m, k % 2)
        classes, m = after, bigrams(counted, first, after, n)
        best = max(best, (likelihood(m), classes, m), key=lambda x: x[0])
    return best[1:]


def exchange(table: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit; units change places while the class bigrams' likelihood grows."""
    n = len(table)
    f = lambda x: x * np.log(np.maximum(x, 1))
    total = table.sum(axis=0)
    order = np.argsort(-total, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    member = np.zeros((n, classes), np.int64)
    member[np.arange(n), of] = 1
    after, before = table @ member, table.T @ member  # by unit and class
    m = member.T @ after
    rows, cols = m.sum(axis=1), m.sum(axis=0)
    r, c = table.sum(axis=1), total
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            k, own = of[u], table[u, u]
            out, into = after[u].copy(), before[u].copy()
            out[k] -= own
            into[k] -= own
            m[k] -= out
            m[:, k] -= into
            m[k, k] -= own
            rows[k] -= r[u]
            cols[k] -= c[u]
            # Gain of class j: its row and column, with the cell where they cross.
            gain = (f(m + out) - f(m)).sum(axis=1) + (f(m + into[:, None]) - f(m)).sum(axis=0)
            d = np.diagonal(m)
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(rows + r[u]) - f(rows) + f(cols + c[u]) - f(cols)
            j = int(gain.argmax())
            if gain[j] <= gain[k] + 1e-9:
                j = k
            m[j] += out
            m[:, j] += into
            m[j, j] += own
            rows[j] += r[u]
            cols[j] += c[u]
            if j != k:
                of[u] = j
                moved += 1
                after[:, k] -= table[:, u]
                after[:, j] += table[:, u]
                before[:, k] -= table[u]
                before[:, j] += table[u]
        if not moved:
            break
    return of


@dataclass
class Model:
    tokens: int
    distinct: int
    ends: int
    #: The first unit of each deal, and the class of each unit.
    first: np.ndarray
    classes: np.ndarray
    #: Probability of class after class; by class its distinct words, tokens, and whether rare and unknown words belong to it.
    step: np.ndarray
    kinds: np.ndarray
    mass: np.ndarray
    unknown: np.ndarray

    def words(self, counts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, probability in the class, probability by itself) of words with these counts and units."""
        of = self.classes[units]
        base = (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        return of, (counts + 0.5) / (self.mass[of] + 0.5 * (self.kinds[of] + self.unknown[of])), base


def fit(counted: DataFrame, shared: DataFrame, tokens: int, ends: int) -> Model:
    heads = {}
    for h in shared.where("chunk IS NULL").select("deal", "places", "counts").toLocalIterator():
        heads[h["deal"]] = unpack(h["places"], "<i8"), unpack(h["counts"], "<i8")
    first = np.full(max(heads, default=0) + 1, FREQUENT)
    seed, mass, at, rare = [np.ones(FREQUENT, bool)], [np.zeros(FREQUENT, np.int64)], FREQUENT, 0
    for deal, (often, counts) in sorted(heads.items()):
        first[deal] = at
        own = np.zeros(len(counts) - 1, bool)
        own[often] = True
        seed.append(own)
        mass.append(counts[:-1])
        at, rare = at + len(own), rare + int(counts[-1])
    seed, mass = np.concatenate(seed), np.concatenate(mass)
    kinds = np.ones(len(seed), np.int64)
    kinds[RARE] = rare
    classes, m = cluster(counted, first, seed, mass)
    n = len(m)
    share = (m.sum(axis=0) + 1) / (m.sum() + n)
    step = (m + PRIOR * share) / (m.sum(axis=1, keepdims=True) + PRIOR)
    unknown = np.arange(n) == classes[RARE]
    distinct = int(kinds.sum()) - (ends == 0)
    return Model(tokens, distinct, ends, first, classes, step, np.bincount(classes, kinds, n), m.sum(axis=0), unknown)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def train_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", floor: int = FLOOR) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the chunks it scores, and the vocabulary."""
    made = chunks(docs, train, id_col, text_col)
    tokens, ends = made.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    shared = vocabulary(made, tokens, floor)
    counted = with_counts(made, shared)
    return fit(counted, shared, tokens, ends), counted, shared


def word_classes(model: Model, shared: DataFrame) -> DataFrame:
    """word, count and class of every word that is a unit of its own."""
    sent = shared.sparkSession.sparkContext.broadcast((model.first, model.classes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, classes = sent.value
        for row in rows(batches):
            words = unpacked_words(row["words"])
            n = len(words)
            cols = [words, unpack(row["counts"], "<i8")[:-1], classes[first[row["deal"]] :][:n].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([cols[0].cast(pa.string()), pa.array(cols[1]), pa.array(cols[2])], ["word", "count", "class"])

    return shared.where("chunk IS NULL").select("deal", "counts", "words").mapInArrow(work, "word string, count long, class long")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mix: float = MIX, floor: int = FLOOR) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score, both log10 probabilities."""
    model, counted, _ = train_model(docs, train, id_col, text_col, floor)
    return scores(model, counted, mix)


def scores(model: Model, counted: DataFrame, mix: float = MIX) -> DataFrame:
    sent = counted.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for row in rows(batches):
            _, limits, codes, counts, units = _opened(row, m.first)
            n = len(limits) - 1
            # The end token comes last among the words.
            counts, units = np.append(counts, m.ends), np.append(units, END)
            flat = np.insert(codes.astype(np.int64), limits[1:], len(counts) - 1)
            owner = np.repeat(np.arange(n), np.diff(limits) + 1)
            of, word, base = m.words(counts, units)
            now = of[flat]
            before = np.concatenate([[m.classes[END]], now[:-1]])
            p = mix * m.step[before, now] * word[flat] + (1 - mix) * base[flat]
            sums = [np.diff(limits) + 1, np.bincount(owner, counts[flat] > 0, n).astype(np.int64), np.bincount(owner, np.log10(base)[flat], n), np.bincount(owner, np.log10(p), n)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, sums)], [x.split()[0] for x in SCORES.split(", ")])

    return counted.mapInArrow(work, SCORES).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
