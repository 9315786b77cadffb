"""Toxic spans by a linear-chain conditional random field (operator 4).

Labels say which documents are toxic, not which words. In a bounded sample of
labelled documents, a word whose presence goes with the label beyond chance marks its
tokens in toxic documents; these labelled tokens train a two-label chain over
sentences, with a weight for each word and for each pair of labels. Forward-backward
marginals give each token its probability; a document's score is a logistic function
of their sum and their maximum, fitted on the same sample, and the tokens above one
half are its offending spans.

A sentence ends at a token that ends in . ! or ?; one longer than SEQUENCE tokens
goes on as the next sequence. Tokens are what stands between white space, without
case and outer punctuation.

Defined cases: null and empty texts have no token and get the score of a text whose
marginals are zero; labels that are null or for unknown ids train nothing; without
both kinds of labels every score is 0; an id with several rows trains with its
different texts, up to the sample's bound; repeated rows are scored alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .words import Memo, parts, tokens

#: The training sample: ids of each label, by a hash of doc_id; of the texts of these, BOUND times as many by their own hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3000
BOUND = 2
#: A longer text trains with a stretch of so many characters from a hashed place.
SAMPLE_CHARS = 20_000
#: A marked word: likelihood-ratio statistic, and how much more often toxic documents have it.
EVIDENCE, RATIO = 24.0, 3.0
SEQUENCE = 128
ROUNDS = 60
PIECE = re.compile(r"[^\x20\x09-\x0D]+")


def normal(piece: str) -> str:
    return piece.lower().strip("".join(c for c in set(piece) if not c.isalnum()))


@dataclass
class Field:
    """weights: by word, the log odds of the label toxic; trans: 2 x 2; start: the first label's log odds."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: float
    #: Of the document's score: constant, slopes of log(1 + 10 sum) and of the maximum.
    doc: np.ndarray


def sequences(ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each sequence of a row of tokens. ends: the sentence ends here; owner: the text."""
    n = len(ends)
    first = np.ones(n, bool)
    first[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    starts = np.flatnonzero(place % SEQUENCE == 0)
    return starts, np.diff(np.append(starts, n))


def _log1pexp(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def marginals(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: float, pairs: bool = False):
    """P(toxic) of each token by forward-backward over all sequences at once; with pairs, expected label pairs too.

    Messages are kept as log odds of the two labels.
    """
    n = len(emit)
    ahead, back = np.empty(n), np.zeros(n)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    up = lambda r: np.logaddexp(trans[0, 1], r + trans[1, 1]) - np.logaddexp(trans[0, 0], r + trans[1, 0])
    down = lambda r: np.logaddexp(trans[1, 0], r + trans[1, 1]) - np.logaddexp(trans[0, 0], r + trans[0, 1])
    for t in range(longest):
        at = starts[: alive[t]] + t
        ahead[at] = emit[at] + (start if t == 0 else up(ahead[at - 1]))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        back[at] = down(back[at + 1] + emit[at + 1])
    p = 1 / (1 + np.exp(-(ahead + back)))
    if not pairs:
        return p
    first = np.zeros(n, bool)
    first[starts] = True
    b = np.flatnonzero(~first)
    a = b - 1
    joint = np.stack([np.zeros(len(a)) + trans[0, 0], trans[0, 1] + emit[b] + back[b], trans[1, 0] + ahead[a], trans[1, 1] + ahead[a] + emit[b] + back[b]])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    return p, joint.sum(axis=1).reshape(2, 2), first


def marked_words(owner: np.ndarray, words: np.ndarray, n_words: int, toxic: np.ndarray) -> np.ndarray:
    """Which words go with the label: by documents that hold them.

    Documents of a group of copies aren't independent: a word counts for no more toxic
    documents than it has different words before its first place in them.
    """
    pair, first = np.unique(owner.astype(np.int64) * n_words + words, return_index=True)
    doc, word = pair // n_words, pair % n_words
    na, nb = toxic.sum(), (~toxic).sum()
    bad = first[toxic[doc]]
    before = np.where((bad > 0) & (owner[bad - 1] == owner[bad]), words[bad - 1], n_words)
    contexts = np.unique(words[bad].astype(np.int64) * (n_words + 1) + before) // (n_words + 1)
    a = np.bincount(contexts, minlength=n_words).astype(float)
    b = np.bincount(word[~toxic[doc]], minlength=n_words).astype(float)
    rate = (a + b) / (na + nb)

    def part(x: np.ndarray, n: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (n * rate)), 0) + np.where(n - x > 0, (n - x) * np.log((n - x) / np.maximum(n * (1 - rate), 1e-12)), 0)

    return (2 * (part(a, na) + part(b, nb)) >= EVIDENCE) & ((a + 0.5) / (na + 1) >= RATIO * (b + 0.5) / (nb + 1))


def train(texts: pa.Array, toxic: np.ndarray) -> Field:
    owner, codes, pieces = tokens(texts)
    plain = pieces.to_pylist()
    number: dict[str, int] = {}
    word_of = np.array([number.setdefault(normal(p), len(number)) for p in plain], np.int64)
    ends_of = np.array([p[-1:] in ".!?" and p != "" for p in plain], bool)
    words, ends = word_of[codes], ends_of[codes]
    marked = marked_words(owner, words, len(number), toxic)
    label = (marked[words] & toxic[owner]).astype(float)
    starts, sizes = sequences(ends, owner)
    # Gradient ascent (Adam) of the labels' log likelihood; rare words share the bias.
    uses = np.bincount(words, minlength=len(number))
    own = (uses >= 3) | marked
    theta = np.zeros(len(number) + 6)  # words, bias, start, four label pairs
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    base = max(label.mean(), 1e-6)
    theta[-6] = np.log(base / (1 - base))
    seen = np.bincount(words, label, len(number))
    first_label = None
    for k in range(1, ROUNDS + 1):
        trans = theta[-4:].reshape(2, 2)
        p, joint, first = marginals(theta[words] * own[words] + theta[-6], starts, sizes, trans, theta[-5], True)
        if first_label is None:
            first_label = label[first].sum()
            b = np.flatnonzero(~first)
            have = np.bincount((2 * label[b - 1] + label[b]).astype(int), minlength=4)
        grad = np.zeros_like(theta)
        grad[: len(number)] = (seen - np.bincount(words, p, len(number))) * own
        grad[-6] = label.sum() - p.sum()
        grad[-5] = first_label - p[first].sum()
        grad[-4:] = have - joint.ravel()
        grad -= 0.05 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.3 / (1 + 0.03 * k) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    names = list(number)
    weights = {names[i]: float(theta[i]) for i in np.flatnonzero(own & (np.abs(theta[: len(number)]) > 1e-3))}
    out = Field(weights, float(theta[-6]), theta[-4:].reshape(2, 2).copy(), float(theta[-5]), np.zeros(3))
    p = marginals(theta[words] * own[words] + theta[-6], starts, sizes, out.trans, out.start)
    x = features(owner, p, len(toxic))
    y = toxic.astype(float)
    for _ in range(25):  # Newton steps with a small penalty
        q = 1 / (1 + np.exp(-(x @ out.doc)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3)
        out.doc += np.linalg.solve(h, x.T @ (y - q) - 0.5 * out.doc)
    return out


def features(owner: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    return np.column_stack([np.ones(n), np.log1p(10 * np.bincount(owner, p, n)), top])


def fit(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field | None:
    """Learn from a sample of labelled rows where `rows`, over labels, holds; None without both labels."""
    usable = labels.where(rows & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    sizes = {r[0]: r[1] for r in usable.groupBy("__label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    point = F.pmod(F.xxhash64(F.lit("toxic"), F.col("__id")), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("__label") == 1, min(1.0, SAMPLE_TOXIC / sizes[1])).otherwise(min(1.0, SAMPLE_CLEAN / sizes[0]))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows are expected: small enough to broadcast.
    chosen = usable.where((point < share) & F.col("__label").isin(0, 1))
    text = text_of(text_col)
    hashed = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), F.xxhash64(F.lit("text"), F.col(id_col), text).alias("__h"))
    start = F.pmod(F.col("__h"), F.greatest(F.char_length("__text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    # an id may have many rows: equal ones count once, and no more are collected than the bound
    found = hashed.join(F.broadcast(chosen), "__id").select("__id", "__label", "__h", F.substring("__text", start, F.lit(SAMPLE_CHARS)).alias("__text"))
    found = written(found.groupBy("__id", "__label", "__h").agg(F.min("__text").alias("__text")), "toxicity-sample")
    top = [found.where(F.col("__label") == label).orderBy("__h", "__id").limit(BOUND * most) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    taken = top[0].unionByName(top[1]).toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])
    toxic = taken["__label"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    return train(pa.concat_arrays([c.cast(pa.large_string()) for c in taken["__text"].chunks]), toxic)


def _memo(field: Field) -> Memo:
    def make(pieces: pa.Array) -> np.ndarray:
        plain = pieces.to_pylist()
        get = field.weights.get
        return np.array([(get(normal(p), 0.0) + field.bias, p[-1:] in ".!?" and p != "") for p in plain], float).reshape(-1, 2)

    return Memo(make)


SCORES = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the offending spans, as character offsets in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        memo = _memo(field) if field else None
        for part in parts(batches):
            n = part.num_rows
            score, spans = np.zeros(n), [[]] * n
            if field:
                owner, codes, pieces = tokens(part.column(1))
                table = memo(pieces)
                starts, sizes = sequences(table[codes, 1] > 0, owner)
                p = marginals(table[codes, 0], starts, sizes, field.trans, field.start)
                score = 1 / (1 + np.exp(-(features(owner, p, n) @ field.doc)))
                begin = np.searchsorted(owner, np.arange(n + 1))
                hits: dict[int, list[int]] = {}
                for i in np.flatnonzero(p > 0.5).tolist():
                    hits.setdefault(int(owner[i]), []).append(i)
                for doc, found in hits.items():
                    places = [m.span() for m in PIECE.finditer(part.column(1)[doc].as_py())]
                    spans[doc] = [(*places[i - begin[doc]], float(p[i])) for i in found]
            rows = [[{"start": a, "end": b, "score": s} for a, b, s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(rows, kind)], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, SCORES)
