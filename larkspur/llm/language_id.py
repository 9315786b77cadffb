"""Language identification by interpolated Kneser-Ney character models (operator 3).

Each language has a character model over words, from the word's beginning to its
end, trained on a bounded sample of labelled rows. All models lie in one set of
sorted arrays of n-gram hashes, with a log probability and a back-off weight per
language; an n-gram that one language never showed holds its backed-off value there.
The language of the lowest cross-entropy per character is chosen. A text is rejected
where even that exceeds a limit taken from labelled texts kept out of training.

Defined cases: null text and text without a letter are `und` with score 0 and
rejected; rows without lang train nothing; without any labelled row every text is
`und`; ids play no part, so null and repeated ones train like any; equal texts of a
language train once and are predicted alike; an empty table gives an empty result;
other columns are kept by `accepted` and not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .words import Memo, parts, split

UNDETERMINED = "und"
NOT_LETTERS = r"[^\p{L}]+"
ORDER = 5
#: The training sample: so many different texts a language, those with the least hashes.
SAMPLE_ROWS = 500
#: Languages that are learned, those with the most labelled rows; what else a dirty column names is not.
LANGUAGES = 200
#: Characters of the whole sample. A text above its share trains with a stretch of it from a hashed place.
SAMPLE_CHARS = 100_000_000
#: Every so manyth row of the sample calibrates the limit instead of training.
CALIBRATION = 5
#: The limit lies this much above the labelled texts' highest usual cross-entropy.
MARGIN = 1.5
#: Texts with fewer letters are too short to be rejected for their cross-entropy.
LEAST_LETTERS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stream(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two spaces, and the place of each in its word."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return points, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place."""
    out = np.zeros(len(points), np.uint64)
    p = points.astype(np.uint64) + np.uint64(1)
    for k in range(n):
        out[k:] += p[: max(len(p) - k, 0)] * _STEP ** np.uint64(k + 1)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Models:
    languages: list[str]
    #: By n - 1: sorted hashes, and for each language log probabilities and back-off weights.
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    backs: list[np.ndarray] = field(default_factory=list)
    unknown: np.ndarray | None = None
    limit: float = math.inf

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word's letters and end, by language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        points, place = _stream(words)
        out = np.zeros((len(points), len(self.languages)))
        todo = np.flatnonzero(place > 0)
        hashes = [_hashes(points, n) for n in range(1, ORDER + 1)]
        for n in range(ORDER, 0, -1):
            now = todo[place[todo] >= n - 1]
            at, hit = self._find(n, hashes[n - 1][now])
            out[now[hit]] += self.logs[n - 1][at[hit]]
            miss = now[~hit]
            if n > 1:  # weight of the context that is given up
                at, known = self._find(n - 1, hashes[n - 2][miss - 1])
                out[miss[known]] += self.backs[n - 2][at[known]]
            else:
                out[miss] += self.unknown
            left = np.zeros(len(points), bool)
            left[todo] = True
            left[now[hit]] = False
            todo = np.flatnonzero(left)
        ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
        return np.diff(np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0)])[np.append(0, ends)], axis=0)


def train(samples: dict[str, tuple[list[str], np.ndarray]]) -> Models:
    """samples: for each language its distinct words and their counts."""
    models = Models(sorted(samples))
    grams: list[dict] = []
    for language in models.languages:
        words, counts = samples[language]
        points, place = _stream(words)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        weight = np.repeat(counts, sizes)
        levels = []
        for n in range(1, ORDER + 1):
            here = np.flatnonzero((place >= n - 1) & (place > 0))
            h = _hashes(points, n)[here]
            context = _hashes(points, n - 1)[here - 1] if n > 1 else np.zeros(len(here), np.uint64)
            shorter = _hashes(points, n - 1)[here] if n > 1 else np.zeros(len(here), np.uint64)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            starts = place[here][first] == n - 1  # what begins the word has no longer form
            levels.append({"keys": keys, "context": context[first], "shorter": shorter[first], "count": np.bincount(inverse, weight[here], len(keys)), "starts": starts})
        for n in range(ORDER - 1, 0, -1):  # below the top, the number of different letters before it
            low, high = levels[n - 1], levels[n]
            before = np.bincount(np.searchsorted(low["keys"], high["shorter"]), minlength=len(low["keys"]))
            low["count"] = np.where(low["starts"] & (n > 1), low["count"], np.maximum(before, 1))
        grams.append(levels)
    alphabet = len(np.unique(np.concatenate([g[0]["keys"] for g in grams]))) + 1
    below: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([g[n - 1]["keys"] for g in grams]))
        # Any language's gram of these keys: its context and its shorter form.
        context, shorter = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for g in grams:
            at = np.searchsorted(keys, g[n - 1]["keys"])
            context[at], shorter[at] = g[n - 1]["context"], g[n - 1]["shorter"]
        logs = np.zeros((len(keys), len(grams)))
        for k, g in enumerate(grams):
            level = g[n - 1]
            c = level["count"]
            if not len(c):  # words too short for this order
                prior_keys, prior_logs = below[-1]
                logs[:, k] = prior_logs[np.searchsorted(prior_keys, shorter), k]
                continue
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            groups, of = np.unique(level["context"], return_inverse=True)
            total = np.bincount(of, c)
            kinds = np.bincount(of)
            rest = d * kinds / total
            own = np.maximum(c - d, 0) / total[of]
            if n == 1:
                lower = np.full(len(keys), 1 / alphabet)
                weight = np.full(len(keys), rest[0])
                if k == 0:
                    models.unknown = np.zeros(len(grams))
                models.unknown[k] = math.log(rest[0] / alphabet)
            else:
                prior_keys, prior_logs = below[-1]
                lower = np.exp(prior_logs[np.searchsorted(prior_keys, shorter), k])
                at = np.minimum(np.searchsorted(groups, context), len(groups) - 1)
                weight = np.where(groups[at] == context, rest[at], 1.0)
                # The weight is kept with the context, one level below.
                spot = np.minimum(np.searchsorted(prior_keys, groups), len(prior_keys) - 1)
                same = prior_keys[spot] == groups
                models.backs[n - 2][spot[same], k] = np.log(rest[same])
            p = weight * lower
            p[np.searchsorted(keys, level["keys"])] += own
            logs[:, k] = np.log(p)
        models.keys.append(keys)
        models.logs.append(logs)
        models.backs.append(np.zeros((len(keys), len(grams))))
        below.append((keys, logs))
    return models


def scores(models: Models, memo: Memo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy by language, number of letters, of each text; and the posterior of the best."""
    owner, codes, words = split(pc.utf8_lower(texts.cast(pa.large_string())), NOT_LETTERS)
    n, kinds = len(texts), len(models.languages)
    table = memo(words)
    sums = np.stack([np.bincount(owner, table[codes, k], n) for k in range(kinds)], axis=1)
    letters = np.bincount(owner, table[codes, kinds], n)
    count = np.bincount(owner, minlength=n)
    entropy = -sums / np.maximum(letters + count, 1)[:, None]
    # Neighbouring characters aren't independent: a long text isn't certain without end.
    gain = -entropy * np.minimum(letters + count, 60)[:, None]
    e = np.exp(gain - gain.max(axis=1, keepdims=True))
    return entropy, letters, e.max(axis=1) / e.sum(axis=1)


def _memo(models: Models) -> Memo:
    def make(words: pa.Array) -> np.ndarray:
        plain = words.to_pylist()
        out = [np.column_stack([models.word_logs(part), [len(w) for w in part]]) for at in range(0, len(plain), 50_000) if (part := plain[at : at + 50_000])]
        return np.concatenate(out) if out else np.zeros((0, len(models.languages) + 1))

    return Memo(make)


def _sample(rows: DataFrame, languages: list[str]) -> pa.Table:
    """text and lang of SAMPLE_ROWS different texts of each language at most, in the order of their hashes.

    Each task passes on its least hashes of a language alone; the texts of those that remain are then fetched
    by their hashes, each once, so neither one language nor one repeated text fills a task or the driver.
    """
    hashed = rows.where(F.col("lang").isin(*languages)).withColumn("h", F.xxhash64(F.lit("language"), "text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            h, code = batch.column("h").to_numpy(zero_copy_only=False), codes.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                held[lang] = np.union1d(held.get(lang, h[:0]), h[code == i])[:SAMPLE_ROWS]
        names = [lang for lang, h in held.items() for _ in h]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*held.values(), np.zeros(0, np.int64)]).astype(np.int64))], ["lang", "h"])

    kept = hashed.select("lang", "h").mapInArrow(least, "lang string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # at most SAMPLE_ROWS hashes for each of at most LANGUAGES languages
    chosen = kept.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).select("lang", "h")
    size = max(1, SAMPLE_CHARS // (SAMPLE_ROWS * len(languages)))
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - size + 1, F.lit(1))).cast("int") + 1
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.substring("text", start, F.lit(size)).alias("text"))
    return texts.groupBy("lang", "h").agg(F.min("text").alias("text")).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")]).select(["text", "lang"])


def fit(docs: DataFrame, rows: Column, text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Learn from a sample of the rows where `rows` holds; None if none has a language."""
    usable = docs.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    often = usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    if not sizes:
        return None
    taken = _sample(usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), sorted(sizes))
    spare = np.arange(taken.num_rows) % CALIBRATION == 0
    learn = taken.filter(pa.array(~spare)) if (~spare).any() else taken
    samples = {}
    for language in set(learn["lang"].to_pylist()):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in learn.filter(pc.equal(learn["lang"], language))["text"].chunks])
        _, codes, words = split(pc.utf8_lower(texts), NOT_LETTERS)
        if len(codes):
            counts = np.bincount(codes, minlength=len(words))
            used = counts > 0
            samples[language] = (words.filter(pa.array(used)).to_pylist(), counts[used])
    if not samples:
        return None
    models = train(samples)
    kept = taken.filter(pa.array(spare)) if (~spare).any() else taken
    entropy, letters, _ = scores(models, _memo(models), pa.concat_arrays([c.cast(pa.large_string()) for c in kept["text"].chunks]))
    usual = entropy.min(axis=1)[letters >= LEAST_LETTERS]
    models.limit = MARGIN * float(np.quantile(usual, 0.999)) if len(usual) else math.inf
    return models


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character) and rejected."""
    names = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        memo = _memo(models) if models else None
        for batch in parts(batches):
            n = batch.num_rows
            if models is None:
                best, score, low, lost = [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            else:
                entropy, letters, score = scores(models, memo, batch.column(1))
                low, none = entropy.min(axis=1), letters == 0
                best = [UNDETERMINED if no else models.languages[k] for k, no in zip(entropy.argmin(axis=1).tolist(), none, strict=True)]
                score = np.where(none, 0.0, score)
                lost = none | ((low > models.limit) & (letters >= LEAST_LETTERS))
                low = np.where(none, np.nan, low)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score), pa.array(low), pa.array(lost)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, names)


def accepted(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is recognised, all columns as they were; without models all that hold a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        memo = _memo(models) if models else None
        for batch in batches:
            if models is None:
                yield batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(at), r"\p{L}"), False))
                continue
            for part in parts(iter([batch.set_column(at, batch.schema.names[at], pc.fill_null(batch.column(at), ""))]), at):
                entropy, letters, _ = scores(models, memo, part.column(at))
                good = (letters > 0) & ((entropy.min(axis=1) <= models.limit) | (letters < LEAST_LETTERS))
                yield part.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
