"""Distinct words of a batch of texts, and what is known about each, held between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BATCH_BYTES = 8_000_000
#: Words a Python worker remembers between batches before it starts anew; changes no result.
MEMO = 500_000


def parts(batches: Iterator[pa.RecordBatch], text: int = 1, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `size` bytes of text each, BATCH_BYTES if not given; a longer text is a part of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // (size or BATCH_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                # A copy: Arrow's lower-case functions go wrong on slices.
                yield batch.take(pa.array(np.arange(a, b)))


def split(texts: pa.Array, not_word: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, its number among the distinct ones, the distinct words).

    not_word: a regular expression of what stands between words. Empty words are left out.
    """
    flat = pc.split_pattern_regex(texts.cast(pa.large_string()), not_word)
    limits = flat.offsets.to_numpy()[: len(texts) + 1] - flat.offsets[0].as_py()
    words = flat.flatten().dictionary_encode()
    codes = words.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(limits))
    full = (pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.empty(0, bool)
    return owner[full], codes[full], words.dictionary


def tokens(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same for words [^\\x20\\x09-\\x0D]+; lower: with A-Z in lower case. All of the words listed are used."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    limits = cut.offsets.to_numpy()[: n + 1] - cut.offsets[0].as_py()
    coded = cut.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    owner = np.repeat(np.arange(n), np.diff(limits))
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # an empty word before or behind white space
        use = full[codes]
        owner, codes = owner[use], (np.cumsum(full) - 1)[codes[use]]
        words = words.filter(pa.array(full))
    return owner, codes, words


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of the batches, one at a time in Python."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, kind: str | type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def joined(words: pa.Array, limits: np.ndarray) -> pa.Array:
    """For each stretch of words between limits, the words with a space between them."""
    lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), words.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def packed_words(words: pa.Array) -> bytes:
    """Words without white space, as one piece of bytes."""
    whole = joined(words, np.array([0, len(words)]))
    return zstandard.ZstdCompressor(level=1).compress(whole.buffers()[2] or b"")


def unpacked_words(b: bytes) -> pa.Array:
    text = zstandard.ZstdDecompressor().decompress(b)
    if not text:
        return pa.array([], pa.large_string())
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    return pc.split_pattern(one, " ").flatten()


def word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number for each word: a sum over its bytes of a byte's own number times a power that goes with its place."""
    words = words.cast(pa.large_string())
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    table = np.random.default_rng(seed).integers(1, 1 << 64, 257, np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, table[256] | np.uint64(1), np.uint64))
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * powers[place], dtype=np.uint64)])[offsets - offsets[0]]
    h = np.diff(ends) + powers[sizes]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Memo:
    """A row of numbers for each word; `make` gives the rows of new words."""

    def __init__(self, make: Callable[[pa.Array], np.ndarray]):
        self.make = make
        self.known = pa.array([], pa.large_string())
        self.rows: np.ndarray | None = None

    def __call__(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known, self.rows = words.slice(0, 0), None
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.known) + np.arange(new.sum())
        if new.any() or self.rows is None:
            fresh = words.filter(pa.array(new))
            made = self.make(fresh)
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
            self.known = pa.concat_arrays([self.known, fresh])
        return self.rows[place]
