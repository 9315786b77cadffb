"""Token ids of whole texts from the tokenizers library, each distinct piece encoded once a batch.

A byte-level BPE never joins what lies on both sides of the space between two
words, so a text may be cut before any space that follows a visible character
without changing its ids. Arrow cuts a batch and lists its distinct pieces, the
library encodes those it has not met, and a text's ids are its pieces' ids in a row. A batch's
memory is bounded by its bytes; batches are cut into parts of some megabytes of text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import parts

#: Text encoded at once: the more, the fewer pieces are looked up again.
PART_BYTES = 12_000_000
#: Strings a Python worker remembers between batches before it starts anew; changes no result.
MEMO = 800_000
#: Words handed to the library at once.
CALL = 20_000

_VISIBLE = "!-~¡-˿"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNSAFE = f"[^{_VISIBLE}] "
_SAFE_CUT = re.compile(f"(?<=[{_VISIBLE}]) ")
#: Letters, marks behind them, at most one line end, letters: the library's own
#: splitting always parts these, whatever stands around them.
_SIMPLE = f"^(?P<a>[{_LETTERS}]+)(?:(?P<b>[.,;:!?]+)(?P<n>\n?)(?P<c>[{_LETTERS}]*))?$"


class Encoder:
    """encode(texts) -> all ids in a row, and where each text's begin and end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        #: The same model without splitting, for strings that are one word.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The same for words already spelt as the model spells bytes.
        self.spelt = Tokenizer(self.library.model)
        self.vocabulary = self.library.get_vocab_size()
        self.known = pa.array([], pa.large_string())
        self.pool, self.starts, self.counts = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 256) for e in self.library.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]

    def _single(self, words: pa.Array, at: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """ids of strings that are one word each, and where in a pool of `at` ids they will begin and how many they are."""
        starts, counts, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), []
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for mask, coder in ((ascii_, self.spelt), (~ascii_, self.words)):
            where = np.flatnonzero(mask)
            chosen = words.take(pa.array(where))
            if coder is self.spelt:  # how the model spells a space and a line end; other ASCII marks stand for themselves
                chosen = pc.replace_substring(pc.replace_substring(chosen, " ", "\u0120"), "\n", "\u010a")
            for k in range(0, len(chosen), CALL):
                part = chosen.slice(k, CALL).to_pylist()
                found = coder.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
                own = where[k : k + CALL]
                ids.append(np.asarray(found.ids, "<u4"))
                counts[own] = np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(part))
                starts[own] = at + np.cumsum(counts[own]) - counts[own]
                at += len(ids[-1])
        return ids, starts, counts

    def _looked_up(self, strings: pa.Array, single: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each string's begin and how many they are; the first `single` are one word each."""
        if len(self.known) > MEMO:
            self.known, self.pool, self.starts, self.counts = strings.slice(0, 0), self.pool[:0], self.starts[:0], self.counts[:0]
        at = pc.index_in(strings, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.known) + np.arange(new.sum())
        fresh = strings.filter(pa.array(new))
        words = int(new[:single].sum())
        ids, starts, counts = self._single(fresh.slice(0, words), len(self.pool))
        more = self._whole(fresh.slice(words).to_pylist())
        rest = np.fromiter(map(len, more), np.int64, len(more))
        at = len(self.pool) + sum(map(len, ids))
        self.starts = np.concatenate([self.starts, starts, at + np.cumsum(rest) - rest])
        self.counts = np.concatenate([self.counts, counts, rest])
        self.pool = np.concatenate([self.pool, *ids, np.fromiter((i for x in more for i in x), "<u4")])
        self.known = pa.concat_arrays([self.known, fresh])
        return self.pool, self.starts[place], self.counts[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        n = len(texts)
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        if odd.any():  # a space after anything else (white space above all) is no place to cut
            cut = pa.array([_SAFE_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd, strict=True)], pa.large_list(pa.large_string()))
        else:
            cut = pc.split_pattern(texts, " ")
        limits = cut.offsets.to_numpy()[: n + 1] - cut.offsets[0].as_py()
        flat = cut.flatten().dictionary_encode()
        pieces, codes = flat.dictionary, flat.indices.to_numpy()
        # A piece is up to four parts: rows of `parts`, -1 for none.
        m = pc.extract_regex(pieces, _SIMPLE)
        simple = m.is_valid().to_numpy(zero_copy_only=False)
        fields = [pc.struct_field(m, f).fill_null("") for f in "abnc"]
        fields[0] = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), fields[0], pa.scalar("", pa.large_string()))
        used = [simple, *((pc.binary_length(f).to_numpy(zero_copy_only=False) > 0) for f in fields[1:])]
        words = pa.concat_arrays([f.filter(pa.array(u)) for f, u in zip(fields, used, strict=True)]).dictionary_encode()
        parts = np.full((len(pieces) + n, 4), -1, np.int32)
        at, word = 0, words.indices.to_numpy()
        for k, u in enumerate(used):
            where = np.flatnonzero(u)
            parts[where, k] = word[at : at + len(where)]
            at += len(where)
        # What is not so simple, and the first piece of each text, which has no space before it.
        rest = np.flatnonzero(~simple)
        odd_pieces = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces.take(pa.array(rest)), pa.scalar("", pa.large_string()))
        heads = pieces.take(pa.array(codes[limits[:-1]]))
        done = len(words.dictionary)
        parts[rest, 0] = done + np.arange(len(rest))
        parts[len(pieces) :, 0] = done + len(rest) + np.arange(n)
        codes = codes.copy()
        codes[limits[:-1]] = len(pieces) + np.arange(n)
        pool, starts, lengths = self._looked_up(pa.concat_arrays([words.dictionary, odd_pieces, heads]), done)
        row = parts[codes]
        keep = row >= 0
        limits = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])[limits]
        row = row[keep]
        of = lengths[row]
        at = np.cumsum(of)
        out = pool[np.repeat(starts[row] - (at - of), of) + np.arange(at[-1] if len(at) else 0)]
        return out, np.concatenate([[0], at])[limits]

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """(first column, ids, limits) of parts of batches whose second column is text."""
        for part in parts(batches, size=PART_BYTES):
            yield part.column(0).to_pylist(), *self.encode(part.column(1))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
