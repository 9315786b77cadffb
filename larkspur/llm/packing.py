"""Harmonic packing of documents into fixed-length sequences (operator 2).

A piece of length r is of class k = floor(capacity / r): k such pieces fill a bin.
A document is cut so that its pieces nearly fill their slots of capacity / k
tokens: whole sequences first, then, while a slot would waste more than `slack`
tokens, the largest slot length below what is left. Every class closes a bin when
it holds k pieces, in each partition on its own, so nothing is shuffled. What a
partition's open bins hold at its end is joined end to end into full sequences,
and the last of these is cut at powers of two, which need no padding.

Defined cases: null text is empty, and an empty document is its end id alone; a
document longer than a sequence spans several; repeated rows and ids are packed as
separate documents; a null doc_id is carried; an empty table gives no piece; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long, ids binary"
#: Sequences of one partition have ids from partition * SPAN.
SPAN = 1 << 40


def cut(tokens: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order."""
    pieces = [(capacity, 1)] * (tokens // capacity)
    left = tokens % capacity
    while left:
        k = capacity // left
        if capacity / k - left > slack:
            k += 1
            length = capacity // k
        else:
            length = left
        pieces.append((length, k))
        left -= length
    return pieces


def _powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Bins of one partition. Pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, capacity: int, slack: int, first_id: int):
        self.capacity, self.slack, self.next_id = capacity, slack, first_id
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        for length, k in cut(total, self.capacity, self.slack):
            waiting = self.open.setdefault(k, [])
            waiting.append((doc_id, at, total, ids[4 * at : 4 * (at + length)]))
            at += length
            if len(waiting) == k:
                self._close(waiting)
                self.open[k] = []

    def _close(self, pieces: list[tuple]) -> None:
        used, offset = sum(len(p[3]) // 4 for p in pieces), 0
        length = used if used & (used - 1) == 0 else self.capacity
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, total, self.next_id, offset, used, length, ids))
            offset += n
            self.bytes += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[3]) // 4 for p in rest)
        sizes = [self.capacity] * (total // self.capacity) + _powers(total % self.capacity)
        waiting, room, sizes = [], sizes[0] if sizes else 0, sizes[1:]
        for doc_id, start, tokens, ids in rest:
            while ids:
                part = ids[: 4 * room]
                waiting.append((doc_id, start, tokens, part))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    self._close(waiting)
                    waiting, room, sizes = [], sizes[0] if sizes else 0, sizes[1:]

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.done, strict=True)) or [()] * 9
        self.done, self.bytes = [], 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.binary())], names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 8, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    end = np.asarray([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, slack, TaskContext.get().partitionId() * SPAN)
        enc = encoder(tokenizer)
        for doc_ids, ids, limits in enc.batches(batches):
            for doc_id, a, b in zip(doc_ids, limits.tolist(), limits[1:].tolist(), strict=False):
                packer.add(doc_id, ids[a:b].tobytes() + end)
                if packer.bytes > 8_000_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, SCHEMA)
