"""Token ids in Arrow stream files of fixed-size lists (operator 6).

Documents are dealt by ranges of doc_id, as many as the text's bytes call for, and
encoded. A task writes its range in ascending order and begins a new file whenever
one holds `file_tokens` ids, so no file grows with the input. A file is an Arrow IPC
stream whose batches hold two fixed-size-list columns, ids and mask, of `width`
values a row: with a local file the batches are memory-mapped and any sequence is
read in place. The last row of a file is padded, with false in its mask. A second
stream beside it lists its documents. Files are written under a name of their own
and then renamed, so a task that is tried again leaves whole files of equal content.

Writer and reader go through a file batch by batch: they hold one batch, one
document and INDEX_ROWS entries of the list.

Defined cases: null text is empty, and an empty document is its end id alone; null
ids come first; rows with the same doc_id follow each other, ordered by their ids,
and an id with more rows than a range takes is spread over several; an empty table
gives no file; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_keys, shared_dir, text_of, written
from .tokens import encoder

#: Rows of a batch in a file.
ROWS = 512
#: Entries of a file's list of documents that are held at once.
INDEX_ROWS = 4096
#: Bytes of text in a range of ids, about.
RANGE_BYTES = 64 << 20
#: Ids in a file, and one document more at most.
FILE_TOKENS = 16 << 20
#: Bytes of compressed ids that leave the encoder at once.
SEND_BYTES = 8_000_000
DOC_SCHEMA = "shard long, file long, doc_id long, local_start long, n_tokens long"
LIST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def schema(width: int, kind: str) -> pa.Schema:
    value = {"<u2": pa.uint16(), "<u4": pa.uint32()}[kind]
    return pa.schema([("ids", pa.list_(value, width)), ("mask", pa.list_(pa.bool_(), width))])


class FileWriter:
    """Writes one file and its list batch by batch."""

    def __init__(self, folder: str, shard: int, number: int, width: int, kind: str):
        self.fs, base = _fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.shard, self.number = shard, number
        self.end = f"{base}/{_name(shard, number)}"
        self.own = f"{self.end}.{uuid.uuid4().hex}.tmp"
        self.width, self.kind, self.schema = width, kind, schema(width, kind)
        self.sinks = [self.fs.open_output_stream(x) for x in (self.own, f"{self.own}.docs")]
        self.stream, self.list = (pa.ipc.new_stream(f, x) for f, x in zip(self.sinks, (self.schema, LIST), strict=True))
        self.held: list[np.ndarray] = []
        self.n = self.total = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= ROWS * self.width:
            self._flush()

    def _flush(self) -> None:
        """Write all full rows that are held, ROWS a batch."""
        flat = np.concatenate(self.held)
        cells = len(flat) // self.width * self.width
        for at in range(0, cells, ROWS * self.width):
            body = flat[at : min(cells, at + ROWS * self.width)]
            self._batch(body, np.ones(len(body), bool))
        self.held, self.n = [flat[cells:].copy()], len(flat) - cells

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def listed(self) -> pa.RecordBatch:
        """The entries held, now written to the list, as rows of DOC_SCHEMA."""
        cols = [pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)]
        self.list.write_batch(pa.RecordBatch.from_arrays(cols, schema=LIST))
        n, self.docs = len(self.docs), []
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.shard)), pa.array(np.full(n, self.number)), *cols], [x.split()[0] for x in DOC_SCHEMA.split(", ")])

    def close(self) -> None:
        self._flush()
        if self.n:
            rest = np.zeros(self.width, self.kind)
            rest[: self.n] = self.held[0]
            self._batch(rest, np.arange(self.width) < self.n)
        for x in (self.stream, self.list, *self.sinks):
            x.close()
        self._put(f"{self.own}.docs", f"{self.end}.docs.arrows")
        self._put(self.own, f"{self.end}.arrows")

    def _put(self, own: str, end: str) -> None:
        """Give a file its name; one that an earlier attempt of the task has left goes, as not every store renames onto it."""
        if self.fs.get_file_info(end).type != pafs.FileType.NotFound:
            self.fs.delete_file(end)
        self.fs.move(own, end)


def _name(shard: int, number: int) -> str:
    return f"shard-{shard:08d}-{number:06d}"


def _stream(fs: pafs.FileSystem, path: str) -> pa.ipc.RecordBatchStreamReader:
    """A stream's batches one by one, mapped where the file is local."""
    return pa.ipc.open_stream(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_stream(path))


def open_file(folder: str, shard: int, number: int = 0) -> tuple[pa.ipc.RecordBatchStreamReader, pa.ipc.RecordBatchStreamReader]:
    """Readers of a file's sequences and of its documents; read_all() maps a local one whole."""
    fs, base = _fs(folder)
    at = f"{base}/{_name(shard, number)}"
    return _stream(fs, f"{at}.arrows"), _stream(fs, f"{at}.docs.arrows")


def range_limits(docs: DataFrame, id_col: str, text_col: str, shards: int | None) -> list[int]:
    """Ascending ids that part the ranges; an id with the rows of several ranges stands there repeatedly."""
    size = docs.select(F.coalesce(F.sum(F.octet_length(text_of(text_col)) + 16), F.lit(0)).alias("n")).first()["n"]
    shards = shards or max(1, -(-size // RANGE_BYTES))
    if shards == 1:
        return []
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    at = [i / shards for i in range(1, shards)]
    return docs.select(F.percentile_approx(key, at, max(10_000, 4 * shards)).alias("p")).first()["p"] or []


#: Where null ids stand in the order.
NO_ID = -(1 << 63)


def shard_of(limits: list[int], key: int, spread: int) -> int:
    """The range of an id; one that is a limit repeatedly has ranges to itself, and `spread` picks one."""
    low, high = bisect_left(limits, key), bisect_right(limits, key)
    return high if high - low < 2 else low + 1 + spread % (high - low)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, width: int = 2048, end_id: int = 2, shards: int | None = None, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; returns shard, file, doc_id, local_start and n_tokens of each."""
    limits = range_limits(docs, id_col, text_col, shards)
    homes = even_keys(docs.sparkSession, len(limits) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = _kind(enc.vocabulary)
        for doc_ids, flat, cuts in enc.batches(batches):
            rows: list[list] = [[], [], [], []]
            size = 0
            for key, a, b in zip(doc_ids, cuts.tolist(), cuts[1:].tolist(), strict=False):
                packed = zlib.compress(np.append(flat[a:b], end_id).astype(kind).tobytes(), 1)
                shard = shard_of(limits, NO_ID if key is None else key, zlib.crc32(packed))
                for col, x in zip(rows, (homes[shard], shard, key, packed), strict=True):
                    col.append(x)
                size += len(packed)
                if size > SEND_BYTES:
                    yield _encoded(rows)
                    rows, size = [[], [], [], []], 0
            yield _encoded(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(vocabulary)
        writer = None
        for batch in batches:
            for shard, doc_id, packed in zip(*batch.columns, strict=True):
                shard = shard.as_py()
                if writer and (shard != writer.shard or writer.total >= file_tokens):
                    number = writer.number + 1 if shard == writer.shard else 0
                    if writer.docs:
                        yield writer.listed()
                    writer.close()
                    writer = FileWriter(folder, shard, number, width, kind)
                elif not writer:
                    writer = FileWriter(folder, shard, 0, width, kind)
                writer.add(doc_id.as_py(), np.frombuffer(zlib.decompress(packed.as_py()), kind))
                if len(writer.docs) >= INDEX_ROWS:
                    yield writer.listed()
        if writer:
            if writer.docs:
                yield writer.listed()
            writer.close()

    vocabulary = vocabulary_size(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = rows.mapInArrow(encode, "home long, shard long, doc_id long, ids binary").repartition(len(homes), "home").drop("home")
    # The ids come last: what is equal in all three may change places.
    return written(dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, DOC_SCHEMA), "token-docs")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def _encoded(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], ["home", "shard", "doc_id", "ids"])


def _documents(folder: str, shard: int, number: int) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """doc_id, start in the file, number of ids and the ids of a file's documents, in order."""
    sequences, index = open_file(folder, shard, number)
    flat, used = np.empty(0, "<u4"), 0
    for entries in index:
        for doc_id, start, n in zip(*(c.to_pylist() for c in entries.columns), strict=True):
            held, have = [], 0
            while have < n:
                if used == len(flat):
                    # Fixed-size lists lie end to end: a batch's values are one array.
                    flat, used = sequences.read_next_batch().column("ids").flatten().to_numpy(), 0
                held.append(flat[used : used + n - have])
                used, have = used + len(held[-1]), have + len(held[-1])
            yield doc_id, start, n, np.concatenate(held).astype("<u4")


def read_tokens(spark: SparkSession, folder: str, written_docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document, read from the files.

    start counts the ids of all documents before it: those in its file plus the
    totals of the files below, one number a file.
    """
    totals = written_docs.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).orderBy("shard", "file").toLocalIterator()
    files, before = [], 0
    for r in totals:
        files.append((r["shard"], r["file"], before))
        before += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[list] = [[], [], [], []]
                size = 0
                for doc_id, start, n, ids in _documents(folder, shard, number):
                    for col, x in zip(rows, (doc_id, base + start, n, ids.tobytes()), strict=True):
                        col.append(x)
                    size += 4 * n + 64
                    if size > SEND_BYTES:
                        yield _read(rows)
                        rows, size = [[], [], [], []], 0
                yield _read(rows)

    names = spark.createDataFrame(files, "shard long, file long, base long").repartition(max(1, len(files)))
    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _read(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows[:3]] + [pa.array(rows[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "token-files")
