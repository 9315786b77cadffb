import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing, queries, token_files, words
from larkspur.llm.tokens import Encoder


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.tokenizer())
    t.encode_special_tokens = True
    return t


def whole_ids(library, rows, end):
    return {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for d, t in rows}


def test_encoder_equals_library(library):
    texts = ["", " ", "  a b", "it's o'k  x\n\n y", "a\t b", "ab.\nCd e!!\n", " x", "日本 語 x", "a  b c", "don.\n", "e,f g", "\n x", "x <|endoftext|> k", "a.'s b", "É.\nÀ b", "a\x1cb c\x85 d", "w" * 500 + " z", "1 2, 3.\n4", "a.\n b", "a.\n\nb c"] * 3
    ids, limits = Encoder(queries.tokenizer()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[limits[i] : limits[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_parts_cover_batches_in_order(monkeypatch):
    monkeypatch.setattr(words, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["abc", "", "x" * 40, "de", "f", "g" * 9, "h"])], ["doc_id", "text"])
    got = [x for p in words.parts(iter([batch])) for x in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    assert got == list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def check_packing(pieces, want, capacity=2048):
    spans, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, ids in want.items():
        at = 0
        for p in sorted(spans[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = waste = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
        used, waste = used + at, waste + (0 if at & (at - 1) == 0 else capacity - at)
    return waste / max(used, 1)


def test_packing_is_whole_and_dense(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(queries.op2_harmonic_packing(spark, sf).collect(), whole_ids(library, rows, 1)) < 0.01


def test_cuts():
    for n in [0, 1, 2, 7, 100, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 10_000]:
        pieces = packing.cut(n, 2048, 8)
        assert sum(p for p, _ in pieces) == n
        assert all(0 < p <= 2048 / k for p, k in pieces)


def test_packing_odd_rows(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    p = packing.pack(odd_docs, queries.tokenizer()).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sum(x["length"] for x in p if x["doc_id"] in (3, 4)) == 2
    assert sum(x["length"] for x in p if x["doc_id"] == 8) == 2 * next(x["doc_tokens"] for x in p if x["doc_id"] == 8)
    assert packing.pack(no_docs, queries.tokenizer()).collect() == []


def test_token_files_round_trip(spark, sf, library):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, sf).collect()}
    start = 0
    for d, ids in whole_ids(library, rows, 2).items():
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize(("shards", "file_tokens"), [(1, 1 << 24), (5, 3000), (40, 1)])
def test_starts_over_many_batches_and_files(spark, sf, library, monkeypatch, shards, file_tokens):
    """Documents in no order over seven partitions, small parts of batches, files with few documents."""
    monkeypatch.setattr(token_files, "INDEX_ROWS", 3)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        folder = token_files.new_folder(spark)
        done = token_files.write_tokens(docs, folder, queries.tokenizer(), width=32, shards=shards, file_tokens=file_tokens)
        got = {r["doc_id"]: r for r in token_files.read_tokens(spark, folder, done).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    start = 0
    for d, ids in whole_ids(library, sorted(rows), 2).items():
        assert (got[d]["start"], got[d]["n_tokens"], bytes(got[d]["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert done.groupBy("shard").count().count() <= shards
    assert done.select("shard", "file").distinct().count() >= max(1, shards // 2)


def test_one_id_with_most_rows_is_spread(spark, library):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text {i % 37}") for i in range(300)] + [(i, "x") for i in range(10)], "doc_id long, text string")
    folder = token_files.new_folder(spark)
    done = token_files.write_tokens(docs, folder, queries.tokenizer(), width=8, shards=12)
    got = sorted(token_files.read_tokens(spark, folder, done).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order) and len(order) == 310
    assert done.where("doc_id = 5").select("shard").distinct().count() > 1


def test_shard_of_keeps_the_order_of_ids():
    limits = [3, 7, 7, 7, 9]
    for a in range(12):
        for b in range(a, 12):
            assert a == b or max(token_files.shard_of(limits, a, s) for s in range(4)) <= min(token_files.shard_of(limits, b, s) for s in range(4))


def test_token_files_odd_rows(spark, odd_docs, no_docs):
    folder = token_files.new_folder(spark)
    done = token_files.write_tokens(odd_docs, folder, queries.tokenizer(), width=64, shards=3)
    got = token_files.read_tokens(spark, folder, done).collect()
    assert len(got) == odd_docs.count() and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    table, _ = token_files.open_file(folder, done.first()["shard"])
    assert table.read_all().schema.field("ids").type.list_size == 64
    empty = token_files.new_folder(spark)
    assert token_files.read_tokens(spark, empty, token_files.write_tokens(no_docs, empty, queries.tokenizer())).collect() == []


def test_encoder_equals_library_over_batches(library, sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    e = Encoder(queries.tokenizer())
    for part in (texts[:40], texts[20:90], [], texts[90:]):
        ids, limits = e.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[limits[i] : limits[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_file_of_an_earlier_attempt_is_replaced(tmp_path):
    """A task that is tried again puts its files in place of those that it left, also where a rename does not."""
    import pyarrow.fs as pafs

    class NoOverwrite:
        """A file system that refuses to rename onto a file."""

        def __init__(self):
            self.fs = pafs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, own, end):
            assert self.fs.get_file_info(end).type == pafs.FileType.NotFound
            self.fs.move(own, end)

    one = type("One", (), {"fs": NoOverwrite()})()
    for text in ("first", "second"):
        own, end = tmp_path / f"{text}.own", tmp_path / "x.arrows"
        own.write_text(text)
        token_files.FileWriter._put(one, str(own), str(end))
        assert end.read_text() == text and not own.exists()
