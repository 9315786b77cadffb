"""Members of package archives, read in memory; nothing is unpacked to disk or run."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import in_batches
from ..functions import patterns as P

SCHEMA = "archive string, seq long, path string, size long, content binary, truncated string"
MAX_ARCHIVE, MAX_BYTES, MAX_MEMBERS, MAX_RATIO, MAX_FILE = 80 << 20, 400 << 20, 20_000, 200.0, 2 << 20


def unsafe_path(path: Column) -> Column:
    """Absolute, with a drive letter, on a share, or with a parent segment."""
    return path.rlike(r"^(/|\\|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")


def analysable(path: Column) -> Column:
    """Whether a file of this name is read: by its suffix, or as one of those always read."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    return name.isin(P.ALWAYS_READ) | suffix.isin(P.ANALYSABLE)


def text_of(content: Column) -> Column:
    """The content as UTF-8 text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def _bounded(f: IO[bytes]) -> bytes:
    """What a member holds, or nothing if that is more than MAX_FILE, whatever size its header names."""
    parts, size = [], 0
    while block := f.read(1 << 16):
        parts.append(block)
        size += len(block)
        if size > MAX_FILE:
            return b""
    return b"".join(parts)


def _members(data: bytes, password: bytes | None) -> Iterator[tuple[str, int, bytes]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    content = b""
                    if info.file_size <= MAX_FILE:
                        with z.open(info, pwd=password) as f:
                            content = _bounded(f)
                    yield info.filename, max(info.file_size, len(content)), content
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for info in t:
                if info.isfile():
                    f = t.extractfile(info) if info.size <= MAX_FILE else None
                    yield info.name, info.size, _bounded(f) if f else b""


def extract(name: str, data: bytes, password: bytes | None = None) -> Iterator[tuple]:
    """(archive, seq, path, size, content, reason), member by member: stops at the first ceiling that a member would pass."""
    if len(data) > MAX_ARCHIVE:
        yield name, 0, None, len(data), None, "archive size"
        return
    seq = total = 0
    try:
        for path, size, content in _members(data, password):
            total += size
            reason = "members" if seq >= MAX_MEMBERS else "bytes" if total > MAX_BYTES else "ratio" if total > MAX_RATIO * max(len(data), 1) else None
            if reason:
                yield name, seq, None, size, None, reason
                return
            yield name, seq, path, size, content, None
            seq += 1
    except (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError):
        yield name, seq, None, 0, None, "unreadable"


def members(archives: DataFrame, password: str | None = None) -> DataFrame:
    """archives: archive, content. Unsafe paths are left out; a shared first folder is cut off.

    password: that of encrypted zip archives, whose members are decoded in memory only.
    """
    key = password.encode() if password else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (row for name, data in zip(batch["archive"], batch["content"], strict=True) for row in extract(name, bytes(data or b""), key))
            yield from in_batches(rows, [c.split()[0] for c in SCHEMA.split(", ")])

    rows = archives.select("archive", "content").mapInPandas(work, SCHEMA).where(F.col("path").isNull() | ~unsafe_path(F.col("path")))
    return strip_wrapper(rows)


def samples(archives: DataFrame, password: str = "infected", wrappers: int = 3) -> DataFrame:
    """Members of encrypted sample archives, with as many as `wrappers` shared first folders cut off."""
    rows = members(archives, password)
    for _ in range(wrappers - 1):
        rows = strip_wrapper(rows)
    return rows


def contents(rows: DataFrame) -> DataFrame:
    """Of each archive its files, bytes, files that are read, and why it was cut, if it was."""
    file = F.col("path").isNotNull()
    return rows.groupBy("archive").agg(
        F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(file & analysable(F.col("path"))).alias("readable"), F.max("truncated").alias("reason")
    )


def by_suffix(rows: DataFrame, suffixes: list[str]) -> DataFrame:
    """The files with one of the suffixes, in any case."""
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))


def source_files(rows: DataFrame) -> DataFrame:
    """package, path, text of the members that are read, for the engine."""
    kept = rows.where(F.col("path").isNotNull() & analysable(F.col("path")))
    return kept.select(F.col("archive").alias("package"), "path", text_of(F.col("content")).alias("text"))


def strip_wrapper(rows: DataFrame) -> DataFrame:
    head = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    shared = rows.where("path IS NOT NULL").groupBy("archive").agg(F.min(head).alias("low"), F.max(head).alias("high")).where("low = high AND low <> ''").select("archive", F.lit(True).alias("wrapped"))
    cut = F.when(F.col("wrapped"), F.expr("substring(path, locate('/', path) + 1)")).otherwise(F.col("path"))
    return rows.join(shared, "archive", "left").withColumn("path", cut).drop("wrapped")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives under a path, through Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tgz,gz,zip,whl,tar}").load(path)
    return members(files.select(F.col("path").alias("archive"), "content"))
