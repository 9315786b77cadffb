"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents, further ones and their order included.

Defined cases, for every stage: a null text is an empty one; null and repeated
doc_ids are rows of their own; an empty table gives an empty result; other columns,
whatever their names, are kept as they are and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, language_id, mixing, packing, simhash
from larkspur.llm.common import written
from larkspur.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of the others' recognises; the rest goes.

    Texts without a letter go, so do null and empty ones. All labelled rows may train, whatever their ids are;
    without any nothing is recognised and no more than these goes.
    """
    return language_id.accepted(docs, language_id.fit(docs, F.lit(True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id, null below all; of rows that agree in doc_id and text one.

    All empty texts are equal.
    """
    return exact_dedup.survivors(docs, exact_dedup.fresh_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked: the one with the smallest doc_id, null only where all are.

    Texts without a word are one fingerprint.
    """
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as before, in expectation, every source with the same share of them; null is a source like any other.

    Rows with the same doc_id and source are drawn alike.
    """
    return mixing.mix(docs, copy_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, placed in sequences of 2048 tokens; an empty text is its end token."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
