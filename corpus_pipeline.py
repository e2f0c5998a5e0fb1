"""Corpus cleaning pipeline: five stages over documents, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, exact_dedup, simhash, toxicity
from palimpsest.llm._common import drop_path, shared_path, table
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import tokenizer_path, toxicity_model

#: Toxicity and packing are not expressible in SQL.
ORACLE_SQL = None


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic (score from 0.3 on) go; the model is that of the toxicity query."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) one row stays, that with the largest doc_id; see ``keep_one`` for ties and nulls."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that with the smallest doc_id; see ``keep_first`` for ties and nulls."""
    return simhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, each by its own text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", nontoxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and reread.

    The folder of a stage is removed when the next one is written, so only the last one's stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
