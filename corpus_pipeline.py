"""Corpus pipeline: quality filter, exact and near deduplication, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``; the mix
returns a document once for each time that it is taken, cut where its block is cut. The last returns one row for each
row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact_dedup, mixing, quality, simhash
from quillon.llm.common import Scratch, materialize, read_table, release
from quillon.llm.queries import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more."""
    return quality.keep(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the one with the smallest id."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them."""
    return mixing.Mix(docs).documents()


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return bpe.Tokenizer(docs, vocabulary_path()).digest(docs)


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: A classifier's, a fingerprint's and a draw's rows aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go once its result is written, the result once the next has
    read it."""
    docs = before = None
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            rows = read_table(spark, sf_dir, "documents") if docs is None else docs
            before, docs = docs, scratch.keep(materialize(stage(spark, rows, sf_dir)))
        if before is not None:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
