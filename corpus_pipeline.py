"""From raw documents to token ids: five stages, each of them one operator of seedforest.llm over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seedforest.llm import exact_dedup, minhash, mixing, pieces, toxicity
from seedforest.llm.common import cut, drop, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in training order: a document comes once for each pass that takes words of it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return pieces.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]

#: The toxicity model and the N-best segmentation can't be put in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir)), kept
        if before is not None:  # no later stage reads it
            drop(before)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
