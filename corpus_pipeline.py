"""Corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, encoding.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``.  All stages but the last return the columns of
``documents``.  :func:`run` applies them to ``documents`` with such a table
between any two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import exact_dedup, importance, mixing, pieces, simhash
from vicinity.llm.queries import PIECE_MODEL, table
from vicinity.session import checkpoint_dir, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from ``docs`` and the labels of its rows."""
    ship_package(spark)
    return importance.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 4-word shingles, at most 4 bits."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, size=4, max_bits=4, seed=42)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: clean ones at least once, toxic ones cut to their target."""
    ship_package(spark)
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document with an end id, and their digests."""
    ship_package(spark)
    return pieces.encode_digests(docs, pieces.read_model(spark, PIECE_MODEL))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixture),
          ("sentencepiece", encoded)]

# the stages learn models and hash fingerprints, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what they hand on is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
