"""Dataset scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# text tables whose per-row work (regex, hashing) is CPU heavy
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; Catalyst prunes columns and pushes filters into it.

    Text tables stored as fewer splits than the cluster has cores (one row
    group, as in small fixtures) are hash-spread by id so the CPU-heavy text
    work runs in parallel; big inputs already have many splits and are left alone.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        return spread(df, TEXT_TABLES[name])
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset saved by :func:`save_splits`; the split filter prunes partitions (S3)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def save_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a dataset partitioned by ``split``."""
    writer = df.write.mode(mode)
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)


def inline_texts(spark: SparkSession, texts, start_id: int = 0) -> DataFrame:
    """``(pid, text)`` from a list of texts or an id -> text mapping (S10, J7 inputs)."""
    if isinstance(texts, dict):
        rows = [(int(k), str(v)) for k, v in texts.items()]
    elif isinstance(texts, str):
        rows = [(start_id, texts)]
    else:
        rows = [(start_id + i, str(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pid long, text string")
