"""Incremental multi-label metric counters with Structured Streaming.

The reference updates tp / fp / fn counters batch by batch while iterating
over predictions.  Here prediction rows ``(id, preds, labels)`` arrive as
files; each micro-batch is exploded into per-label outcomes and a streaming
aggregation keeps the running counters (state store, fault tolerant through
the checkpoint location).  The final counters equal the batch computation
(:func:`vicinity.operators.metrics.multilabel_confusion`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = "id long, preds array<int>, labels array<int>"


def outcomes(rows: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn)`` indicator rows for one batch of predictions (per-row set algebra)."""
    p, t = F.array_distinct("preds"), F.array_distinct("labels")
    tp = rows.select(F.explode(F.array_intersect(p, t)).alias("label"), F.lit(1).alias("tp"),
                     F.lit(0).alias("fp"), F.lit(0).alias("fn"))
    fp = rows.select(F.explode(F.array_except(p, t)).alias("label"), F.lit(0).alias("tp"),
                     F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    fn = rows.select(F.explode(F.array_except(t, p)).alias("label"), F.lit(0).alias("tp"),
                     F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    return tp.unionByName(fp).unionByName(fn)


def counter_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming running counters per label from parquet prediction files."""
    rows = (spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))
    return (outcomes(rows).groupBy("label")
            .agg(F.sum("tp").cast("long").alias("tp"), F.sum("fp").cast("long").alias("fp"),
                 F.sum("fn").cast("long").alias("fn")))


def run_counters(spark: SparkSession, source_dir: str, checkpoint: str, name: str) -> DataFrame:
    """Drain all available prediction files (``availableNow``) and return the final counters.

    The result sink is an in-memory table of one row per label (bounded by the
    label count); state and progress live in ``checkpoint``.
    """
    q = (counter_stream(spark, source_dir).writeStream.outputMode("complete").format("memory")
         .queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
