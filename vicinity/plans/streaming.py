"""Streaming: running multi-label counters over prediction files (M7 update form)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinity.operators import mlknn
from vicinity.plans import multilabel as pml
from vicinity.plans import register
from vicinity.session import checkpoint_dir
from vicinity.streaming.metric_counters import run_counters

N_FILES = 4


@register("mlc_stream_counters", pml._MLC_SQL + "SELECT label, tp, fp, fn FROM conf WHERE k = 0")
def mlc_stream_counters(spark, sf):
    """ML-kNN predictions of the test rows written as several parquet files, then consumed
    by a streaming aggregation one file per micro-batch; the final running counters
    equal the batch confusion counts (M7 incremental form)."""
    _, test, _, p = pml._predict(spark, sf)
    packed = mlknn.pack_predictions(p, test.select("qid"), order="desc")
    rows = (packed.join(test.select("qid", "labels"), "qid")
            .select(F.col("qid").alias("id"), "preds", "labels"))
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows.repartition(N_FILES, "id").write.mode("overwrite").parquet(f"{base}/in")
    name = f"mlc_counters_{uuid.uuid4().hex[:8]}"
    out = run_counters(spark, f"{base}/in", f"{base}/state", name)
    return out.select(F.col("label").cast("int").alias("label"), "tp", "fp", "fn")
