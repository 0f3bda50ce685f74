"""Model hook: one model per worker, calls of texts of like length, rows in order."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators.encode import ArrowBatchEncoder
from vicinity.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def test_one_construction_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("made\n")
        return lambda texts: [np.array([os.getpid(), len(t)], float) for t in texts]

    docs = spark.range(400).select(F.col("id").alias("pid"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("text")).repartition(40)
    encoder = ArrowBatchEncoder(multi_vector=False, factory=factory, texts_per_call=3)
    rows = encoder.encode(docs).collect() + encoder.encode(docs).collect()
    workers = {str(int(r["vec"][0])) for r in rows}
    assert set(os.listdir(folder)) == workers and len(rows) == 800
    assert all(open(f"{folder}/{w}").read() == "made\n" for w in workers)  # 80 tasks, one model a worker
    assert all(r["vec"][1] == r["pid"] % 7 for r in rows)


@pytest.mark.parametrize("multi", [True, False])
def test_calls_are_filled_by_length_and_rows_keep_their_order(spark, multi):
    texts = ["b" * (i * 37 % 50) for i in range(64)]

    def fn(batch):
        spread = float(max(map(len, batch)) - min(map(len, batch)))
        return [np.array([[len(t), spread]] * (len(t) % 3) if multi else [len(t), spread]).reshape(-1, 2) if multi
                else np.array([len(t), spread]) for t in batch]

    docs = spark.createDataFrame(list(enumerate(texts)), "pid long, text string").coalesce(1)
    spreads = []
    for window in (1, 8):
        rows = ArrowBatchEncoder(fn, multi, texts_per_call=8, window=window).encode(docs).collect()
        want = [(i, j) for i, t in enumerate(texts) for j in range(len(t) % 3)] if multi else [(i, 0) for i in range(64)]
        assert [(r["pid"], r["pos"] if multi else 0) for r in rows] == want
        assert all(r["vec"][0] == len(texts[r["pid"]]) for r in rows)
        spreads.append(sum(r["vec"][1] for r in rows))
    assert spreads[1] < spreads[0] / 3


def test_wrong_arguments():
    for wrong in (dict(), dict(fn=len, factory=lambda: len), dict(fn=len, window=0), dict(fn=len, texts_per_call=0)):
        with pytest.raises(ValueError):
            ArrowBatchEncoder(**wrong)
