"""Exact multi-label draws: ranks among related and unrelated passages against brute force."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vicinity.operators import sampling
from vicinity.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def _drawn(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r["anchor"], r["role"]), []).append((r["i"], r["pid"]))
    for k, v in out.items():
        assert [i for i, _ in sorted(v)] == list(range(len(v)))
    return {k: [p for _, p in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_all_related_and_unrelated_are_drawn(spark, seed):
    """Asked for more than there are, a draw is exactly the related and the unrelated passages."""
    rng = random.Random(seed)
    sets = {i: None if i % 17 == 3 else [rng.choice([1, 2, 3, 5, 8, 13, i]) for _ in range(rng.randint(0, 4))] for i in range(60)}
    passages = spark.createDataFrame(list(sets.items()), "pid long, labels array<int>").repartition(5)
    got = _drawn(sampling.random_candidates_ml(passages, 100, 100, seed))
    for a, mine in sets.items():
        related = {b for b, other in sets.items() if b != a and set(mine or []) & set(other or [])}
        assert set(got.get((a, "pos"), [])) == related and len(got.get((a, "pos"), [])) == len(related)
        assert set(got.get((a, "neg"), [])) == set(sets) - related - {a}
    part = _drawn(sampling.random_candidates_ml(passages, 2, 7, seed))
    for (a, role), found in part.items():
        assert len(set(found)) == len(found) == min(2 if role == "pos" else 7, len(got[a, role])) and set(found) <= set(got[a, role])


def test_draws_are_uniform(spark):
    passages = spark.range(3000).select(F.col("id").alias("pid"), F.when(F.col("id") < 2990, F.array(F.lit(1), F.lit(2) + F.col("id") % 3))
                                        .otherwise(F.array(F.lit(9))).alias("labels"))
    got = sampling.random_candidates_ml(passages, 1, 1, 7).toPandas()
    hits = Counter(got[(got.anchor < 2990) & (got.role == "neg")].pid)
    assert set(hits) == set(range(2990, 3000)) and min(hits.values()) > 220 and max(hits.values()) < 380
    tenths = Counter((got[(got.anchor < 2990) & (got.role == "pos")].pid // 299).tolist())
    assert len(tenths) == 10 and min(tenths.values()) > 220 and max(tenths.values()) < 380


def test_one_label_that_nearly_all_have(spark):
    """100,000 passages of which 10 lack the common label: no work beyond one row an anchor and a draw."""
    passages = spark.range(100_000).select(F.col("id").alias("pid"), F.when(F.col("id") >= 10, F.array(F.lit(1), (F.col("id") % 50 + 2).cast("int")))
                                           .otherwise(F.array(F.lit(1000))).alias("labels"))
    began = time.time()
    got = sampling.random_candidates_ml(passages, 3, 12, 1)
    assert got.groupBy("role").count().orderBy("role").collect() == [("neg", 10 * 99_990 + 12 * 10), ("pos", 3 * 100_000)]
    assert time.time() - began < 120


def test_ranges_are_few_for_frequent_labels(spark):
    rows = [(i, [b for b in range(12) if i >> b & 1]) for i in range(4096)]
    _, related = sampling.signature_pools(spark.createDataFrame(rows, "pid long, labels array<int>"), 3)
    sizes = [r[0] for r in related.select(F.size("starts")).collect()]
    assert len(sizes) == 4095 and max(sizes) <= 2048 and sum(sizes) < 4096 * 64  # against 4,096^2 pairs


def test_fill_ups_of_several_positives(spark):
    passages = spark.createDataFrame([(i, [i % 3], [float(i), 1.0]) for i in range(30)], "pid long, labels array<int>, vec array<double>")
    matches = passages.select(F.col("pid").alias("qid"), F.lit(1).alias("rank"), ((F.col("pid") + 1) % 30).alias("pid"), F.lit(0.5).alias("score"))
    got = sampling.searched_filled_ml(matches, passages.select("pid", "labels"), 1, 4, 5, seed=2).collect()
    count = Counter((r["anchor"], r["role"]) for r in got)
    assert all(count[i, "pos"] == 4 and count[i, "neg"] == 5 for i in range(30))
    assert len({(r["anchor"], r["pid"]) for r in got}) == len(got)
    assert all((r["pid"] % 3 == r["anchor"] % 3) == (r["role"] == "pos") for r in got)
