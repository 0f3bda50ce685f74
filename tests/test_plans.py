"""Physical-plan properties the design relies on."""

import re

from tests.conftest import SF_MID

import __spark_entry__ as E


def _plan(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_small_corpus_knn_is_map_only_and_pruned(spark):
    p = _plan(E.queries()["knn_ip"](spark, SF_MID))
    assert "MapInArrow" in p
    assert "FlatMapCoGroupsInArrow" not in p              # no block grid
    assert "Window" not in p                              # every query finished in its task
    scan = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scan and all("label" not in line for line in scan)   # column pruning


def test_top_k_is_two_phase(spark):
    p = _plan(E.queries()["maxsim_hashed"](spark, SF_MID))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p
    assert "hashpartitioning(doc_id" in p or "REPARTITION" in p or "Exchange" in p
    assert "FlatMapCoGroupsInArrow" not in p              # broadcast query side, documents stay put


def test_ivf_search_uses_cell_equi_join_groups(spark):
    p = _plan(E.queries()["ivf_probe2"](spark, SF_MID))
    assert "FlatMapCoGroupsInArrow [cell, qb, cb]" in p
    assert "SortMergeJoin [pid]" not in p                 # vectors travel with the index rows


def test_vote_is_hash_aggregated(spark):
    p = _plan(E.queries()["knn_vote_ks"](spark, SF_MID))
    assert "SortAggregate" not in p
    assert "BroadcastHashJoin" in p                       # labels attached by a broadcast join


def test_label_tables_are_broadcast_whatever_the_estimates(spark):
    from pyspark.sql import functions as F

    from vicinity.operators import corpus
    big = spark.range(10 ** 12).select(F.col("id").alias("pid"), (F.col("id") % 10).cast("int").alias("label"))
    names = (spark.range(10 ** 4).select((F.col("id") % 10).cast("int").alias("label_id")).groupBy("label_id")
             .agg(F.count(F.lit(1)).cast("string").alias("name")))
    plan = corpus.decode_labels(big, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(label" not in plan
