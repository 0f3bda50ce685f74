"""Evaluation and sampling runs that store and reuse their index and matches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinity.evaluation import EvaluationRun, EvaluatorConfig, EvaluatorMLCConfig, SamplingConfig
from vicinity.operators import metrics
from vicinity.pipeline import IndexConfig, SearchConfig
from vicinity.plans import fixtures as fx
from vicinity.plans import multilabel as pm
from vicinity.plans import register
from vicinity.plans import sampling as ps
from vicinity.plans import search as pq
from vicinity.session import checkpoint_dir


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/evaluations-{uuid.uuid4().hex}"


def _twice(make):
    """Metrics of two equal runs one after the other, with how much the second opened instead of computing it."""
    out = None
    for number in (1, 2):
        run = make()
        rows = run.run(step=number)
        rows = rows.select("key", "step", F.round("value", 9).alias("value"), F.lit(len(run.built)).alias("built"),
                           F.lit(len(run.reused)).alias("reused"))
        out = rows if out is None else out.unionByName(rows)
    return out


_STEPS = "(SELECT * FROM (VALUES (1, {a}, {b}), (2, {c}, {d})) AS s(step, built, reused))"


@register("evaluate_run", pq.MULTICLASS_SQL + f"""
SELECT 'test/' || metric || k AS key, step, round(value, 9) AS value, built, reused FROM (
  SELECT metric, '/' || CAST(k AS VARCHAR) AS k, value FROM mc
  UNION ALL SELECT metric, '', max(value) FROM mc GROUP BY metric), {_STEPS.format(a=2, b=0, c=0, d=1)}""")
def evaluate_run(spark, sf):
    """Vote metrics of two equal runs over a stored index; the second opens the first one's matches."""
    q, c = fx.split_vectors(spark, sf)
    config = EvaluatorConfig(output_dir=_folder(spark), eval_ks=tuple(pq.KS))
    return _twice(lambda: EvaluationRun(c.select("pid", "vec", "label"), q.withColumnRenamed("qid", "pid").select("pid", "vec", "label"), config))


@register("evaluate_run_mlc", pm._MLC_SQL + f"""
SELECT 'test/' || metric || CASE WHEN k > 0 THEN '/' || CAST(k AS VARCHAR) ELSE '' END AS key, step, round(value, 9) AS value,
       built, reused FROM mlc, {_STEPS.format(a=4, b=0, c=0, d=3)}""")
def evaluate_run_mlc(spark, sf):
    """ML-kNN metrics of two equal runs; the second opens index matches and model of the first."""
    train, test = pm._data(spark, sf)
    config = EvaluatorMLCConfig(output_dir=_folder(spark), eval_ks=tuple(k for k in pm.MLC_KS if k), mlknn_k=pm.K, mlknn_s=pm.S)
    return _twice(lambda: EvaluationRun(train, test.withColumnRenamed("qid", "pid"), config))


def _accuracy(run):
    """A user's own evaluate function: accuracy of the nearest neighbour's label."""
    nearest = run.matches(k=1).join(run.labels("train", "y_pred"), "pid").select("qid", "y_pred")
    both = nearest.join(run.labels("evaluation", "y_true").withColumnRenamed("pid", "qid"), "qid").withColumn("k", F.lit(1))
    return metrics.multiclass_metrics(both).filter("metric = 'accuracy'")


@register("evaluate_run_custom", pq.MULTICLASS_SQL + "SELECT 'dev/accuracy/1' AS key, 0 AS step, round(value, 9) AS value FROM mc "
          "WHERE metric = 'accuracy' AND k = 1")
def evaluate_run_custom(spark, sf):
    """A run with an evaluate function of the user's and an inverted file of which every cell is probed (U4)."""
    q, c = fx.split_vectors(spark, sf)
    run = EvaluationRun(c.select("pid", "vec", "label"), q.withColumnRenamed("qid", "pid").select("pid", "vec", "label"),
                        EvaluatorConfig(output_dir=_folder(spark), prefix="dev"), IndexConfig(layout="IVF8,Flat"), SearchConfig(ncells=8),
                        evaluate=_accuracy)
    return run.run().withColumn("value", F.round("value", 9))


@register("run_sample", ps._SEARCHED.rstrip() + "," + ps._weights_sql("scores") + "," + ps._DRAW_SQL + "SELECT anchor, slot, pid FROM tup")
def run_sample(spark, sf):
    """Tuples that a run samples from its stored matches."""
    p = fx.vectors(spark, sf).select("pid", "vec", "label")
    run = EvaluationRun(p, p.limit(0), EvaluatorConfig(output_dir=_folder(spark)))
    return run.sample(SamplingConfig("searched", "scores", searcher_sampling_k=ps.K, nway=ps.NWAY, seed=ps.SEED))
