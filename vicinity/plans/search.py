"""Phase 1: exact kNN joins, vote classification, multi-class metrics.

J1, J2, J7, J8, J10, P15, W1, C1, C2, M4, M5, M15, M19 on the passage vectors
(``embeddings``; query / corpus split by the seeded md5 rule of the fixtures).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.operators import classify, metrics
from vicinity.operators.similarity import knn_join
from vicinity.plans import fixtures as fx
from vicinity.plans import register, with_ctes

K = 10
KS = (1, 5, 10, 20)
KS_SQL = "[" + ", ".join(str(k) for k in KS) + "]"


def _split(spark, sf):
    return fx.split_vectors(spark, sf)


# --------------------------------------------------------------------------- J1 / J2 / J8

@register("knn_ip", with_ctes(fx.VEC_CTES, fx.knn_sql(K)) + "SELECT qid, rank, pid, score FROM m")
def knn_ip(spark, sf):
    q, c = _split(spark, sf)
    return knn_join(q, c, K, "inner_product")


@register("knn_l2", with_ctes(fx.VEC_CTES, fx.knn_sql(K, "l2_distance")) + "SELECT qid, rank, pid, score FROM m")
def knn_l2(spark, sf):
    q, c = _split(spark, sf)
    return knn_join(q, c, K, "l2_distance")


_ALL_CTE = "a AS (SELECT vec_id AS qid, vec_id AS pid, embedding::DOUBLE[] AS vec, label FROM embeddings)"


@register("knn_excl_self", with_ctes(_ALL_CTE, fx.knn_sql(K, src_q="a", src_c="a", exclude_self=True))
          + "SELECT qid, rank, pid, score FROM m")
def knn_excl_self(spark, sf):
    v = fx.vectors(spark, sf)
    return knn_join(v.select(F.col("pid").alias("qid"), "vec"), v.select("pid", "vec"), K, exclude_self=True)


# --------------------------------------------------------------------------- J10 hydration

@register("match_labels", with_ctes(fx.VEC_CTES, fx.knn_sql(K))
          + "SELECT m.qid, m.rank, m.pid, m.score, c.label FROM m JOIN c USING (pid)")
def match_labels(spark, sf):
    q, c = _split(spark, sf)
    return knn_join(q, c, K).join(c.select("pid", "label"), "pid").select("qid", "rank", "pid", "score", "label")


# --------------------------------------------------------------------------- C1 / C2

def _vote_sql(ks_sql: str, matches: str = "m", queries: str = "q", labels: str = "c", sfx: str = "") -> str:
    """CTEs ks, hits, have, votes, pred (each name + ``sfx``): vote with -1 padding, ties -> smaller label."""
    return f"""
ks{sfx} AS (SELECT unnest({ks_sql}) AS k),
hits{sfx} AS (SELECT ks{sfx}.k, {matches}.qid, coalesce({labels}.label, -1) AS label
         FROM {matches} JOIN ks{sfx} ON {matches}.rank <= ks{sfx}.k LEFT JOIN {labels} ON {labels}.pid = {matches}.pid),
have{sfx} AS (SELECT k, qid, count(*) AS have FROM hits{sfx} GROUP BY k, qid),
votes{sfx} AS (SELECT k, qid, label, count(*) AS n FROM hits{sfx} GROUP BY k, qid, label
          UNION ALL
          SELECT ks{sfx}.k, {queries}.qid, -1 AS label, ks{sfx}.k - coalesce(have{sfx}.have, 0) AS n
          FROM {queries} CROSS JOIN ks{sfx} LEFT JOIN have{sfx} ON have{sfx}.k = ks{sfx}.k AND have{sfx}.qid = {queries}.qid
          WHERE ks{sfx}.k - coalesce(have{sfx}.have, 0) > 0),
pred{sfx} AS (SELECT k, qid, CAST(label AS INTEGER) AS pred FROM (
           SELECT k, qid, label, sum(n) AS n FROM votes{sfx} GROUP BY k, qid, label)
         QUALIFY row_number() OVER (PARTITION BY k, qid ORDER BY n DESC, label) = 1)"""


def _votes(spark, sf, ks):
    q, c = _split(spark, sf)
    m = knn_join(q, c, max(ks))
    return q, c, m, classify.knn_vote(m, c.select("pid", "label"), q.select("qid"), ks)


@register("knn_vote", with_ctes(fx.VEC_CTES, fx.knn_sql(K), _vote_sql(f"[{K}]"))
          + "SELECT qid, pred FROM pred")
def knn_vote(spark, sf):
    _, _, _, p = _votes(spark, sf, [K])
    return p.select("qid", "pred")


@register("knn_vote_ks", with_ctes(fx.VEC_CTES, fx.knn_sql(max(KS)), _vote_sql(KS_SQL))
          + "SELECT k, qid, pred FROM pred")
def knn_vote_ks(spark, sf):
    _, _, _, p = _votes(spark, sf, KS)
    return p


# --------------------------------------------------------------------------- M4 / M5

def multiclass_sql(src: str = "ev") -> str:
    """CTE ``mc(metric, k, value)`` from ``src(k, y_true, y_pred)``."""
    return f"""
conf AS (SELECT k, y_true, y_pred, count(*) AS n FROM {src} GROUP BY k, y_true, y_pred),
tcls AS (SELECT k, y_true AS c, sum(n) AS support,
                sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM conf GROUP BY k, y_true),
pcls AS (SELECT k, y_pred AS c, sum(n) AS predicted FROM conf GROUP BY k, y_pred),
pc AS (SELECT coalesce(tcls.k, pcls.k) AS k, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(predicted, 0) AS predicted
       FROM tcls FULL JOIN pcls ON tcls.k = pcls.k AND tcls.c = pcls.c),
cls AS (SELECT k, tp, support,
               CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r,
               CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f
        FROM pc),
agg AS (SELECT k, sum(tp) / sum(support) AS acc, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm FROM cls GROUP BY k),
mc AS (
  SELECT 'accuracy' AS metric, k, round(acc, 9) AS value FROM agg
  UNION ALL SELECT 'precision/micro', k, round(acc, 9) FROM agg
  UNION ALL SELECT 'precision/macro', k, round(pm, 9) FROM agg
  UNION ALL SELECT 'recall/micro', k, round(acc, 9) FROM agg
  UNION ALL SELECT 'recall/macro', k, round(rm, 9) FROM agg
  UNION ALL SELECT 'f1/micro', k, round(acc, 9) FROM agg
  UNION ALL SELECT 'f1/macro', k, round(fm, 9) FROM agg)"""


_EV = "ev AS (SELECT pred.k, q.label AS y_true, pred.pred AS y_pred FROM pred JOIN q USING (qid))"
MULTICLASS_SQL = with_ctes(fx.VEC_CTES, fx.knn_sql(max(KS)), _vote_sql(KS_SQL), _EV, multiclass_sql())


def _multiclass(spark, sf):
    q, _, _, p = _votes(spark, sf, KS)
    ev = p.join(q.select("qid", F.col("label").alias("y_true")), "qid").withColumnRenamed("pred", "y_pred")
    return metrics.multiclass_metrics(ev)


@register("multiclass_metrics", MULTICLASS_SQL + "SELECT metric, k, value FROM mc")
def multiclass_metrics(spark, sf):
    return _multiclass(spark, sf)


@register("best_over_ks", MULTICLASS_SQL + "SELECT metric, max(value) AS value FROM mc GROUP BY metric")
def best_over_ks(spark, sf):
    return metrics.best_over_ks(_multiclass(spark, sf))


# --------------------------------------------------------------------------- M15 / M19 / P15

@register("misclassified", with_ctes(fx.VEC_CTES, fx.knn_sql(K), _vote_sql(f"[{K}]"))
          + "SELECT q.qid, q.label, pred.pred FROM pred JOIN q USING (qid) WHERE pred.pred <> q.label")
def misclassified(spark, sf):
    q, _, _, p = _votes(spark, sf, [K])
    return (p.join(q.select("qid", "label"), "qid").filter(F.col("pred") != F.col("label"))
            .select("qid", "label", "pred"))


_HARMFUL_SQL = """
wrong AS (SELECT q.qid, q.label FROM pred JOIN q USING (qid) WHERE pred.pred <> q.label),
harmful AS (SELECT DISTINCT m.pid FROM wrong JOIN m USING (qid) JOIN c ON c.pid = m.pid
            WHERE c.label <> wrong.label)"""


def harmful_pids(matches, queries, corpus, preds):
    """Distinct matched pids of misclassified queries with a label other than the true one."""
    wrong = (preds.join(queries.select("qid", "label"), "qid").filter(F.col("pred") != F.col("label"))
             .select("qid", F.col("label").alias("true_label")))
    return (matches.join(wrong, "qid").join(corpus.select("pid", "label"), "pid")
            .filter(F.col("label") != F.col("true_label")).select("pid").distinct())


@register("mine_harmful_pids", with_ctes(fx.VEC_CTES, fx.knn_sql(K), _vote_sql(f"[{K}]"), _HARMFUL_SQL)
          + "SELECT pid FROM harmful")
def mine_harmful_pids(spark, sf):
    q, c, m, p = _votes(spark, sf, [K])
    return harmful_pids(m, q, c, p.select("qid", "pred"))


@register("knn_filtered", with_ctes(
    fx.VEC_CTES, fx.knn_sql(K), _vote_sql(f"[{K}]"), _HARMFUL_SQL,
    "cf AS (SELECT * FROM c WHERE pid NOT IN (SELECT pid FROM harmful))",
    fx.knn_sql(K, src_c="cf", name="m2")) + "SELECT qid, rank, pid, score FROM m2")
def knn_filtered(spark, sf):
    """Search again with the mined harmful passages excluded from the corpus (P15 + M19)."""
    q, c, m, p = _votes(spark, sf, [K])
    bad = harmful_pids(m, q, c, p.select("qid", "pred"))
    kept = c.join(bad, "pid", "left_anti")
    return knn_join(q, kept, K)


# --------------------------------------------------------------------------- J7 table search, M6 keys

@register("search_table", with_ctes(fx.VEC_CTES, fx.knn_sql(K)) + """
SELECT q.qid, coalesce(list(m.pid ORDER BY m.rank) FILTER (WHERE m.pid IS NOT NULL), []::BIGINT[]) AS match_pids,
       coalesce(list(m.score ORDER BY m.rank) FILTER (WHERE m.pid IS NOT NULL), []::DOUBLE[]) AS match_scores
FROM q LEFT JOIN m USING (qid) GROUP BY q.qid""")
def search_table(spark, sf):
    """Table search: every query row gets ``match_pids`` / ``match_scores`` lists in rank
    order; rows without any match keep empty lists (J7)."""
    from vicinity.operators.similarity import with_empty_matches
    q, c = _split(spark, sf)
    packed = with_empty_matches(q.select("qid"), knn_join(q, c, K))
    return packed.select("qid", F.transform("matches", lambda x: x["pid"]).alias("match_pids"),
                         F.transform("matches", lambda x: x["score"]).alias("match_scores"))


@register("metric_keys", MULTICLASS_SQL + """
SELECT 'eval/' || metric || '/' || CAST(k AS VARCHAR) AS key, 0 AS step, value FROM mc""")
def metric_keys(spark, sf):
    """Logged metric keys ``prefix/name/k`` with step 0 (M6)."""
    return metrics.rename_metrics(_multiclass(spark, sf), "eval", 0)
