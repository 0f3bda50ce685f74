"""Phase 6: multi-label classification and metrics.

Input is ML: passage vectors with labels ``{label, 10 + vec_id % 5}`` plus 15
when ``vec_id % 7 = 0``; train = the indexed side, test = the query side.  The
train table is searched against itself for the ML-kNN fit (self included, D6).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinity.operators import metrics, mlknn
from vicinity.operators.similarity import knn_join
from vicinity.plans import fixtures as fx
from vicinity.plans import register, with_ctes
from vicinity.session import checkpoint_dir

K = 10
S = 1.0
TOPK = 2
MLC_KS = (0, 1, 2, 3)     # 0 = the uncut prediction list
DIG = 9


def _data(spark, sf):
    ml = fx.multilabel_vectors(spark, sf)
    train = ml.filter("NOT is_query").select("pid", "vec", "labels")
    test = ml.filter("is_query").select(F.col("pid").alias("qid"), "vec", "labels")
    return train, test


def _model(spark, sf):
    train, test = _data(spark, sf)
    m_tr = knn_join(train.select(F.col("pid").alias("qid"), "vec"), train.select("pid", "vec"), K)
    model = mlknn.fit(train, m_tr, K, S)
    return train, test, model


def _predict(spark, sf):
    train, test, model = _model(spark, sf)
    m_te = knn_join(test.select("qid", "vec"), train.select("pid", "vec"), K)
    return train, test, model, mlknn.predict_long(model, test.select("qid"), m_te, train)


_BASE = with_ctes(fx.ML_CTES, """
tr AS (SELECT pid, vec, labels FROM ml WHERE NOT is_query),
te AS (SELECT pid AS qid, vec, labels FROM ml WHERE is_query),
trq AS (SELECT pid AS qid, vec FROM tr)""", fx.knn_sql(K, src_q="trq", src_c="tr", name="mtr"),
    fx.knn_sql(K, src_q="te", src_c="tr", name="mte"), f"""
trl AS (SELECT pid, unnest(labels) AS label FROM tr),
lab AS (SELECT CAST(unnest(range(mx + 1)) AS INTEGER) AS label FROM (SELECT max(label) AS mx FROM trl)),
ntr AS (SELECT count(*) AS n FROM tr),
nl AS (SELECT label, count(*) AS n_l FROM trl GROUP BY label),
base AS (SELECT lab.label, coalesce(nl.n_l, 0) AS n_l FROM lab LEFT JOIN nl USING (label)),
prior AS (SELECT label, ({S}::DOUBLE + n_l) / ({2 * S}::DOUBLE + (SELECT n FROM ntr)) AS p1 FROM base),
ctr AS (SELECT m.qid, trl.label, count(*) AS j FROM mtr m JOIN trl ON trl.pid = m.pid
        WHERE m.rank <= {K} GROUP BY m.qid, trl.label),
dense AS (SELECT t.pid, b.label, coalesce(c.j, 0) AS j,
                 CASE WHEN list_contains(t.labels, b.label) THEN 1 ELSE 0 END AS mem
          FROM tr t CROSS JOIN base b LEFT JOIN ctr c ON c.qid = t.pid AND c.label = b.label),
cc AS (SELECT label, j, sum(mem) AS c1, sum(1 - mem) AS c0 FROM dense GROUP BY label, j),
grid AS (SELECT base.label, base.n_l, CAST(jj.j AS INTEGER) AS j
         FROM base CROSS JOIN (SELECT unnest(range({K + 1})) AS j) jj),
post AS (SELECT g.label, g.j,
                ({S}::DOUBLE + coalesce(cc.c1, 0)) / ({S * (K + 1)}::DOUBLE + g.n_l) AS post1,
                ({S}::DOUBLE + coalesce(cc.c0, 0)) / ({S * (K + 1)}::DOUBLE + ((SELECT n FROM ntr) - g.n_l)) AS post0
         FROM grid g LEFT JOIN cc ON cc.label = g.label AND cc.j = g.j),
cte AS (SELECT m.qid, trl.label, count(*) AS j FROM mte m JOIN trl ON trl.pid = m.pid
        WHERE m.rank <= {K} GROUP BY m.qid, trl.label),
dte AS (SELECT te.qid, b.label, coalesce(c.j, 0) AS j
        FROM te CROSS JOIN base b LEFT JOIN cte c ON c.qid = te.qid AND c.label = b.label),
sc AS (SELECT d.qid, d.label, p.p1 * po.post1 AS y1, (1.0::DOUBLE - p.p1) * po.post0 AS y0
       FROM dte d JOIN prior p USING (label) JOIN post po ON po.label = d.label AND po.j = d.j),
pl AS (SELECT qid, label, y1 / (y0 + y1) AS r FROM sc WHERE y1 >= y0)""")


@register("mlknn_prior", _BASE + f"SELECT label, round(p1, {DIG}) AS p1, round(1.0::DOUBLE - p1, {DIG}) AS p0 FROM prior")
def mlknn_prior(spark, sf):
    """``p1(l) = (s + n_l) / (2s + N)`` over the dense label range (C3; D4 fixed)."""
    _, _, model = _model(spark, sf)
    return model.prior.select("label", F.round("p1", DIG).alias("p1"), F.round("p0", DIG).alias("p0"))


@register("mlknn_posterior", _BASE + f"SELECT label, j, round(post1, {DIG}) AS post1, round(post0, {DIG}) AS post0 FROM post")
def mlknn_posterior(spark, sf):
    """Posterior over (label, j) from sparse neighbour counts; j = 0 by subtraction."""
    _, _, model = _model(spark, sf)
    return model.posterior.select("label", "j", F.round("post1", DIG).alias("post1"),
                                  F.round("post0", DIG).alias("post0"))


@register("mlknn_predict", _BASE + f"SELECT qid, label, round(r, {DIG}) AS r FROM pl")
def mlknn_predict(spark, sf):
    """Positive labels with confidence for every test row, default-on labels included."""
    _, _, _, p = _predict(spark, sf)
    return p.select("qid", "label", F.round("r", DIG).alias("r"))


@register("mlknn_topk", _BASE + f"""
SELECT te.qid, coalesce(pk.preds, []::INTEGER[]) AS preds
FROM te LEFT JOIN (SELECT qid, list(label ORDER BY r DESC, label)[1:{TOPK}] AS preds FROM pl GROUP BY qid) pk
     USING (qid)""")
def mlknn_topk(spark, sf):
    """Predictions sorted by confidence (descending: D5 decision) cut to the first k."""
    _, test, _, p = _predict(spark, sf)
    packed = mlknn.pack_predictions(p, test.select("qid"), order="desc")
    return packed.select("qid", F.slice("preds", 1, TOPK).alias("preds"))


_KS_SQL = "[" + ", ".join(str(k) for k in MLC_KS) + "]"
_MLC_SQL = _BASE.rstrip() + f""",
ks AS (SELECT CAST(unnest({_KS_SQL}) AS INTEGER) AS k),
pr AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY r DESC, label) AS rn FROM pl),
pk AS (SELECT ks.k, pr.qid, pr.label FROM ks CROSS JOIN pr WHERE ks.k = 0 OR pr.rn <= ks.k),
tk AS (SELECT ks.k, t.qid, t.label FROM ks CROSS JOIN (SELECT qid, unnest(labels) AS label FROM te) t),
bj AS (SELECT coalesce(pk.k, tk.k) AS k, coalesce(pk.qid, tk.qid) AS qid, coalesce(pk.label, tk.label) AS label,
                pk.qid IS NOT NULL AS p, tk.qid IS NOT NULL AS t
         FROM pk FULL JOIN tk ON pk.k = tk.k AND pk.qid = tk.qid AND pk.label = tk.label),
conf AS (SELECT k, label, CAST(sum(CASE WHEN p AND t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                CAST(sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                CAST(sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn
         FROM bj GROUP BY k, label),
nte AS (SELECT count(*) AS n FROM te),
nlab AS (SELECT greatest((SELECT max(label) FROM trl), (SELECT max(label) FROM (SELECT unnest(labels) AS label FROM te))) + 1 AS L),
ex AS (SELECT ks.k, (SELECT n FROM nte) - count(DISTINCT CASE WHEN NOT (p AND t) THEN qid END) AS n_exact
       FROM ks LEFT JOIN bj ON bj.k = ks.k GROUP BY ks.k),
per AS (SELECT k, tp, fp, fn, tp / (tp + fp + 1e-5) AS p, tp / (tp + fn + 1e-5) AS r FROM conf),
tot AS (SELECT k, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn,
               sum(p) / (SELECT L FROM nlab) AS pm, sum(r) / (SELECT L FROM nlab) AS rm,
               sum(2.0 * p * r / (p + r + 1e-5)) / (SELECT L FROM nlab) AS fm
        FROM per GROUP BY k),
mm AS (SELECT tot.*, (SELECT n FROM nte)::DOUBLE AS n, (SELECT L FROM nlab)::DOUBLE AS nl, ex.n_exact,
              tot.tp / (tot.tp + tot.fp + 1e-5) AS ap, tot.tp / (tot.tp + tot.fn + 1e-5) AS ar
       FROM tot JOIN ex USING (k)),
mlc AS (
  SELECT 'confusion/tp' AS metric, k, round(tp, {DIG}) AS value FROM mm
  UNION ALL SELECT 'confusion/fp', k, round(fp, {DIG}) FROM mm
  UNION ALL SELECT 'confusion/tn', k, round(n * nl - tp - fp - fn, {DIG}) FROM mm
  UNION ALL SELECT 'confusion/fn', k, round(fn, {DIG}) FROM mm
  UNION ALL SELECT 'accuracy', k, round(n_exact / n, {DIG}) FROM mm
  UNION ALL SELECT 'hamming', k, round((fp + fn) / (n * nl), {DIG}) FROM mm
  UNION ALL SELECT 'precision/micro', k, round(ap, {DIG}) FROM mm
  UNION ALL SELECT 'precision/macro', k, round(pm, {DIG}) FROM mm
  UNION ALL SELECT 'recall/micro', k, round(ar, {DIG}) FROM mm
  UNION ALL SELECT 'recall/macro', k, round(rm, {DIG}) FROM mm
  UNION ALL SELECT 'f1/micro', k, round(2.0 * ap * ar / (ap + ar + 1e-5), {DIG}) FROM mm
  UNION ALL SELECT 'f1/macro', k, round(fm, {DIG}) FROM mm)
"""


def _mlc(spark, sf):
    train, test, model, p = _predict(spark, sf)
    packed = mlknn.pack_predictions(p, test.select("qid"), order="desc")
    preds = (packed.select("qid", F.posexplode("preds").alias("pos", "label"))
             .withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in MLC_KS]),
                                                 lambda k: (k == 0) | (F.col("pos") < k))))
             .select("k", F.col("qid").alias("id"), "label"))
    truth = test.select(F.col("qid").alias("id"), F.explode("labels").alias("label"))
    both = metrics.multilabel_join(preds, truth, MLC_KS)
    conf = metrics.multilabel_confusion(preds, truth, MLC_KS, both=both)
    exact = metrics.subset_exact(preds, truth, MLC_KS, test.select(F.col("qid").alias("id")), both=both)
    stats = test.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("labels")).alias("mx")).first()
    n_labels = max(model.num_labels, int(stats["mx"]) + 1)
    return conf, exact, int(stats["n"]), n_labels


@register("mlc_confusion", _MLC_SQL + "SELECT k, label, tp, fp, fn FROM conf")
def mlc_confusion(spark, sf):
    """Per-class tp / fp / fn for every cut k."""
    conf, _, _, _ = _mlc(spark, sf)
    return conf.select("k", "label", "tp", "fp", "fn")


@register("mlc_metrics", _MLC_SQL + "SELECT metric, value FROM mlc WHERE k = 0")
def mlc_metrics(spark, sf):
    """Subset accuracy, Hamming loss, P/R/F1 micro + macro of the uncut predictions (M8, M9)."""
    conf, exact, n, n_labels = _mlc(spark, sf)
    m = metrics.multilabel_metrics(conf, n, n_labels, exact)
    return m.filter(F.col("k") == 0).select("metric", "value")


@register("mlc_metrics_at_k", _MLC_SQL + "SELECT metric, k, value FROM mlc")
def mlc_metrics_at_k(spark, sf):
    """Multi-label metrics for every cut k and uncut (k = 0)."""
    conf, exact, n, n_labels = _mlc(spark, sf)
    return metrics.multilabel_metrics(conf, n, n_labels, exact)


@register("mlc_per_class", _MLC_SQL + f"""
SELECT label, tp, fp, fn, (SELECT n FROM nte) - tp - fp - fn AS tn,
       round(tp / (tp + fp + 1e-5), {DIG}) AS precision, round(tp / (tp + fn + 1e-5), {DIG}) AS recall,
       round(2.0 * (tp / (tp + fp + 1e-5)) * (tp / (tp + fn + 1e-5))
             / ((tp / (tp + fp + 1e-5)) + (tp / (tp + fn + 1e-5)) + 1e-5), {DIG}) AS f1
FROM conf WHERE k = 0""")
def mlc_per_class(spark, sf):
    """Per-class precision / recall / F1 and tp / fp / tn / fn of the uncut predictions (M10; D15)."""
    conf, _, n, _ = _mlc(spark, sf)
    return metrics.per_class_metrics(conf.filter(F.col("k") == 0), n).drop("k")


# labels of the rows, none on every third; predicted are the labels from 10 on, so some rows are exact with no label
_EMPTY_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN [] ELSE [label, CAST(10 + vec_id % 5 AS INTEGER)] END AS t,
                  CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN [] WHEN vec_id % 3 = 0 THEN [10]
                       WHEN vec_id % 2 = 0 THEN [label, CAST(10 + vec_id % 5 AS INTEGER)] ELSE [label] END AS p
           FROM embeddings)
SELECT 0 AS k, count(*) AS n, count(*) FILTER (list_sort(list_distinct(t)) = list_sort(list_distinct(p))) AS n_exact
FROM r"""


@register("mlc_empty_rows", _EMPTY_SQL)
def mlc_empty_rows(spark, sf):
    """Subset accuracy counts rows without true and predicted labels as exact (M8)."""
    v = fx.vectors(spark, sf).select(F.col("pid").alias("id"), "label")
    own, none = F.array("label", (10 + F.col("id") % 5).cast("int")), F.array().cast("array<int>")
    third, even = F.col("id") % 3 == 0, F.col("id") % 2 == 0
    truth = v.select("id", F.explode(F.when(third, none).otherwise(own)).alias("label"))
    preds = v.select(F.lit(0).alias("k"), "id", F.explode(
        F.when(third & even, none).when(third, F.array(F.lit(10))).when(even, own).otherwise(F.array("label"))).alias("label"))
    exact = metrics.subset_exact(preds, truth, [0], v.select("id"))
    return exact.join(v.agg(F.lit(0).alias("k"), F.count(F.lit(1)).alias("n")), "k").select("k", "n", "n_exact")


@register("mlknn_saved", _BASE + f"SELECT label, j, round(post1, {DIG}) AS post1, round(post0, {DIG}) AS post0 FROM post")
def mlknn_saved(spark, sf):
    """The fitted model written to the shared folder and loaded again."""
    _, _, model = _model(spark, sf)
    path = f"{checkpoint_dir(spark)}/mlknn-{uuid.uuid4().hex}"
    model.save(path)
    back = mlknn.MLKNNModel.load(spark, path)
    return back.posterior.select("label", "j", F.round("post1", DIG).alias("post1"), F.round("post0", DIG).alias("post0"))
