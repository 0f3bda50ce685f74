"""Phase 8: explanation, analysis, MLlib-backed operators and connectors.

J11, M13, M14, M20, E8, U6 ('colbert' form) with oracles; E1, E12, C8, N13
checked rows-only (MLlib training) plus invariants in the tests; S1 / S2 as
write-then-read round trips of data derived from the fixtures.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from vicinity.functions.hashing import uniform, uniform_sql
from vicinity.functions.text import simple_tokens
from vicinity.functions.vectors import dot
from vicinity.operators import classify, corpus as cp, encode, metrics, sampling, subword
from vicinity.operators.linear_head import LinearHead
from vicinity.operators.similarity import knn_join, maxsim_join
from vicinity.plans import corpus as pc
from vicinity.plans import fixtures as fx
from vicinity.plans import index as pidx
from vicinity.plans import register, with_ctes
from vicinity.plans.search import _vote_sql
from vicinity.pipeline import SearchConfig, build_index, search
from vicinity.session import checkpoint_dir, cut_lineage
from vicinity.functions import text as tx
from vicinity.functions.vectors import hashed_token_vector_sql
from vicinity.plans.text import TOKENS_CAPPED_SQL
from vicinity.plans.vectors import hv_ctes
from vicinity.sources import jsonl, tables
from vicinity.sources.tables import load

K = 10
COMPRESS_DIM = 16
W_SEED = 99
# ---- fixed values: word-vector training (E1) -----------------------------------------
# vector size 128, window 5, minimum count 5, 10 epochs
W2V_SIZE, W2V_WINDOW, W2V_MIN_COUNT, W2V_EPOCHS = 128, 5, 5, 10
# -------------------------------------------------------------------------------------


# --------------------------------------------------------------------------- J11

def _mv_split(spark, sf):
    mv = fx.multi_vectors(spark, sf)
    qv = mv.filter("is_query").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec")
    dv = mv.filter("NOT is_query").select("pid", "pos", "vec")
    return mv, qv, dv


def token_alignment_table(qv, dv, pairs):
    """Similarity of every (query vector, document vector) of the chosen pairs."""
    a = pairs.select("qid", "pid").join(qv.select("qid", "qpos", F.col("vec").alias("qvec")), "qid")
    b = a.join(dv.select("pid", "pos", F.col("vec").alias("dvec")), "pid")
    return b.select("qid", "pid", "qpos", "pos", F.round(dot("qvec", "dvec"), 6).alias("sim"))


_ALIGN_SQL = with_ctes(fx.MV_CTES, fx.maxsim_sql(1), """
al AS (SELECT ms.qid, ms.pid, qv.qpos, dv.pos, round(list_inner_product(qv.vec, dv.vec), 6) AS sim
       FROM ms JOIN qv USING (qid) JOIN dv ON dv.pid = ms.pid)""")


def _alignment(spark, sf):
    _, qv, dv = _mv_split(spark, sf)
    top1 = maxsim_join(qv, dv, 1)
    return token_alignment_table(qv, dv, top1)


@register("token_alignment", _ALIGN_SQL + "SELECT qid, pid, qpos, pos, sim FROM al")
def token_alignment(spark, sf):
    """Full (query vector x document vector) similarity matrix of each query and its best match."""
    return _alignment(spark, sf)


@register("token_alignment_max", _ALIGN_SQL + """
SELECT qid, pid, qpos, pos, sim FROM al
QUALIFY rank() OVER (PARTITION BY qid, pid, qpos ORDER BY sim DESC) = 1""")
def token_alignment_max(spark, sf):
    """Only the best document vector(s) per query vector, ties kept (J11 ``max_only``)."""
    al = _alignment(spark, sf)
    w = Window.partitionBy("qid", "pid", "qpos").orderBy(F.col("sim").desc())
    return al.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


# --------------------------------------------------------------------------- U6 colbert form + M20

_COLBERT_SQL = with_ctes(fx.MV_CTES, fx.maxsim_sql(K), """
q AS (SELECT DISTINCT qv.qid, mvl.label FROM qv JOIN mvl ON mvl.pid = qv.qid),
c AS (SELECT DISTINCT dv.pid, mvl.label FROM dv JOIN mvl ON mvl.pid = dv.pid)""", _vote_sql(f"[{K}]", matches="ms"))


def _colbert(spark, sf):
    mv, qv, dv = _mv_split(spark, sf)
    lab = fx.multi_vector_labels(mv)
    m = maxsim_join(qv, dv, K)
    queries = qv.select("qid").distinct()
    preds = classify.knn_vote(m, lab, queries, [K])
    return mv, lab, preds


@register("colbert_vote", _COLBERT_SQL + "SELECT qid, pred FROM pred")
def colbert_vote(spark, sf):
    """Multi-vector pipeline: MaxSim top-10 and neighbour vote (U6 'colbert')."""
    _, _, p = _colbert(spark, sf)
    return p.select("qid", "pred")


@register("class_separation", _COLBERT_SQL + """
SELECT q.label, pred.pred = q.label AS correct, count(*) AS n_vectors, count(DISTINCT q.qid) AS n_passages
FROM pred JOIN q USING (qid) JOIN qv ON qv.qid = q.qid GROUP BY q.label, pred.pred = q.label""")
def class_separation(spark, sf):
    """Vector rows of the query passages split by (true label, prediction right / wrong)."""
    mv, lab, p = _colbert(spark, sf)
    qrows = mv.filter("is_query").select(F.col("pid").alias("qid"), "pos")
    j = (p.select("qid", "pred").join(lab.select(F.col("pid").alias("qid"), "label"), "qid")
         .withColumn("correct", F.col("pred") == F.col("label")).join(qrows, "qid"))
    return j.groupBy("label", "correct").agg(F.count(F.lit(1)).alias("n_vectors"),
                                             F.countDistinct("qid").alias("n_passages"))


# --------------------------------------------------------------------------- M13 faithfulness, M14 ARI

_FAITH_SQL = with_ctes(fx.VEC_CTES, pidx._cent_sql(), fx.knn_sql(K), _vote_sql(f"[{K}]"),
                       "base AS (SELECT qid, pred AS a FROM pred)",
                       pidx._probe_sql(2, K).strip().replace("pm AS (", "m2 AS ("),
                       _vote_sql(f"[{K}]", matches="m2", sfx="b"))


@register("faithfulness", _FAITH_SQL + """,
j AS (SELECT q.qid, q.label, base.a, predb.pred AS b FROM q JOIN base USING (qid) JOIN predb USING (qid)),
s AS (SELECT 'all' AS subset, * FROM j UNION ALL SELECT 'a_right', * FROM j WHERE a = label
      UNION ALL SELECT 'a_wrong', * FROM j WHERE a <> label)
SELECT subset, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS precision,
       round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS recall,
       round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS f1, count(*) AS n
FROM s GROUP BY subset""")
def faithfulness(spark, sf):
    """Agreement (micro P / R / F1) of the 2-cell IVF vote with the exact vote, on all
    rows and on rows where the exact vote is right / wrong (M13; D15: recall reported)."""
    q, c = fx.split_vectors(spark, sf)
    exact = classify.knn_vote(knn_join(q, c, K), c.select("pid", "label"), q.select("qid"), [K])
    _, approx_m = pidx._ivf(spark, sf, K, ncells=2)
    approx = classify.knn_vote(approx_m, c.select("pid", "label"), q.select("qid"), [K])
    j = (q.select("qid", "label").join(exact.select("qid", F.col("pred").alias("a")), "qid")
         .join(approx.select("qid", F.col("pred").alias("b")), "qid"))
    subset = F.explode(F.array(
        F.lit("all"), F.when(F.col("a") == F.col("label"), F.lit("a_right")).otherwise(F.lit("a_wrong"))))
    agree = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    s = j.select(subset.alias("subset"), agree.alias("agree"))
    v = F.round(F.avg("agree"), 9)
    return s.groupBy("subset").agg(v.alias("precision"), v.alias("recall"), v.alias("f1"),
                                   F.count(F.lit(1)).alias("n"))


@register("adjusted_rand", with_ctes(pidx._cent_sql(), pidx._ASSIGN_SQL, """
ct AS (SELECT asg.cell, e.label, count(*)::DOUBLE AS n FROM asg JOIN embeddings e ON e.vec_id = asg.pid
       GROUP BY asg.cell, e.label),
sij AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS n FROM ct),
sa AS (SELECT sum(m * (m - 1) / 2) AS sa FROM (SELECT cell, sum(n) AS m FROM ct GROUP BY cell)),
sb AS (SELECT sum(m * (m - 1) / 2) AS sb FROM (SELECT label, sum(n) AS m FROM ct GROUP BY label))""") + """
SELECT round(CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) THEN 1.0
             ELSE (sij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) END, 9) AS ari
FROM sij, sa, sb""")
def adjusted_rand(spark, sf):
    """Adjusted Rand index of the centroid cells against the labels."""
    asg = pidx._assign(spark, sf)
    lab = load(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), "label")
    return metrics.adjusted_rand_index(asg.join(lab, "pid"), "cell", "label")


# --------------------------------------------------------------------------- E8 linear compression

def compression_matrix_sql(dim: int, out: int) -> str:
    return (f"wm AS (SELECT i, j, 2.0 * {uniform_sql(W_SEED, 'i', 'j')} - 1.0 AS w "
            f"FROM range({dim}) r1(i), range({out}) r2(j))")


def linear_compress(vectors, weight: np.ndarray, normalize: bool = True):
    """``vec @ W`` without bias in Arrow batches; ``W`` is a model parameter of fixed
    shape (dim x compression_dim), shipped with the closure (E8, E7)."""
    W = np.asarray(weight, dtype=np.float64)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            vec = b.column("vec")
            X = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            Y = X @ W
            if normalize:
                n = np.linalg.norm(Y, axis=1, keepdims=True)
                Y = np.where(n > 0, Y / np.where(n > 0, n, 1), Y)
            yield pa.RecordBatch.from_pydict({"pid": b.column("pid"),
                                              "vec": pa.array(list(Y), pa.list_(pa.float64()))})

    return vectors.select(F.col("pid").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(
        run, "pid long, vec array<double>")


def compression_matrix(spark, dim: int, out: int) -> np.ndarray:
    """Seeded pseudo-random weights in [-1, 1): W[i, j] = 2 u(seed, i, j) - 1 (dim x out values)."""
    g = (spark.range(dim).select(F.col("id").alias("i"))
         .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(out - 1)).cast("array<long>")))
         .select("i", "j", (2.0 * uniform(W_SEED, "i", "j") - 1.0).alias("w")))
    W = np.zeros((dim, out))
    for r in g.collect():   # dim x out model weights, not data
        W[r["i"], r["j"]] = r["w"]
    return W


@register("linear_compress", with_ctes(compression_matrix_sql(64, COMPRESS_DIM), """
pr AS (SELECT e.vec_id AS pid, wm.j, sum(e.embedding[wm.i + 1]::DOUBLE * wm.w) AS y
       FROM embeddings e JOIN wm ON true GROUP BY e.vec_id, wm.j),
pv AS (SELECT pid, list(y ORDER BY j) AS v FROM pr GROUP BY pid)""") + """
SELECT pid, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0) AS vec FROM pv""")
def linear_compress_query(spark, sf):
    """Vectors compressed to 16 dimensions by a weight matrix without bias, then L2 normalised."""
    dim = pidx._dim(spark, sf)
    W = compression_matrix(spark, dim, COMPRESS_DIM)
    v = fx.vectors(spark, sf).select("pid", "vec")
    out = linear_compress(v, W)
    return out.select("pid", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))


# --------------------------------------------------------------------------- rows-only MLlib forms

@register("word2vec_knn")
def word2vec_knn(spark, sf):
    """Word2Vec token vectors (size 128, window 5, min count 5, 10 iterations; E1) looked up
    per word and L2-normalised (E2), MaxSim kNN vote of test documents (J3, C1) -
    the word-vector classification pipeline."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    dl = fx.labelled_docs(spark, sf).withColumn("split", pc._doc_test_split())
    toks = dl.select("pid", "split", "label", simple_tokens("text").alias("tokens"))
    train = toks.filter(F.col("split") == "train")
    # as many training partitions as the scan has splits: one task never sees the whole corpus
    parts = max(dl.rdd.getNumPartitions(), 1)
    w2v = Word2Vec(numPartitions=parts, vectorSize=W2V_SIZE, windowSize=W2V_WINDOW, minCount=W2V_MIN_COUNT, maxIter=W2V_EPOCHS, seed=12345,
                   inputCol="tokens", outputCol="w2v").fit(train)
    vocab = w2v.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))
    # tokens meet the vocabulary in the blocks of the join: no vector is made per token
    tokens = toks.select("pid", "split", F.explode("tokens").alias("token"))
    qt = tokens.filter(F.col("split") == "test").select(F.col("pid").alias("qid"), "token")
    m = maxsim_join(qt, tokens.filter(F.col("split") == "train").select("pid", "token"), K, vocabulary=vocab)
    q = toks.filter(F.col("split") == "test").select(F.col("pid").alias("qid"))
    return classify.knn_vote(m, toks.select("pid", "label"), q, [K]).select("qid", "pred")


_GRAMS = f"""
vt AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS_CAPPED_SQL}) AS token FROM documents) GROUP BY token),
vr AS (SELECT token, n, {hashed_token_vector_sql('token')} AS raw FROM vt WHERE n >= {W2V_MIN_COUNT}),
vv AS (SELECT token, n, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) AS vec FROM vr),
gr AS (SELECT token, n, unnest(list_distinct(list_transform(list_distinct(flatten(list_transform([3, 4, 5, 6], lambda s:
                list_transform(range(1, greatest(length(token) + 2 - s + 2, 1)), lambda i: substr('<' || token || '>', i, s))))),
                lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % 50000))) AS bucket FROM vt),
bk AS (SELECT bucket, [{', '.join(f'sum(gr.n * vec[{i + 1}]) / sum(gr.n)' for i in range(8))}] AS vec
       FROM gr JOIN vv USING (token) GROUP BY bucket),
oo AS (SELECT token, [{', '.join(f'avg(bk.vec[{i + 1}])' for i in range(8))}] AS vec
       FROM gr JOIN bk USING (bucket) WHERE gr.n < {W2V_MIN_COUNT} GROUP BY token)"""


@register("subword_vectors", with_ctes(_GRAMS) + """
SELECT token, true AS known, list_transform(vec, lambda x: round(x, 6) + 0.0) AS vec FROM vv
UNION ALL SELECT vt.token, false, coalesce(list_transform(oo.vec, lambda x: round(x, 6) + 0.0), [0.0 FOR i IN range(8)])
FROM vt LEFT JOIN oo USING (token) WHERE vt.n < 5""")
def subword_vectors(spark, sf):
    """Vectors of all tokens of ``documents``: those seen five times or more from the vocabulary, the others composed from
    50,000 buckets of character n-grams (E1, E2)."""
    long = load(spark, sf, "documents").select(F.explode(simple_tokens("text")).alias("token"))
    counted = cut_lineage(long.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    vocab = cut_lineage(encode.HashedTokenEncoder().encode_tokens(counted.filter(F.col("n") >= W2V_MIN_COUNT)))
    buckets = cut_lineage(subword.train_buckets(vocab, buckets=50_000))
    every = subword.subword_vocabulary(counted, vocab, buckets, buckets=50_000)
    return every.select("token", "known", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))


def passage_pca(pairs, query_vecs, doc_vecs):
    """Two principal components of each query passage, applied to its own and its match's vectors.

    ``pairs(qid, pid)``, ``query_vecs(qid, qpos, vec)``, ``doc_vecs(pid, pos, vec)`` ->
    ``(qid, side, pos, x, y)``.  One group per pair (as long as two passages); a component's sign makes its entry of
    largest size positive.
    """
    left = pairs.join(query_vecs, "qid").select("qid", "pid", F.lit("query").alias("side"), F.col("qpos").cast("int").alias("pos"), "vec")
    right = pairs.join(doc_vecs, "pid").select("qid", "pid", F.lit("match").alias("side"), F.col("pos").cast("int").alias("pos"), "vec")

    def project(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist())
        X = np.array(t.column("vec").to_pylist(), dtype=np.float64)
        centre = X[side == "query"].mean(0)
        _, _, V = np.linalg.svd(X[side == "query"] - centre, full_matrices=False)
        V = np.concatenate([V[:2], np.zeros((max(0, 2 - len(V)), X.shape[1]))])
        V *= np.where(V[np.arange(2), np.abs(V).argmax(1)] < 0, -1, 1)[:, None]
        Y = (X - centre) @ V.T
        return pa.table({"qid": t.column("qid"), "side": t.column("side"), "pos": t.column("pos"), "x": Y[:, 0], "y": Y[:, 1]})

    vec = F.col("vec").cast("array<double>").alias("vec")
    return (left.unionByName(right).select("qid", "pid", "side", "pos", vec).groupBy("qid", "pid")
            .applyInArrow(project, "qid long, side string, pos int, x double, y double"))


@register("pca_2d")
def pca_2d(spark, sf):
    """Each query passage's vectors and those of its best match in the passage's own two principal components."""
    _, qv, dv = _mv_split(spark, sf)
    return passage_pca(maxsim_join(qv, dv, 1).select("qid", "pid"), qv, dv)


# the squared lengths and distances in the plane, on two dimensions of the vectors, where the projection is a rotation
@register("pca_distances", with_ctes(fx.MV_CTES, fx.maxsim_sql(1), """
p AS (SELECT ms.qid, 'query' AS side, qv.qpos AS pos, qv.vec[1:2] AS v FROM ms JOIN qv USING (qid)
      UNION ALL SELECT ms.qid, 'match', dv.pos, dv.vec[1:2] FROM ms JOIN dv USING (pid)),
c AS (SELECT qid, avg(v[1]) AS a, avg(v[2]) AS b FROM p WHERE side = 'query' GROUP BY qid)""") + """
SELECT qid, side, pos, round((v[1] - a) ^ 2 + (v[2] - b) ^ 2, 6) + 0.0 AS sq FROM p JOIN c USING (qid)""")
def pca_distances(spark, sf):
    """Squared distance from the passage's centre in its principal plane, for two-dimensional vectors."""
    _, qv, dv = _mv_split(spark, sf)
    pairs = maxsim_join(qv, dv, 1).select("qid", "pid")
    cut = F.slice(F.col("vec").cast("array<double>"), 1, 2).alias("vec")
    p = passage_pca(pairs, qv.select("qid", "qpos", cut), dv.select("pid", "pos", cut))
    return p.select("qid", "side", "pos", (F.round(F.col("x") ** 2 + F.col("y") ** 2, 6) + F.lit(0.0)).alias("sq"))


@register("linear_baseline")
def linear_baseline(spark, sf):
    """Linear head baseline: multinomial logistic regression without bias on passage
    vectors, arg-max prediction for the test side (C8)."""
    from pyspark.ml.functions import array_to_vector
    q, c = fx.split_vectors(spark, sf)
    train = c.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"),
                     F.col("label").cast("double").alias("label"))
    test = q.select("qid", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    _, pred = classify.linear_head(train, test)
    return pred.select("qid", F.col("prediction").cast("int").alias("pred"))


@register("linear_predict", with_ctes(fx.VEC_CTES, """
w AS (SELECT label, [{}] AS weight FROM c GROUP BY label)""".format(", ".join(f"avg(vec[{i + 1}])" for i in range(64)))) + """
SELECT qid, pred, score FROM (
  SELECT q.qid, w.label AS pred, round(list_inner_product(q.vec::DOUBLE[], w.weight), 6) AS score FROM q, w)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pred) = 1""")
def linear_predict(spark, sf):
    """Linear head with fixed weights (mean vector of each class), stored, loaded and applied."""
    q, c = fx.split_vectors(spark, sf)
    mean = F.array(*(F.avg(F.col("vec")[i].cast("double")) for i in range(64)))
    path = _scratch(spark, "linear-head")
    LinearHead(c.groupBy("label").agg(mean.alias("weight"))).save(path)
    return LinearHead.load(spark, path).predict(q.select("qid", "vec"))


REMINE_ROUND = 1
REMINE_ROUNDS = (1, 2, 3)


def remine_seed(number: int) -> int:
    """Seed of a round, from (seed, round)."""
    return 42 * 1000 + number


def _remine_sql(number: int) -> str:
    from vicinity.plans import sampling as ps
    seed = remine_seed(number)
    base = ps._SEARCHED.rstrip() + "," + ps._weights_sql("scores") + "," + ps._DRAW_SQL
    sql = base.replace(f"md5('{ps.SEED}' ||", f"md5('{seed}' ||")
    sql = sql.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT vec_id FROM sub))")
    sub = (f"sub AS (SELECT vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY "
           f"{uniform_sql(seed, 'vec_id')}, vec_id) <= ceil(CAST(0.5 AS DOUBLE) * count(*) OVER ())),\n")
    return sql.replace("WITH ", "WITH " + sub, 1) + f"SELECT {number} AS round, anchor, slot, pid FROM tup"


def remine(passages, number: int, find, k: int = K, n_pos: int = 1, n_neg: int = 2, nway: int = 4, share: float = 0.5):
    """Tuples of one re-mining round ``(round, anchor, slot, pid)``.

    ``passages(pid, label, vec)``; a fresh seeded ``share`` of them is indexed and searched against itself by
    ``find(sub, k)`` -> matches, which any index can serve; candidates, weights and the draw follow, all seeded by
    (seed, round).
    """
    seed = remine_seed(number)
    sub = cut_lineage(cp.subsample(passages, share, seed))
    cands = sampling.searched_candidates(find(sub, k), sub.select("pid", "label"), n_pos, n_neg, seed)
    t = sampling.draw_tuples(sampling.candidate_weights(cands, "scores"), nway, seed)
    return t.select(F.lit(number).alias("round"), "anchor", "slot", "pid")


def _flat_matches(sub, k):
    index = build_index(sub.select("pid", "vec"))
    return search(index, sub.select(F.col("pid").alias("qid"), "vec"), SearchConfig(k=k))


@register("remine_rounds", " UNION ALL ".join(f"SELECT * FROM ({_remine_sql(r)})" for r in REMINE_ROUNDS))
def remine_rounds(spark, sf):
    """Several re-mining rounds, each written by its number before the next begins."""
    p = fx.vectors(spark, sf).select("pid", "label", "vec")
    path = _scratch(spark, "remine")
    for number in REMINE_ROUNDS:
        remine(p, number, _flat_matches).drop("round").write.parquet(f"{path}/round={number}")
    return spark.read.parquet(path).select(F.col("round").cast("int").alias("round"), "anchor", "slot", "pid")


@register("remine_round", _remine_sql(REMINE_ROUND))
def remine_round(spark, sf):
    """One re-mining round (N13) as a batch job parametrised by the round: a fresh seeded
    half subsample of the passages, the flat index rebuilt on it and searched against
    itself, searched candidates, score weights and a weighted n-way draw - all seeded
    by (seed, round)."""
    p = fx.vectors(spark, sf).select("pid", "label", "vec")
    return remine(p, REMINE_ROUND, _flat_matches)


# --------------------------------------------------------------------------- S1 / S2 round trips

def _scratch(spark, name):
    """A path of its own for every call: an earlier result may still be read."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("jsonl_corpus", """
SELECT d.doc_id AS pid, d.source || ' \n' || d.text AS text,
       CASE WHEN l.doc_id IS NULL THEN []::INTEGER[] ELSE [l.quality, 2 + l.toxic] END AS labels
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jsonl_corpus(spark, sf):
    """Documents written as gzip latin-1 JSON lines (uid, title, content, target_ind) and
    read back by the corpus reader (S1), title and text concatenated (P2)."""
    d = load(spark, sf, "documents").select("doc_id", "source", "text")
    lab = load(spark, sf, "labels")
    labels = F.when(F.col("quality").isNull(), F.array().cast("array<int>")).otherwise(
        F.array(F.col("quality"), F.lit(2) + F.col("toxic")))
    src = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("uid"), F.col("source").alias("title"),
                                                "text", labels.alias("labels"))
    path = _scratch(spark, "jsonl-corpus")
    jsonl.write_jsonl_corpus(src, path)
    back = jsonl.read_jsonl_corpus(spark, path)
    return back.select(F.col("uid").cast("long").alias("pid"), cp.concat_fields("title", "text").alias("text"), "labels")


@register("jsonl_no_uid", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pid, source AS title, text FROM documents")
def jsonl_no_uid(spark, sf):
    """A corpus whose lines have no id: the line number is the id."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("_order"), F.col("source").alias("title"), "text",
                                             F.array().cast("array<int>").alias("labels"))
    path = _scratch(spark, "jsonl-no-uid")
    jsonl.write_jsonl_corpus(d.repartitionByRange(4, "_order").sortWithinPartitions("_order").drop("_order"), path)
    return jsonl.read_jsonl_corpus(spark, path).select("pid", "title", "text")


@register("label_names", pc._PRUNE_SQL + "SELECT label_id, name FROM dict")
def label_names(spark, sf):
    """Label dictionary written one name per line and read back, id = line number."""
    _, d = pc._prune(spark, sf)
    path = _scratch(spark, "label-names")
    jsonl.write_label_names(d, path)
    return jsonl.read_label_names(spark, path)


# --------------------------------------------------------------------------- S3 / S4 / S5 / S10 / W5

@register("saved_split", f"""
SELECT doc_id AS pid, source, 'test' AS split FROM documents WHERE {fx.query_flag_sql('doc_id')}""")
def saved_split(spark, sf):
    """Documents saved by split and one split loaded again (S3, S4): the reader prunes to that split's files."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "source",
                                             F.when(fx.query_flag("doc_id"), "test").otherwise("train").alias("split"))
    path = _scratch(spark, "splits")
    tables.save_splits(d, path)
    return tables.load_split(spark, path, "test")


@register("head_rows", "SELECT doc_id AS pid, source FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark, sf):
    """The first rows of a table in id order, for a look at it (W5: a top-k report)."""
    return (load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "source").orderBy("pid").limit(5))


INLINE = ("of the and that", "der die das und", "les que de la")


@register("inline_query_search", with_ctes(
    "iq AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(INLINE)) + ") t(item_id, text))",
    hv_ctes("iq", "item_id", "bq"), "qv AS (SELECT pid AS qid, pos AS qpos, vec FROM bq)", hv_ctes(distinct=True),
    fx.maxsim_sql(K, "qv", "dt")) + "SELECT qid, rank, pid, score FROM ms")
def inline_query_search(spark, sf):
    """Query texts given inline by the caller (S10), searched in all documents by MaxSim."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    enc = encode.HashedTokenEncoder()
    q = enc.encode_queries(tables.inline_texts(spark, INLINE).withColumnRenamed("pid", "qid"), "qid")
    return maxsim_join(q.select("qid", "qpos", "vec"), None, K, packed_docs=encode.token_lists(docs, distinct=True),
                       encode=encode.hashed_vectors_batch)


@register("marker_vector", with_ctes(f"""
sq AS (SELECT doc_id AS pid, ['{tx.CLS_TOKEN}'] || (['{tx.DOC_MARKER}'] || {TOKENS_CAPPED_SQL})
              || ['{tx.SEP_TOKEN}'] AS seq FROM documents),
mk AS (SELECT pid, {hashed_token_vector_sql('seq[2]')} AS raw FROM sq)""") + """
SELECT pid, list_transform(raw, lambda x: round(x / sqrt(list_inner_product(raw, raw)), 6) + 0.0) AS vec FROM mk""")
def marker_vector(spark, sf):
    """Vector at the marker position of every encoder sequence (E10 ``second``)."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    seq = encode.sequence_tokens(docs, tx.DOC_MARKER).filter(F.col("pos") == 1)
    tv = encode.HashedTokenEncoder().encode_tokens(seq.select("pid", "pos", "token"))
    v = encode.position_vectors(tv, "second")
    return v.select("pid", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))
