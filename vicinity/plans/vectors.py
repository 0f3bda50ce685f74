"""Phase 3b / 4: vectors from text and late-interaction search.

E2, E5, E6, E9, E10, E11 on hashed token vectors (HV) of whole ``documents``
texts; J3 MaxSim on multi-vector passages (MV) and on HV; the single-vector
("sbert"-style) pipeline E5 + J1 + C1; skip-list mining (M18) and filtering (P14).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions import text as tx
from vicinity.functions.vectors import hashed_token_vector_sql
from vicinity.operators import classify, encode
from vicinity.operators.similarity import knn_join, maxsim_join, small_side
from vicinity.plans import corpus as pc
from vicinity.plans import fixtures as fx
from vicinity.plans import register, with_ctes
from vicinity.pipeline import ClassificationPipeline, SearchConfig
from vicinity.plans.search import _vote_sql
from vicinity.plans.text import TOKENS_CAPPED_SQL
from vicinity.sources.tables import load

K = 10
DIM = encode.HASHED_DIM


def rounded(col="vec"):
    """Six digits; adding zero turns -0.0, whose sign depends on summation order, into 0.0."""
    return F.transform(col, lambda x: F.round(x, 6) + F.lit(0.0))


def rounded_sql(col="vec"):
    return f"list_transform({col}, lambda x: round(x, 6) + 0.0)"


def _norm_sql(raw: str) -> str:
    return f"list_transform({raw}, lambda x: x / sqrt(list_inner_product({raw}, {raw})))"


def _mean_sql(vec: str = "vec") -> str:
    return "[" + ", ".join(f"avg({vec}[{i + 1}])" for i in range(DIM)) + "]"


def hv_ctes(src: str = "documents", id_col: str = "doc_id", name: str = "dt", distinct: bool = False) -> str:
    """CTE ``name(pid, pos, token, vec)``: HV vectors of the T1 tokens of ``src``."""
    # de-duplicated tokens: positions differ from Spark's array_distinct, which
    # only matters to position-free consumers (MaxSim document side)
    toks = f"list_distinct({TOKENS_CAPPED_SQL})" if distinct else TOKENS_CAPPED_SQL
    return f"""
{name}_t AS (SELECT {id_col} AS pid, unnest(toks) AS token, CAST(unnest(range(len(toks))) AS INTEGER) AS pos
             FROM (SELECT {id_col}, {toks} AS toks FROM {src})),
{name}_r AS (SELECT pid, pos, token, {hashed_token_vector_sql('token')} AS raw FROM {name}_t),
{name} AS (SELECT pid, pos, token, {_norm_sql('raw')} AS vec FROM {name}_r)"""


def _docs(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")


def doc_token_vectors(spark, sf, distinct=False):
    return encode.HashedTokenEncoder().encode_passages(_docs(spark, sf), distinct=distinct)


# --------------------------------------------------------------------------- E2 / E5 / E6 / E10 / E11

@register("token_vectors", with_ctes(hv_ctes()) + f"SELECT pid, pos, {rounded_sql()} AS vec FROM dt")
def token_vectors(spark, sf):
    """Token vector lookup through a vocabulary table join + L2 norm."""
    toks = encode.token_table(_docs(spark, sf))
    vocab = encode.vocabulary_vectors(toks)
    return encode.lookup_token_vectors(toks, vocab).select("pid", "pos", rounded().alias("vec"))


_MEAN_CTE = f"""
mraw AS (SELECT pid, {_mean_sql()} AS m FROM dt GROUP BY pid),
mvec AS (SELECT pid, {_norm_sql('m')} AS vec FROM mraw)"""


@register("mean_vector", with_ctes(hv_ctes(), _MEAN_CTE) + f"SELECT pid, {rounded_sql()} AS vec FROM mvec")
def mean_vector(spark, sf):
    """Mean pooling of token vectors + L2 norm: one vector per passage (E5)."""
    tv = doc_token_vectors(spark, sf)
    return encode.group_mean(tv, ["pid"], DIM).select("pid", rounded().alias("vec"))


_SENT_SQL = f"""
sents AS (SELECT doc_id, unnest(s) AS text, CAST(unnest(range(len(s))) AS INTEGER) AS sent_pos
          FROM (SELECT doc_id, {tx.split_sentences_sql('text')} AS s FROM documents)),
st_t AS (SELECT doc_id AS pid, sent_pos, unnest({TOKENS_CAPPED_SQL}) AS token FROM sents),
st_r AS (SELECT pid, sent_pos, {hashed_token_vector_sql('token')} AS raw FROM st_t),
st AS (SELECT pid, sent_pos, {_norm_sql('raw')} AS vec FROM st_r),
sraw AS (SELECT pid, sent_pos, {_mean_sql()} AS m FROM st GROUP BY pid, sent_pos),
svec AS (SELECT pid, sent_pos, {_norm_sql('m')} AS vec FROM sraw)"""


@register("sentence_vectors", with_ctes(_SENT_SQL) + f"SELECT pid, sent_pos, {rounded_sql()} AS vec FROM svec")
def sentence_vectors(spark, sf):
    """Sentence-level multi-vectors: mean of the token vectors of each sentence,
    L2 norm; sentences without tokens are masked out (E6, T3)."""
    d = load(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("pid"), F.posexplode(tx.split_sentences("text")).alias("sent_pos", "text"))
    toks = s.select("pid", "sent_pos", F.explode(tx.simple_tokens("text")).alias("token"))
    tv = encode.HashedTokenEncoder().encode_tokens(toks)
    return encode.group_mean(tv, ["pid", "sent_pos"], DIM).select("pid", "sent_pos", rounded().alias("vec"))


@register("first_token_vector", with_ctes(hv_ctes()) + f"SELECT pid, {rounded_sql()} AS vec FROM dt WHERE pos = 0")
def first_token_vector(spark, sf):
    """Vector at the first position of every passage."""
    tv = doc_token_vectors(spark, sf)
    return encode.position_vectors(tv, "first").select("pid", rounded().alias("vec"))


@register("token_labels", with_ctes(hv_ctes(), fx.DL_CTES)
          + "SELECT dt.pid, dt.pos, dl.label FROM dt JOIN dl ON dl.pid = dt.pid")
def token_labels(spark, sf):
    """Passage label spread to its token rows."""
    tv = doc_token_vectors(spark, sf)
    return encode.spread_labels(tv, fx.labelled_docs(spark, sf)).select("pid", "pos", "label")


@register("packed_vectors", with_ctes(fx.MV_CTES) + f"""
SELECT pid, list({rounded_sql()} ORDER BY pos) AS vecs FROM mv GROUP BY pid""")
def packed_vectors(spark, sf):
    """Per-passage packed vectors ordered by position."""
    mv = fx.multi_vectors(spark, sf).select("pid", "pos", F.col("vec").cast("array<double>").alias("vec"))
    p = encode.pack_vectors(mv)
    return p.select("pid", F.transform("vecs", rounded).alias("vecs"))


# --------------------------------------------------------------------------- J3 MaxSim

@register("maxsim_topk", with_ctes(fx.MV_CTES, fx.maxsim_sql(K)) + "SELECT qid, rank, pid, score FROM ms")
def maxsim_topk(spark, sf):
    mv = fx.multi_vectors(spark, sf)
    qv = mv.filter("is_query").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec")
    dv = mv.filter("NOT is_query").select("pid", "pos", "vec")
    return maxsim_join(qv, dv, K)


_BENCH_Q = hv_ctes("benchmark", "item_id", "bq")
_QV = "qv AS (SELECT pid AS qid, pos AS qpos, vec FROM bq)"


def _bench_query_vectors(spark, sf):
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return encode.HashedTokenEncoder().encode_queries(b, "qid").select("qid", "qpos", "vec")


@register("maxsim_hashed", with_ctes(_BENCH_Q, _QV, hv_ctes(distinct=True), fx.maxsim_sql(K, "qv", "dt"))
          + "SELECT qid, rank, pid, score FROM ms")
def maxsim_hashed(spark, sf):
    """Benchmark passages searched in whole documents by MaxSim over hashed token vectors.

    Document tokens are de-duplicated inside each row first (the max over a
    set does not change), query tokens keep their multiplicity.
    """
    docs = encode.token_lists(_docs(spark, sf), distinct=True)
    return maxsim_join(_bench_query_vectors(spark, sf), None, K, packed_docs=docs, encode=encode.hashed_vectors_batch)


# --------------------------------------------------------------------------- U6 sbert: E5 + J1 + C1, M18, P14

_DL_SPLIT = f"""
dls AS (SELECT pid, label, {pc._doc_test_split_sql()} AS split FROM dl),
q AS (SELECT m.pid AS qid, m.vec, dls.label FROM mvec m JOIN dls USING (pid) WHERE dls.split = 'test'),
c AS (SELECT m.pid, m.vec, dls.label FROM mvec m JOIN dls USING (pid) WHERE dls.split = 'train')"""

_SBERT_SQL = with_ctes(fx.DL_CTES, hv_ctes(), _MEAN_CTE, _DL_SPLIT, fx.knn_sql(K), _vote_sql(f"[{K}]"))


def _sbert(spark, sf):
    dl = fx.labelled_docs(spark, sf).withColumn("split", pc._doc_test_split())
    tv = encode.HashedTokenEncoder().encode_passages(dl.select("pid", "text"))
    mean = encode.group_mean(tv, ["pid"], DIM)
    v = mean.join(dl.select("pid", "label", "split"), "pid")
    q = v.filter(F.col("split") == "test").select(F.col("pid").alias("qid"), "vec", "label")
    c = v.filter(F.col("split") == "train").select("pid", "vec", "label")
    m = knn_join(q, c, K)
    preds = classify.knn_vote(m, c.select("pid", "label"), q.select("qid"), [K])
    return q, c, m, preds


@register("sbert_vote", _SBERT_SQL + "SELECT qid, pred FROM pred")
def sbert_vote(spark, sf):
    """Single-vector pipeline: mean-pooled passage vectors, exact kNN, vote (U6 'sbert')."""
    _, _, _, p = _sbert(spark, sf)
    return p.select("qid", "pred")


_SKIP_SQL = """
wrongq AS (SELECT q.qid FROM pred JOIN q USING (qid) WHERE pred.pred <> q.label),
skip AS (SELECT DISTINCT dt.token FROM dt JOIN wrongq ON dt.pid = wrongq.qid)"""


def _skiplist(spark, sf):
    q, _, _, p = _sbert(spark, sf)
    wrong = p.join(q.select("qid", "label"), "qid").filter(F.col("pred") != F.col("label")).select("qid")
    toks = encode.token_table(_docs(spark, sf))
    return toks.join(wrong, toks["pid"] == wrong["qid"], "left_semi").select("token").distinct()


@register("mine_skiplist", _SBERT_SQL.rstrip() + ",\n" + _SKIP_SQL.strip() + "\nSELECT token FROM skip")
def mine_skiplist(spark, sf):
    """Distinct tokens of misclassified passages -> skip list."""
    return _skiplist(spark, sf)


@register("skiplist_maxsim", _SBERT_SQL.rstrip() + ",\n" + _SKIP_SQL.strip() + ",\n" + with_ctes(
    _BENCH_Q, _QV, hv_ctes(distinct=True, name="dd"),
    "dk AS (SELECT * FROM dd WHERE token NOT IN (SELECT token FROM skip))",
    fx.maxsim_sql(K, "qv", "dk"))[5:] + "SELECT qid, rank, pid, score FROM ms")
def skiplist_maxsim(spark, sf):
    """MaxSim with skip-list tokens removed from the documents by an anti join (P14; D1 fixed)."""
    skip = _skiplist(spark, sf)
    # tokens are dropped before any vector is made; what is left is encoded packed
    kept = (encode.token_table(_docs(spark, sf)).join(small_side(skip), "token", "left_anti")
            .groupBy("pid").agg(F.collect_set("token").alias("tokens")))
    return maxsim_join(_bench_query_vectors(spark, sf), None, K, packed_docs=kept, encode=encode.hashed_vectors_batch)


# --------------------------------------------------------------------------- U1 / E3 / E4 model hook

@register("arrow_encoder_vectors", with_ctes("cvs AS (SELECT conv_id::VARCHAR || ':' || turn AS tid, text FROM conversations)",
                                             hv_ctes("cvs", "tid", "cv"))
          + f"SELECT pid, pos, {rounded_sql()} AS vec FROM cv")
def arrow_encoder_vectors(spark, sf):
    """A user encoder plugged into the Arrow batch hook (U1, E3/E4): texts of the
    conversation turns in, one vector per token out as ``(pid, pos, vec)``."""
    c = load(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pid"), "text")

    def model(texts):
        import re
        out = []
        for t in texts:
            toks = [w for w in re.findall(r"[^\W\d]+", (t or "").lower()) if 2 <= len(w) <= 15 and not w.startswith("_")]
            out.append(encode.hashed_vector_np(toks))
        return out

    v = encode.ArrowBatchEncoder(model, multi_vector=True).encode(c, "pid", "text")
    return v.select("pid", "pos", rounded().alias("vec"))


# --------------------------------------------------------------------------- E10 inner-token vectors

_INNER_SQL = f"""
sq AS (SELECT doc_id AS pid, ['{tx.CLS_TOKEN}'] || (['{tx.DOC_MARKER}'] || {TOKENS_CAPPED_SQL})
              || ['{tx.SEP_TOKEN}'] AS seq FROM documents),
sqt AS (SELECT pid, unnest(seq) AS token, CAST(unnest(range(len(seq))) AS INTEGER) AS pos, len(seq) AS n FROM sq),
inn AS (SELECT pid, pos, token FROM sqt WHERE pos >= 2 AND pos < n - 1),
inn_r AS (SELECT pid, {hashed_token_vector_sql('token')} AS raw FROM inn),
inn_v AS (SELECT pid, {_norm_sql('raw')} AS vec FROM inn_r),
inn_m AS (SELECT pid, {_mean_sql()} AS m FROM inn_v GROUP BY pid),
inn_n AS (SELECT pid, {_norm_sql('m')} AS vec FROM inn_m)"""


@register("inner_token_mean", with_ctes(_INNER_SQL) + f"SELECT pid, {rounded_sql()} AS vec FROM inn_n")
def inner_token_mean(spark, sf):
    """Whole-text encoder sequences ``[CLS] [D] tokens [SEP]`` as vector rows; the inner-token
    vectors (special positions stripped) mean-pooled and normalised per passage (E10, T5, E5)."""
    seq = encode.sequence_tokens(_docs(spark, sf), tx.DOC_MARKER)
    inner = encode.inner_vectors(seq.select("pid", "pos", "token"), start=2, end_trim=1)
    vecs = encode.HashedTokenEncoder().encode_tokens(inner)
    return encode.group_mean(vecs, ["pid"], DIM).select("pid", rounded().alias("vec"))


# --------------------------------------------------------------------------- U6: scolbert, explanations

_SCOLBERT_SQL = with_ctes(fx.DL_CTES, _SENT_SQL, f"""
dls AS (SELECT pid, label, {pc._doc_test_split_sql()} AS split FROM dl),
q AS (SELECT pid AS qid, label FROM dls WHERE split = 'test'),
c AS (SELECT pid, label FROM dls WHERE split = 'train'),
qv AS (SELECT s.pid AS qid, s.sent_pos AS qpos, s.vec FROM svec s JOIN q ON q.qid = s.pid),
dv AS (SELECT s.pid, s.sent_pos AS pos, s.vec FROM svec s JOIN c ON c.pid = s.pid)""", fx.maxsim_sql(K))


def _scolbert(spark, sf):
    dl = fx.labelled_docs(spark, sf).withColumn("split", pc._doc_test_split())
    test = dl.filter(F.col("split") == "test").select("pid", "text")
    pipeline = ClassificationPipeline("scolbert", search=SearchConfig(k=K))
    return pipeline.train_index(dl.filter(F.col("split") == "train").select("pid", "text", "label")), test


@register("scolbert_vote", _SCOLBERT_SQL.rstrip() + ",\n" + _vote_sql(f"[{K}]", matches="ms") + "\nSELECT qid, pred FROM pred")
def scolbert_vote(spark, sf):
    """Sentence-vector pipeline: sentences, mean vectors, MaxSim, vote (U6 'scolbert')."""
    pipeline, test = _scolbert(spark, sf)
    return pipeline.predict(test).select("qid", "pred")


@register("explain_prediction", _SCOLBERT_SQL.rstrip() + """,
al AS (SELECT ms.qid, ms.pid, qv.qpos, dv.pos, round(list_inner_product(qv.vec, dv.vec), 6) AS sim
       FROM ms JOIN qv USING (qid) JOIN dv ON dv.pid = ms.pid WHERE ms.rank = 1)
SELECT qid, pid, qpos, pos, sim + 0.0 AS sim FROM al QUALIFY rank() OVER (PARTITION BY qid, pid, qpos ORDER BY sim DESC) = 1""")
def explain_prediction(spark, sf):
    """The sentence(s) of the best match that answer each sentence of a predicted text."""
    pipeline, test = _scolbert(spark, sf)
    return pipeline.explain_prediction(test).withColumn("sim", F.col("sim") + F.lit(0.0))
