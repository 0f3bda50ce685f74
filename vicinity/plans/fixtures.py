"""Derived inputs shared by the query catalogue (FIXTURES section 4).

Each Spark builder has a SQL twin used by the DuckDB oracle strings, so both
engines start from the same rows.

* passage vectors: ``embeddings`` with ``pid = vec_id``; a seeded md5 split
  sends about 20 % of the rows to the query (test) side, the rest is the
  indexed (train) side - every row is used on exactly one side.
* MV multi-vector passages: ``pid = vec_id div 4``, ``pos = vec_id % 4``
  (four consecutive vectors form one passage); passage label = label at pos 0.
* ML multi-label vectors: labels ``{label, 10 + vec_id % 5}`` plus 15 when
  ``vec_id % 7 = 0``.
* DL labelled documents: ``documents`` join ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.hashing import uniform, uniform_sql
from vicinity.sources.tables import load

# fixed values of the fixture construction
SPLIT_SEED = 7
QUERY_FRACTION = 0.2
MV_WIDTH = 4


def query_flag(id_col: str = "vec_id"):
    return uniform(SPLIT_SEED, id_col) < QUERY_FRACTION


def query_flag_sql(id_expr: str = "vec_id") -> str:
    return f"({uniform_sql(SPLIT_SEED, id_expr)} < {QUERY_FRACTION})"


# --------------------------------------------------------------------------- passage vectors

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pid"), F.col("embedding").alias("vec"), "label", query_flag().alias("is_query"))


def split_vectors(spark: SparkSession, sf: str):
    v = vectors(spark, sf)
    queries = v.filter("is_query").select(F.col("pid").alias("qid"), "vec", "label")
    corpus = v.filter("NOT is_query").select("pid", "vec", "label")
    return queries, corpus


VEC_CTES = f"""
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS vec, label FROM embeddings WHERE {query_flag_sql()}),
c AS (SELECT vec_id AS pid, embedding::DOUBLE[] AS vec, label FROM embeddings WHERE NOT {query_flag_sql()})"""


def knn_sql(k: int = 10, metric: str = "inner_product", src_q: str = "q", src_c: str = "c",
            exclude_self: bool = False, name: str = "m") -> str:
    """CTE ``name(qid, rank, pid, score)``: exact top-k by the engine tie rule."""
    if metric == "inner_product":
        score, order = "round(list_inner_product(a.vec, b.vec), 6)", "score DESC"
    else:
        score = ("round(list_inner_product(a.vec, a.vec) + list_inner_product(b.vec, b.vec)"
                 " - 2 * list_inner_product(a.vec, b.vec), 6)")
        order = "score ASC"
    where = "WHERE a.qid <> b.pid" if exclude_self else ""
    return f"""{name} AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}, pid) AS INTEGER) AS rank, pid, score
  FROM (SELECT a.qid, b.pid, {score} AS score FROM {src_q} a, {src_c} b {where})
  QUALIFY rank <= {k})"""


# --------------------------------------------------------------------------- MV: multi-vector passages

def multi_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Long table ``(pid, pos, vec, label, is_query)``."""
    e = load(spark, sf, "embeddings")
    pid = F.floor(F.col("vec_id") / MV_WIDTH).cast("long")
    return e.select(pid.alias("pid"), (F.col("vec_id") % MV_WIDTH).cast("int").alias("pos"),
                    F.col("embedding").alias("vec"), "label").withColumn("is_query", query_flag("pid"))


def multi_vector_labels(mv: DataFrame) -> DataFrame:
    return mv.filter(F.col("pos") == 0).select("pid", "label")


MV_CTES = f"""
mv AS (SELECT vec_id // {MV_WIDTH} AS pid, CAST(vec_id % {MV_WIDTH} AS INTEGER) AS pos,
              embedding::DOUBLE[] AS vec, label FROM embeddings),
mvl AS (SELECT pid, label FROM mv WHERE pos = 0),
qv AS (SELECT pid AS qid, pos AS qpos, vec FROM mv WHERE {query_flag_sql('pid')}),
dv AS (SELECT pid, pos, vec FROM mv WHERE NOT {query_flag_sql('pid')})"""


def maxsim_sql(k: int = 10, qv: str = "qv", dv: str = "dv", name: str = "ms", extra_where: str = "") -> str:
    return f"""{name}_pair AS (
  SELECT qid, pid, sum(mx) AS score FROM (
    SELECT a.qid, b.pid, a.qpos, max(list_inner_product(a.vec, b.vec)) AS mx
    FROM {qv} a, {dv} b {extra_where} GROUP BY a.qid, b.pid, a.qpos) GROUP BY qid, pid),
{name} AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pid) AS INTEGER) AS rank,
         pid, round(score, 6) AS score
  FROM {name}_pair QUALIFY rank <= {k})"""


# --------------------------------------------------------------------------- ML: multi-label vectors

def multilabel_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(pid, vec, labels ARRAY<INT>, is_query)`` with sorted distinct labels."""
    e = load(spark, sf, "embeddings")
    labels = F.array_sort(F.array_distinct(F.concat(
        F.array(F.col("label"), (F.lit(10) + F.col("vec_id") % 5).cast("int")),
        F.when(F.col("vec_id") % 7 == 0, F.array(F.lit(15))).otherwise(F.array().cast("array<int>")))))
    return e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec"),
                    labels.alias("labels"), query_flag().alias("is_query"))


ML_CTES = f"""
ml AS (SELECT vec_id AS pid, embedding::DOUBLE[] AS vec,
              list_sort(list_distinct([label, CAST(10 + vec_id % 5 AS INTEGER)]
                        || CASE WHEN vec_id % 7 = 0 THEN [15] ELSE [] END)) AS labels,
              {query_flag_sql()} AS is_query FROM embeddings),
mll AS (SELECT pid, unnest(labels) AS label FROM ml)"""


# --------------------------------------------------------------------------- DL: labelled documents

def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    lab = load(spark, sf, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("pid"), "text", "lang", "source",
                                         "quality", "toxic", F.col("quality").alias("label"))


def doc_label_strings(spark: SparkSession, sf: str) -> DataFrame:
    """DL-ml: ``(pid, text, topics ARRAY<STRING>)`` - raw multi-label strings, all documents.

    ``lang:x``, ``source:y``, plus ``quality:1`` / ``toxic:1`` where labelled so.
    """
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    lab = load(spark, sf, "labels")
    topics = F.concat(
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")),
        F.when(F.col("quality") == 1, F.array(F.lit("quality:1"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic:1"))).otherwise(F.array().cast("array<string>")))
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("pid"), "text", topics.alias("topics"))


DL_CTES = """
dl AS (SELECT d.doc_id AS pid, d.text, d.lang, d.source, l.quality, l.toxic, l.quality AS label
       FROM documents d JOIN labels l USING (doc_id))"""

DLML_CTES = """
dlml AS (SELECT d.doc_id AS pid, d.text,
               ['lang:' || d.lang, 'source:' || d.source]
               || CASE WHEN l.quality = 1 THEN ['quality:1'] ELSE [] END
               || CASE WHEN l.toxic = 1 THEN ['toxic:1'] ELSE [] END AS topics
         FROM documents d LEFT JOIN labels l USING (doc_id))"""
