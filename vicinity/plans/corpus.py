"""Phase 2: corpus preparation on ``documents`` / ``labels`` / ``conversations``.

S10, P1-P13, M1-M3.  Seeds and sizes are the reference's defaults where it
has them (validation fraction 0.1, pruning thresholds are parameters).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions.hashing import uniform, uniform_sql
from vicinity.operators import corpus as cp
from vicinity.plans import fixtures as fx
from vicinity.plans import register, with_ctes
from vicinity.sources.tables import load

# fixed query parameters
SPLIT_SEED = 12345
VAL_FRACTION = 0.1
TEST_SEED = 7
TEST_FRACTION = 0.2
PRUNE_MIN = 40
SUBSAMPLE_N = 100
SUBSAMPLE_FRACTION = 0.25
CAP = 120


def _u_sql(seed, col="pid"):
    return uniform_sql(seed, col)


# --------------------------------------------------------------------------- P10 / M2

def _docs(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text", "lang", "source")


def _random_split(spark, sf):
    return cp.random_split(_docs(spark, sf).select("pid"), VAL_FRACTION, SPLIT_SEED)


_RSPLIT_SQL = f"""
rs AS (SELECT pid, CASE WHEN rn <= (SELECT ceil(CAST({VAL_FRACTION} AS DOUBLE) * count(*)) FROM documents)
                        THEN 'validation' ELSE 'train' END AS split
       FROM (SELECT doc_id AS pid, row_number() OVER (ORDER BY {_u_sql(SPLIT_SEED, 'doc_id')}, doc_id) AS rn
             FROM documents))"""


@register("split_random", with_ctes(_RSPLIT_SQL) + "SELECT pid, split FROM rs")
def split_random(spark, sf):
    return _random_split(spark, sf)


@register("split_sizes", with_ctes(_RSPLIT_SQL) + "SELECT split, count(*) AS n FROM rs GROUP BY split")
def split_sizes(spark, sf):
    return cp.split_sizes(_random_split(spark, sf))


# --------------------------------------------------------------------------- P11 / P12 / P13

def _quota_sql(src: str, size_expr: str, label: str = "label") -> str:
    return f"""
cnt AS (SELECT {label} AS label, count(*) AS n_l FROM {src} GROUP BY {label}),
tgt AS (SELECT label, n_l, ({size_expr}) AS t, sum(n_l) OVER () AS n FROM cnt),
ex AS (SELECT label, t * n_l / n AS e, floor(t * n_l / n) AS fl, t FROM tgt),
quota AS (SELECT label, CAST(fl + CASE WHEN row_number() OVER (ORDER BY e - fl DESC, label)
                                     <= t - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM ex)"""


_STRAT_SQL = with_ctes(
    fx.DL_CTES,
    _quota_sql("dl", f"ceil(CAST({VAL_FRACTION} AS DOUBLE) * sum(n_l) OVER ())"),
    f"""ss AS (SELECT dl.pid, CASE WHEN row_number() OVER (PARTITION BY dl.label ORDER BY {_u_sql(SPLIT_SEED)}, dl.pid)
                        <= quota.quota THEN 'validation' ELSE 'train' END AS split
       FROM dl JOIN quota ON dl.label = quota.label)""")


@register("split_stratified", _STRAT_SQL + "SELECT pid, split FROM ss")
def split_stratified(spark, sf):
    dl = fx.labelled_docs(spark, sf).select("pid", "label")
    return cp.stratified_split(dl, VAL_FRACTION, SPLIT_SEED).select("pid", "split")


_SUB_N_SQL = with_ctes(
    fx.DL_CTES, _quota_sql("dl", str(SUBSAMPLE_N)),
    f"""sn AS (SELECT dl.pid, dl.label FROM dl JOIN quota ON dl.label = quota.label
       QUALIFY row_number() OVER (PARTITION BY dl.label ORDER BY {_u_sql(SPLIT_SEED)}, dl.pid) <= quota.quota)""")


@register("subsample_n", _SUB_N_SQL + "SELECT pid, label FROM sn")
def subsample_n(spark, sf):
    """Stratified subsample of ``SUBSAMPLE_N`` labelled documents (P12 int, stratify=True default)."""
    dl = fx.labelled_docs(spark, sf).select("pid", "label")
    return cp.subsample(dl, SUBSAMPLE_N, SPLIT_SEED, stratify=True)


@register("subsample_fraction", f"""
SELECT doc_id AS pid FROM documents
QUALIFY row_number() OVER (ORDER BY {_u_sql(SPLIT_SEED, 'doc_id')}, doc_id)
        <= ceil(CAST({SUBSAMPLE_FRACTION} AS DOUBLE) * count(*) OVER ())""")
def subsample_fraction(spark, sf):
    return cp.subsample(_docs(spark, sf).select("pid"), SUBSAMPLE_FRACTION, SPLIT_SEED)


@register("cap_per_class", f"""
SELECT doc_id AS pid, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_u_sql(SPLIT_SEED, 'doc_id')}, doc_id) <= {CAP}""")
def cap_per_class(spark, sf):
    d = _docs(spark, sf).select("pid", "lang")
    return cp.cap_per_class(d, CAP, SPLIT_SEED, label="lang")


# --------------------------------------------------------------------------- M1 / M3

def _doc_test_split(col="pid"):
    return F.when(uniform(TEST_SEED, col) < TEST_FRACTION, F.lit("test")).otherwise(F.lit("train"))


def _doc_test_split_sql(col="pid"):
    return f"CASE WHEN {_u_sql(TEST_SEED, col)} < {TEST_FRACTION} THEN 'test' ELSE 'train' END"


@register("label_counts", with_ctes(fx.DL_CTES)
          + f"SELECT {_doc_test_split_sql()} AS split, label, count(*) AS n FROM dl GROUP BY ALL")
def label_counts(spark, sf):
    dl = fx.labelled_docs(spark, sf).withColumn("split", _doc_test_split())
    return cp.label_frequency(dl, "label", by=["split"])


@register("label_counts_multi", with_ctes(fx.DLML_CTES)
          + "SELECT label, count(*) AS n FROM (SELECT unnest(topics) AS label FROM dlml) GROUP BY label")
def label_counts_multi(spark, sf):
    return cp.label_frequency(fx.doc_label_strings(spark, sf), "topics", multilabel=True)


@register("label_curve", with_ctes(fx.DLML_CTES) + """
SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, n
FROM (SELECT label, count(*) AS n FROM (SELECT unnest(topics) AS label FROM dlml) GROUP BY label)""")
def label_curve(spark, sf):
    counts = cp.label_frequency(fx.doc_label_strings(spark, sf), "topics", multilabel=True)
    return cp.frequency_curve(counts)


# --------------------------------------------------------------------------- P4-P9

def _ml_split(spark, sf):
    return fx.doc_label_strings(spark, sf).withColumn("split", _doc_test_split())


_PRUNE_SQL = with_ctes(fx.DLML_CTES, f"""
s AS (SELECT pid, topics, {_doc_test_split_sql()} AS split FROM dlml),
lg AS (SELECT pid, split, unnest(topics) AS label, unnest(range(len(topics))) AS pos FROM s),
keep AS (SELECT label FROM lg WHERE split = 'train' GROUP BY label HAVING count(*) >= {PRUNE_MIN}),
dict AS (SELECT label AS name, CAST(row_number() OVER (ORDER BY min(pid * 1000 + pos)) - 1 AS INTEGER) AS label_id
         FROM lg WHERE split = 'train' AND label IN (SELECT label FROM keep) GROUP BY label),
pr AS (SELECT pid, split, list_sort(list_distinct(list(label_id))) AS labels
       FROM lg JOIN dict ON lg.label = dict.name GROUP BY pid, split),
one AS (SELECT pid, split, labels[1] AS label FROM pr WHERE len(labels) = 1),
keep1 AS (SELECT label FROM one WHERE split = 'train' GROUP BY label HAVING count(*) >= 2),
dict1 AS (SELECT label AS name, CAST(row_number() OVER (ORDER BY min(pid)) - 1 AS INTEGER) AS label_id
          FROM one WHERE split = 'train' AND label IN (SELECT label FROM keep1) GROUP BY label),
sl AS (SELECT pid, split, label_id AS label FROM one JOIN dict1 ON one.label = dict1.name)""")


def _prune(spark, sf):
    return cp.prune_and_reindex(_ml_split(spark, sf), PRUNE_MIN)


@register("prune_and_reindex_labels", _PRUNE_SQL + "SELECT pid, split, labels FROM pr")
def prune_and_reindex_labels(spark, sf):
    rows, _ = _prune(spark, sf)
    return rows


@register("label_dictionary", _PRUNE_SQL + "SELECT name, label_id FROM dict")
def label_dictionary(spark, sf):
    _, d = _prune(spark, sf)
    return d


@register("single_label_reduction", _PRUNE_SQL + "SELECT pid, split, label FROM sl")
def single_label_reduction(spark, sf):
    rows, _ = _prune(spark, sf)
    single, _ = cp.single_label_reduction(rows, 2)
    return single


@register("label_decode", _PRUNE_SQL + """
SELECT sl.pid, sl.split, sl.label, coalesce(dict.name, '?') AS name
FROM sl JOIN dict1 ON dict1.label_id = sl.label LEFT JOIN dict ON dict.label_id = dict1.name""")
def label_decode(spark, sf):
    rows, d = _prune(spark, sf)
    single, d1 = cp.single_label_reduction(rows, 2)
    # new id -> old id -> name: compose the two dictionaries (both one row per label)
    names = (d1.select(F.col("label_id"), F.col("name").alias("old_id"))
             .join(d.select(F.col("label_id").alias("old_id"), "name"), "old_id", "left")
             .select("label_id", "name"))
    return cp.decode_labels(single, names).select("pid", "split", "label", "name")


@register("superlabel_counts", """
SELECT split_part(fine, ':', 1) AS coarse, count(DISTINCT fine) AS n_fine, count(*) AS n_docs
FROM (SELECT lang || ':' || source AS fine FROM documents) GROUP BY 1""")
def superlabel_counts(spark, sf):
    fine = _docs(spark, sf).select(F.concat_ws(":", "lang", "source").alias("fine"))
    return (fine.groupBy(cp.coarse_label("fine").alias("coarse"))
            .agg(F.countDistinct("fine").alias("n_fine"), F.count(F.lit(1)).alias("n_docs")))


# --------------------------------------------------------------------------- P1 / P2 / P3

@register("concat_fields", "SELECT conv_id, turn, role || ' \n' || text AS text FROM conversations")
def concat_fields(spark, sf):
    c = load(spark, sf, "conversations")
    c = cp.column_contract(c, {"conv_id": "conv_id", "turn": "turn", "role": "title", "text": "body"})
    return c.select("conv_id", "turn", cp.concat_fields("title", "body").alias("text"))


@register("non_empty", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def non_empty(spark, sf):
    return cp.non_empty(load(spark, sf, "conversations")).select("conv_id", "turn")


@register("subsample_passages", with_ctes(fx.MV_CTES) + f"""
SELECT mv.pid, mv.pos FROM mv
WHERE mv.pid IN (SELECT pid FROM (SELECT DISTINCT pid FROM mv)
                 QUALIFY row_number() OVER (ORDER BY {_u_sql(SPLIT_SEED)}, pid)
                         <= ceil(CAST({SUBSAMPLE_FRACTION} AS DOUBLE) * count(*) OVER ()))""")
def subsample_passages(spark, sf):
    """Multi-vector subsample: passage ids are sampled, all their vectors kept (semi join)."""
    mv = fx.multi_vectors(spark, sf).select("pid", "pos")
    return cp.subsample_passages(mv, SUBSAMPLE_FRACTION, SPLIT_SEED)


def _lengths(texts, places, limit):
    return {"position": places, "n_text": [len(t) for t in texts], "short": [len(t) < limit for t in texts]}


@register("row_map", """
SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS position, length(text) AS n_text, length(text) < 500 AS short
FROM documents""")
def row_map(spark, sf):
    """A user's function over batches of rows with an option and the row's index, columns added and removed."""
    return cp.map_rows(load(spark, sf, "documents").select("doc_id", "lang", "source", "text"), _lengths,
                       "position long, n_text long, short boolean", ["text"], ["text"], batched=True, index_by="doc_id", limit=500)
