"""Phase 3a: text to tokens and sentences on whole ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vicinity.functions import text as tx
from vicinity.plans import register
from vicinity.sources.tables import load

MIN_COUNT = 5

# DuckDB twin of the tokenizer (RE2 has the same Unicode classes)
TOKENS_SQL = (f"list_filter(regexp_extract_all(lower(text), '{tx.TOKEN_PATTERN}'), "
              f"lambda t: length(t) BETWEEN {tx.TOKEN_MIN_LEN} AND {tx.TOKEN_MAX_LEN} AND NOT starts_with(t, '_'))")
# whole texts: no token cap (the sequence encoder below applies its own max length)
TOKENS_CAPPED_SQL = TOKENS_SQL


def doc_tokens(spark, sf, cap=False):
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("pid"),
                    tx.simple_tokens("text", max_tokens=tx.MAX_TOKENS if cap else None).alias("tokens"))


@register("tokens_simple", f"SELECT doc_id AS pid, {TOKENS_CAPPED_SQL} AS tokens FROM documents")
def tokens_simple(spark, sf):
    return doc_tokens(spark, sf)


_VOCAB_SQL = f"""
WITH t AS (SELECT unnest({TOKENS_CAPPED_SQL}) AS token FROM documents)
SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= {MIN_COUNT}"""


@register("token_vocab", _VOCAB_SQL)
def token_vocab(spark, sf):
    """Vocabulary with ``min_count``."""
    t = doc_tokens(spark, sf).select(F.explode("tokens").alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


@register("vocab_totals", f"""
SELECT CAST(sum(len({TOKENS_CAPPED_SQL})) AS BIGINT) AS total_words, count(*) AS total_docs FROM documents""")
def vocab_totals(spark, sf):
    t = doc_tokens(spark, sf)
    return t.agg(F.sum(F.size("tokens")).cast("long").alias("total_words"), F.count(F.lit(1)).alias("total_docs"))


@register("seq_length_stats", f"""
WITH l AS (SELECT len({TOKENS_SQL}) AS length FROM documents)
SELECT count(*) AS n_docs, CAST(sum(length) AS BIGINT) AS total, min(length) AS min_len, max(length) AS max_len,
       round(avg(CASE WHEN length > {tx.MAX_TOKENS} THEN 1.0 ELSE 0.0 END), 9) AS share_over_max
FROM l""")
def seq_length_stats(spark, sf):
    """Length per row (uncut), and the share of rows above the maximum length."""
    l = doc_tokens(spark, sf, cap=False).select(F.size("tokens").alias("length"))
    return l.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").cast("long").alias("total"),
                 F.min("length").alias("min_len"), F.max("length").alias("max_len"),
                 F.round(F.avg(F.when(F.col("length") > tx.MAX_TOKENS, 1.0).otherwise(0.0)), 9)
                 .alias("share_over_max"))


@register("seq_length_curve", f"""
WITH h AS (SELECT len({TOKENS_SQL}) AS length, count(*) AS n_docs FROM documents GROUP BY 1)
SELECT length, n_docs, CAST(sum(n_docs) OVER (ORDER BY length DESC) AS BIGINT) AS n_at_least FROM h""")
def seq_length_curve(spark, sf):
    """Descending length curve through a length histogram (T7, W3): the window runs
    over distinct lengths only (at most max length rows)."""
    h = (doc_tokens(spark, sf, cap=False).groupBy(F.size("tokens").alias("length"))
         .agg(F.count(F.lit(1)).alias("n_docs")))
    w = Window.orderBy(F.col("length").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return h.select("length", "n_docs", F.sum("n_docs").over(w).cast("long").alias("n_at_least"))


_SEQ_SQL = (f"['{tx.CLS_TOKEN}'] || (['{tx.DOC_MARKER}'] || {TOKENS_CAPPED_SQL})[1:{tx.MAX_LENGTH - 2}]"
            f" || ['{tx.SEP_TOKEN}']")


@register("marker_truncate", f"SELECT doc_id AS pid, {_SEQ_SQL} AS seq FROM documents")
def marker_truncate(spark, sf):
    """Role marker + cut to the encoder's maximum length (T4): truncation is this operator's job."""
    t = doc_tokens(spark, sf)
    return t.select("pid", tx.encode_sequence("tokens", tx.DOC_MARKER).alias("seq"))


_SEQ_WHOLE_SQL = f"['{tx.CLS_TOKEN}'] || ['{tx.DOC_MARKER}'] || {TOKENS_CAPPED_SQL} || ['{tx.SEP_TOKEN}']"


@register("inner_tokens", f"""
WITH s AS (SELECT doc_id AS pid, {_SEQ_WHOLE_SQL} AS seq FROM documents)
SELECT pid, seq[3:len(seq) - 1] AS inner_seq, len(seq) - 3 AS n_inner FROM s""")
def inner_tokens(spark, sf):
    """Special positions ([CLS], marker, [SEP]) stripped from whole-text sequences (T5)."""
    s = doc_tokens(spark, sf).select("pid", tx.encode_sequence("tokens", tx.DOC_MARKER, max_length=None).alias("seq"))
    inner = tx.inner_tokens("seq", has_marker=True)
    return s.select("pid", inner.alias("inner_seq"), F.size(inner).cast("bigint").alias("n_inner"))


@register("sentences", f"""
WITH s AS (SELECT doc_id AS pid, {tx.split_sentences_sql('text')} AS sents FROM documents)
SELECT pid, CAST(pos - 1 AS INTEGER) AS sent_pos, sents[pos] AS sentence
FROM s, range(1, len(s.sents) + 1) r(pos)""")
def sentences(spark, sf):
    """Sentence table ``(pid, sent_pos, sentence)`` of whole documents."""
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("pid"),
                    F.posexplode(tx.split_sentences("text")).alias("sent_pos", "sentence"))
