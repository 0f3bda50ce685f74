"""Token counts: an exact histogram of encoded lengths answers every context limit.

Whole texts are encoded and only their lengths leave a task, already counted by
length.  Totals, quantiles and truncated totals for any limit then follow from
prefix sums over the histogram: with ``n`` documents of which ``g`` are at least
L long and hold ``t`` tokens, cutting all documents to L tokens leaves
``total - t + g * L`` tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.session import cut_lineage

BLOCK = 1024  # lengths per block of the two-level sums
# fixed value: the pattern that splits text before the merges of the rank files
# (its \s is Unicode's White_Space; a run of it before a text's end or other characters is one piece but for its last one)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_RUN = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}+")


def length_of(text: str, encoding: tiktoken.Encoding, whole: tiktoken.Encoding, runs: regex.Pattern | None) -> int:
    """Number of tokens of a text.

    The library's pattern engine tracks back over a run of white space and overflows its stack on a long one, so
    matches of ``runs`` are cut out first, as ``PATTERN`` would cut them, and merged by ``whole``, which has no pattern
    to split by.
    """
    n = done = 0
    for found in runs.finditer(text) if runs else ():
        end = found.end() if found.end() == len(text) else found.end() - 1
        n += len(encoding.encode_ordinary(text[done:found.start()])) + len(whole.encode_ordinary(text[found.start():end]))
        done = end
    return n + len(encoding.encode_ordinary(text[done:]))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file (one "base64 rank" a line; its size does not depend on the data)."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def encoded_lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: the exact histogram of encoded lengths; a task sends a row per length it has seen."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]):
        encoding, whole = (tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=shared.value, special_tokens={})
                           for p in (pattern, r"(?s).+"))
        runs = LONG_RUN if pattern == PATTERN else None  # another pattern has other pieces
        total: dict[int, int] = {}
        for batch in batches:
            for part in bt.slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    n = length_of(t, encoding, whole, runs) if t else 0
                    total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["n_tokens", "n_docs"])

    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
            .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def limit_table(histogram: DataFrame) -> DataFrame:
    """A row per occurring length L: what holds for the context limit L.

    ``n_tokens`` (L), ``n_docs`` of this length, ``docs_upto`` and ``tokens_upto`` (lengths <= L), ``docs_from`` and
    ``tokens_from`` (lengths >= L), ``quantile`` (share of documents with length <= L), ``truncated_total`` (tokens
    left when all documents are cut to L).  Sums are taken within blocks of 1,024 lengths and added to the sums of the
    blocks before; there is one row per block, so no task sorts the histogram.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "_block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    every = Window.orderBy("_block")
    before = blocks.select(
        "_block", (F.sum("_d").over(every) - F.col("_d")).alias("_d0"), (F.sum("_t").over(every) - F.col("_t")).alias("_t0"),
        F.sum("_d").over(Window.partitionBy(F.lit(0))).alias("_all_d"),
        F.sum("_t").over(Window.partitionBy(F.lit(0))).alias("_all_t"))
    inner = Window.partitionBy("_block").orderBy("n_tokens")
    out = h.join(before, "_block").select(
        "n_tokens", "n_docs", "tokens", "_all_d", "_all_t",
        (F.sum("n_docs").over(inner) + F.col("_d0")).alias("docs_upto"),
        (F.sum("tokens").over(inner) + F.col("_t0")).alias("tokens_upto"))
    docs_from = F.col("_all_d") - F.col("docs_upto") + F.col("n_docs")
    tokens_from = F.col("_all_t") - F.col("tokens_upto") + F.col("tokens")
    return out.select(
        "n_tokens", "n_docs", "docs_upto", "tokens_upto", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("docs_upto") / F.col("_all_d")).alias("quantile"),
        (F.col("_all_t") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_total"))


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """:func:`limit_table` of all texts.  Null and empty texts have length 0; an empty table gives no rows;
    repeated rows count each time; other columns are not read.  The histogram is stored, so a text is encoded once."""
    return limit_table(cut_lineage(encoded_lengths(docs, ranks, pattern, text_col)))


def at_limits(table: DataFrame, limits: list[int]) -> dict[int, int]:
    """Truncated total for any limits, from one pass over the :func:`limit_table`: a longest length <= L answers L."""
    sums = [F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * x))
            .alias(f"c{i}") for i, x in enumerate(limits)]
    row = table.agg(*sums).first()
    return {x: int(row[i] or 0) for i, x in enumerate(limits)}


def quantiles(table: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that at least the given share of the documents doesn't exceed."""
    row = table.agg(*(F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))) for q in shares)).first()
    return dict(zip(shares, row))
