"""Quality classifier by importance resampling.

Two bag-of-hashed-n-grams generative models are counted in Spark: one of the
target (labelled good texts) and one of the raw text (every document).  A
document's log weight is the log likelihood ratio of the two; as a sum it would
rank by length first, so the sampling weight is its mean per word.  A sample
without replacement proportional to the weights (tempered) is drawn by Gumbel
top-k: add Gumbel noise to each log ratio and keep the k largest keys.  k is the
number of documents whose log ratio passes a threshold set on the labelled rows,
so the verdict follows the ratio and the noise moves only documents near it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm import bytetext as bt
from vicinity.llm import ngrams
from vicinity.session import cut_lineage

TEMPERATURE = 0.1      # of the sampling weights: scale of the Gumbel noise, in log ratio per word
MAX_LABELLED = 20_000  # bound on the labelled rows that the target model and the threshold are fitted on


def one_label(labels: DataFrame, value: Column, id_col: str = "doc_id") -> DataFrame:
    """``_label_id, _label``: the smallest non-null value per non-null id."""
    return (labels.select(F.col(id_col).alias("_label_id"), value.alias("_label"))
            .filter("_label_id is not null and _label is not null").groupBy("_label_id").agg(F.min("_label").alias("_label")))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, _label``: one row for each id of a (bounded) labelled sample that ``docs`` has.

    However many rows share an id, it weighs once: the smallest of its texts stands for it, found in the tasks first.
    """
    return (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id"))
            .groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("doc_id", "text", "_label"))


def log_weights(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_weight, log_ratio`` (per word) of every whole text; map only.

    A text without words has weight 1 (log 0).
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text", ngrams.SLICE):
                sums, words = ngrams.score_texts(part.column("text"), shared.value[None])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(sums[:, 0]),
                     pa.array(sums[:, 0] / np.maximum(words, 1))], ["doc_id", "n_words", "log_weight", "log_ratio"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, log_weight double, log_ratio double")


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the best mean of (share of good above, share of bad below); of equal ones, the middle of the widest gap."""
    if not len(good) or not len(bad):
        return -np.inf
    x = np.concatenate((good, bad))
    order = np.argsort(x, kind="stable")
    x, is_good = x[order], (np.arange(len(x)) < len(good))[order]
    quality = np.concatenate(([0], np.cumsum(~is_good))) / len(bad) + 1 - np.concatenate(([0], np.cumsum(is_good))) / len(good)
    gap = np.concatenate(([0.0], np.diff(x), [0.0]))
    gap[1:-1][np.diff(x) == 0] = -1  # no cut between equal values
    quality[gap < 0] = -1
    at = max(range(len(x) + 1), key=lambda i: (round(quality[i], 12), gap[i]))
    return float(x[0] - 1 if at == 0 else x[-1] + 1 if at == len(x) else (x[at - 1] + x[at]) / 2)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id: the same whatever the partitioning and after a retry."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keyed: DataFrame, k: int, small: int = 10_000, bins: int = 4096) -> tuple[float, int | None]:
    """``(key, id)`` of the k-th row by key (descending), then id (nulls last); ``keyed`` has ``key`` and ``doc_id`` and is stored.

    Histograms narrow the range that holds the row until it has at most ``small`` rows or one key; at most ``bins``
    counts a round and those few rows reach the driver.  Equal keys are narrowed by id, in whole numbers.  The counts
    are of all rows, so the cut is exact.
    """
    inside, rank = keyed.select("key", "doc_id"), k
    while True:
        n, lo, hi = inside.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        if n <= small:
            rows = sorted(((r["key"], r["doc_id"]) for r in inside.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            return rows[rank - 1]
        if lo == hi:
            return lo, kth_id(inside, rank, small, bins)
        width = (hi - lo) / bins
        # a range too narrow to be divided has a few thousand neighbouring doubles at most: each is a bin
        narrow = width <= 0 or lo + width == lo
        bin_of = F.col("key") if narrow else F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        at, rank = _bin_with(inside, bin_of, rank, descending=True)
        inside = inside.filter(bin_of == F.lit(at))


def kth_id(rows: DataFrame, k: int, small: int = 10_000, bins: int = 4096) -> int | None:
    """The k-th ``doc_id`` in ascending order, nulls last."""
    inside, rank = rows.select("doc_id").filter("doc_id is not null"), k
    while True:
        n, lo, hi = inside.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
        if rank > n:
            return None
        if n <= small:
            return sorted(r[0] for r in inside.collect())[rank - 1]
        if lo == hi:
            return lo
        offset = F.col("doc_id").cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")
        bin_of = F.floor(offset / F.lit((hi - lo) // bins + 1).cast("decimal(38,0)")).cast("long")
        at, rank = _bin_with(inside, bin_of, rank, descending=False)
        inside = inside.filter(bin_of == F.lit(at))


def _bin_with(rows: DataFrame, bin_of: Column, rank: int, descending: bool):
    """``(bin, rank in it)`` of the ``rank``-th row in the order of the bins."""
    counts = {r[0]: r[1] for r in rows.groupBy(bin_of.alias("b")).count().collect()}  # a row per bin
    for b in sorted(counts, reverse=descending):
        if rank <= counts[b]:
            return b, rank
        rank -= counts[b]
    raise ValueError("rank beyond the rows")


def gumbel_top_k(scored: DataFrame, k: int, seed: int = 42, temperature: float = TEMPERATURE) -> DataFrame:
    """``scored`` (``doc_id``, ``log_ratio``; read several times, so stored) with ``key`` and ``kept``: exactly k rows.

    Rows that repeat an id (or have none) and a ratio at the cut share its fate, since nothing tells them apart.
    """
    keyed = scored.withColumn("key", noisy_key(seed, temperature))
    return keyed.withColumn("kept", _verdict(keyed, k))


def noisy_key(seed: int, temperature: float) -> Column:
    return F.col("log_ratio") + F.lit(float(temperature)) * gumbel("doc_id", seed)


def _verdict(keyed: DataFrame, k: int) -> Column:
    """Whether a row with ``key`` and ``doc_id`` is among the k largest of ``keyed``."""
    if k <= 0 or k >= keyed.count():
        return F.lit(k > 0)
    key, last = kth_largest(keyed, k)
    tie = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= F.lit(last), F.lit(False))
    return (F.col("key") > key) | ((F.col("key") == key) & tie)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42, temperature: float = TEMPERATURE,
             max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text",
             quality_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, n_words, log_weight, log_ratio, key, kept``.

    The target model counts the texts labelled 1 in a hash sample of at most ``max_labelled`` labelled ids; the raw
    model counts all texts.  Without labels of both kinds there is no threshold and every document stays.

    * null, empty or blank text: log ratio 0, judged like any other; null id: scored, never labelled;
    * repeated rows: each is scored; an id that several rows share is labelled once, by the smallest of its texts;
      labels repeated for an id: the smallest counts, nulls don't;
    * ties at the cut: by id, null ids last; rows that share key and id share their fate;
    * empty tables: no rows, or no labels as above (then ``n_words`` is null); further columns are not read.
    """
    fitted = _fitted(docs, labels, seed, temperature, max_labelled, id_col, text_col, quality_col)
    if fitted is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"),
                           F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("log_ratio"),
                           gumbel(id_col, seed).alias("key"), F.lit(True).alias("kept"))
    _, keyed, verdict = fitted
    return keyed.withColumn("kept", verdict)


def _fitted(docs, labels, seed, temperature, max_labelled, id_col, text_col,
            quality_col) -> tuple[np.ndarray, DataFrame, Column] | None:
    """Log ratios of the buckets, the scored documents with ``key``, and the verdict on a row; None without a target."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = cut_lineage(ngrams.labelled_sample(
        one_label(labels, F.col(quality_col), id_col), max_labelled, seed, "_label_id"))
    labelled = cut_lineage(labelled_texts(docs, sample).withColumn("cls", F.when(F.col("_label") >= 1, 0)))
    target = ngrams.bucket_counts(labelled, 1)
    if not target.any():
        return None
    raw = ngrams.bucket_counts(docs.withColumn("cls", F.lit(0)), 1)
    ratios = ngrams.log_ratio(target[0], raw[0])
    scored = cut_lineage(log_weights(docs, ratios))
    known = (log_weights(labelled, ratios).join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id"))
             .select("log_ratio", "_label").toPandas())  # a row per id of the sample
    cut = best_threshold(known.log_ratio[known._label >= 1].to_numpy(), known.log_ratio[known._label < 1].to_numpy())
    keyed = scored.withColumn("key", noisy_key(seed, temperature))
    return ratios, keyed, _verdict(keyed, scored.filter(F.col("log_ratio") >= cut).count())


def drop_rejected(docs: DataFrame, labels: DataFrame, seed: int = 42, temperature: float = TEMPERATURE,
                  max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text",
                  quality_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, all columns.

    The log ratios are worked out again from the texts in one map over the rows, so each row has its own verdict,
    whatever rows share its id or have none, and nothing is shuffled.
    """
    fitted = _fitted(docs, labels, seed, temperature, max_labelled, id_col, text_col, quality_col)
    if fitted is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(fitted[0])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text", ngrams.SLICE):
                sums, words = ngrams.score_texts(part.column("text"), shared.value[None])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("doc_id"), pa.array(sums[:, 0] / np.maximum(words, 1))],
                    ["_row", "doc_id", "log_ratio"])

    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    schema = T.StructType().add("_row", docs.schema).add("doc_id", "long").add("log_ratio", "double")
    return (rows.mapInArrow(run, schema).withColumn("key", noisy_key(seed, temperature)).filter(fitted[2])
            .select("_row.*"))
