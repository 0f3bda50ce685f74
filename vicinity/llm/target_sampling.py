"""Importance resampling towards a target distribution, with n-gram spans from an overlapped regex scan.

A text's separators collapse to single spaces; ``regex`` with ``overlapped=True`` and a look-behind for the word
boundary then emits, at every word, the spans of the runs of 1 to n words that begin there, and the CRC of each run is
carried on from the run one word shorter.  A text is scanned once: its buckets (two bytes a feature) are stored, and
counts, gains and weights are array operations over them.

The sampling is Gumbel top-k over integer scores.  The ranks are exact over all documents: the scored rows are sorted
by range and numbered from the sizes of the ranges before, so no task sees more than its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat
from operator import methodcaller
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.session import cut_lineage

BUCKETS = 10_000
RUN = 2          # longest run of words that is a feature
MIN_WORDS = 20   # documents with fewer words are not drawn
PERCENT = 25     # share of the others that is drawn
_STEP = 1 << 16  # words whose spans are held as Python objects at a time

# capital letters to small ones; every other byte below 0x80 that is no digit or letter to a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def run_pattern(longest: int) -> regex.Pattern:
    """Matches at each word; group i + 1 is its i-th following word, if there is one, with the space before it."""
    return regex.compile(rb"(?<![^ ])([^ ]++)" + rb"(?:( [^ ]++)" * (longest - 1) + rb")?+" * (longest - 1))


def run_buckets(text: bytes, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """``(words, bucket of each run of words)`` of a whole text."""
    collapsed = b" ".join(text.translate(FOLD).split())
    found = pattern.finditer(collapsed, overlapped=True)
    groups = methodcaller("groups")
    words, parts = 0, []
    while spans := list(map(groups, islice(found, _STEP))):
        words += len(spans)
        codes = repeat(0)
        for place in zip(*spans):  # first words of the runs, then second ones ...
            there = len(place)
            while there and place[there - 1] is None:  # the last runs of a text are shorter
                there -= 1
            codes = list(map(crc32, place[:there], codes))
            parts.append((np.array(codes, np.uint32) % np.uint32(buckets)).astype(np.int32))
    return words, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def features(docs: DataFrame, longest: int = RUN, buckets: int = BUCKETS, id_col: str | None = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, found``: the buckets of all features of a text, as two-byte numbers (four from 65,536 buckets on)."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]):
        pattern = run_pattern(longest)
        for batch in batches:
            for part in bt.slices(batch, "text"):
                raw, offsets = bt.flat(part.column("text"))
                raw = raw.tobytes()
                rows = [run_buckets(raw[a:b], pattern, buckets) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([w for w, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()),
                     pa.array([f.astype(kind).tobytes() for _, f in rows], pa.binary())], ["doc_id", "n_words", "n_features", "found"])

    ids = F.col(id_col) if id_col else F.lit(None)
    src = docs.select(ids.cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_features long, found binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _found(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, bounds)``: row i of ``found`` is ``buckets[bounds[i]:bounds[i + 1]]``."""
    col = batch.column("found").cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    lengths = pc.binary_length(col).to_numpy(zero_copy_only=False) // width
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data.view(kind), np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``found`` by bucket: a row per bucket from each task, ``buckets`` rows to the driver."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_found(batch, kind)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the corpus, rounded down."""
    k = len(corpus)
    all_corpus, all_target = int(corpus.sum()) + k, int(target.sum()) + k
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains over a text's features (none: 0)."""
    kind = _kind(buckets)
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            f, bounds = _found(batch, kind)
            total = bt.sums_between(shared.value[f], bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total // np.maximum(np.diff(bounds), 1))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return (found.select("doc_id", "n_words", "n_features", "found")
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def gumbel_thousandths(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from a digest of the seed and the id (null: no digits)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the given order over the whole table; ``rows`` is stored.

    Sorted by range and within each range; a row's rank is its place in its range plus the sizes of the ranges before.
    Rows that are equal in the order are told apart by their place in storage, so a hot one spreads over ranges.
    """
    placed = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()))
    by = [*order, F.col("_place")]
    at = F.monotonically_increasing_id()  # range number in the upper bits, place in the range in the lower 33
    sorted_rows = cut_lineage(placed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at)
                              .withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    sizes = sorted(sorted_rows.groupBy("_range").agg(F.max("_at") + 1).collect())  # a row per range
    starts = np.concatenate(([0], np.cumsum([s for _, s in sizes], dtype=np.int64)))
    offsets = rows.sparkSession.createDataFrame([(int(r), int(s)) for (r, _), s in zip(sizes, starts)], "_range long, _start long")
    return (sorted_rows.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_start") + F.col("_at") + 1)
            .drop("_range", "_start", "_at", "_place"))


def resample(docs: DataFrame, target: DataFrame, longest: int = RUN, buckets: int = BUCKETS, seed: int = 7,
             min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it isn't drawn.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn; ties go to the smaller id, null ids last.

    * null, empty or blank text: no features, weight 0, never drawn (unless ``min_words`` is 0);
    * repeated rows and ids: each is a document; a null id has the noise of an id without digits;
    * equal rows at the cut: as many as there is room for; other columns are not read;
    * empty target: every gain is that of a flat target; empty documents: no rows.
    """
    found = cut_lineage(features(docs, longest, buckets, id_col, text_col))
    wanted = features(target, longest, buckets, None, target_col)
    gain = gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets))
    scored = cut_lineage(weights(found, gain, buckets)
                         .withColumn("score", F.col("weight") + gumbel_thousandths("doc_id", seed)))
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    ranked = with_rank(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
