"""Hashed n-grams of whole texts, and bucket counts and scores over them (shared by the classifiers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt

WORD_BUCKETS = 1 << 15
SHAPE_BUCKETS = 1 << 12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
SLICE = 1 << 20  # bytes of text whose n-grams are held together: some 40 arrays of a number a word
_PIECE = 64  # buckets that a task sends in one row

_KIND = np.full(256, 4, np.int8)  # 0 capital, 1 small, 2 digit, 3 beyond ASCII, 4 other, 5 .,;: 6 !?
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[list(b".,;:")], _KIND[list(b"!?")] = 5, 6


def hashes(col: pa.Array) -> tuple[np.ndarray, ...]:
    """``(first, word, word before, shape, shape before)``: uint64 hashes at every word of each text.

    Words are lower-cased and lose one closing mark; "before" is 0 at a text's first word.  A shape holds the kinds
    of a word's first and last byte, whether it has capitals or small letters after the first byte, its length class,
    and whether it equals the word before.
    """
    raw, offsets = bt.flat(col)
    start, end, first = bt.word_spans(raw, offsets)
    if not len(start):
        return first, *[np.zeros(0, np.uint64)] * 4
    head = np.zeros(len(start) + 1, bool)
    head[first] = True
    head = head[:-1]

    def shifted(x):
        out = np.concatenate((x[:1], x[:-1]))
        out[head] = 0
        return out

    last = _KIND[raw[end - 1]]
    h = bt.span_hashes(bt.LOWER[raw], start, end - ((last >= 5) & (end - start > 1)))
    before = shifted(h)
    kinds = _KIND[raw]
    capitals, small = (np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int32))) for k in (0, 1))
    length = np.digitize(end - start, (2, 4, 8, 16))
    shape = (((_KIND[raw[start]].astype(np.int64) * 7 + last) * 2 + (capitals[end] > capitals[start + 1])) * 2
             + (small[end] > small[start + 1])) * 10 + length * 2 + (before == h)
    shape = shape.astype(np.uint64) + np.uint64(1)
    return first, h, before, shape, shifted(shape)


def streams(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(first, [words, word pairs, shapes, shape pairs])``: the bucket of each, at every word of each text."""
    first, h, before, shape, shape_before = hashes(col)
    word, rest = np.uint64(WORD_BUCKETS - 1), np.uint64(SHAPE_BUCKETS - 1)
    return first, [(h & word).astype(np.int64), (bt.join_hashes(before, h) & word).astype(np.int64),
                   (bt.mix(shape.copy()) & rest).astype(np.int64) + WORD_BUCKETS,
                   (bt.join_hashes(shape_before, shape) & rest).astype(np.int64) + WORD_BUCKETS]


def bucket_counts(docs: DataFrame, classes: int, text_col: str = "text", class_col: str = "cls") -> np.ndarray:
    """``[classes, BUCKETS]`` n-gram counts of the rows of each class (``cls`` in 0..classes-1; others count nowhere).

    A task sends its counts in pieces of 64 buckets, which Spark sums, so the shuffle depends on the number of tasks and
    the driver gets ``classes * BUCKETS / 64`` rows.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((classes, BUCKETS), np.int64)
        for batch in batches:
            for part in bt.slices(batch, "text", SLICE):
                first, found = streams(part.column("text"))
                cls = part.column("cls").fill_null(-1).to_numpy(zero_copy_only=False)
                per_word = np.repeat(cls, np.diff(first))
                for c in np.unique(cls[(cls >= 0) & (cls < classes)]):
                    for f in found:
                        total[c] += np.bincount(f[per_word == c], minlength=BUCKETS)
        pieces = total.reshape(-1, _PIECE)
        used = np.flatnonzero(pieces.any(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * np.int32(_PIECE)), pa.array(pieces[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], ["piece", "counts"])

    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(class_col).cast("int").alias("cls"))
    rows = (src.mapInArrow(run, "piece int, counts array<long>").groupBy("piece")
            .agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(_PIECE))).alias("counts")).collect())
    out = np.zeros((classes * BUCKETS // _PIECE, _PIECE), np.int64)
    for r in rows:
        out[r["piece"]] = r["counts"]
    return out.reshape(classes, BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Log of the target model's share of each bucket over the raw model's.

    The target's count is set against the count expected of it if it were raw text, both with ``prior`` pseudo-counts:
    a bucket too rare to tell gives a ratio near 1, so a text isn't marked down for n-grams of its own.
    """
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior))


def score_texts(col: pa.Array, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums [texts, tables], words [texts])``: each table summed over all n-grams of each text."""
    first, found = streams(col)
    sums = [bt.sums_between(sum(t[f] for f in found) if len(found[0]) else np.zeros(0), first) for t in tables]
    return np.stack(sums, 1), np.diff(first)


def labelled_sample(labels: DataFrame, limit: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows of ``labels`` (all, if there are no more), by a hash of the id: small enough to broadcast."""
    return labels.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(limit)
