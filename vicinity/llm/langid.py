"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language over the letters of a word (all other
characters are word ends).  Models are counted in Spark on a bounded hash
sample of each language's training texts.  All languages share sorted hash
arrays: one array of n-gram hashes per order with a row of finished log
probabilities (one per language), so a position is looked up once for all of
them, and the few positions without the n-gram back off through the arrays of
context hashes.  The language with the lowest cross-entropy per symbol is
predicted.  A second part of the sample, which the counts have not seen, sets the
temperature that turns cross-entropies into a probability, and the limits above
which a text is rejected as none of the languages.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.session import cut_lineage

ORDER = 4
MAX_DOCS = 4_000     # bound on the training texts of a language
MIN_COUNTED = 20  # texts that a language must have left to count when a fifth calibrates
REJECT_SHARE = 0.005  # share of true texts that the rejection limits may lose
LENGTHS = (20, 100)  # symbols; rejection limits are set apart for shorter and longer texts
UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, first)``: lower-case letters of all words, 0 at each word's end; bounds of each text."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), "<u4")
    codes = np.where(_is_letter()[points], points, 0).astype(np.uint64)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    kept = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], np.concatenate(([0], kept[ends]))


def histories(codes: np.ndarray) -> list[np.ndarray]:
    """For each position its code and the 1, 2, ... ``ORDER - 1`` codes before it within the word, 0 beyond the start."""
    out = [codes]
    inside = np.ones(len(codes), bool)
    for k in range(1, ORDER):
        h = np.zeros_like(codes)
        h[k:] = codes[:-k]
        inside &= h != 0
        out.append(np.where(inside, h, np.uint64(0)))
    return out


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram given from its last symbol backwards."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += p + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def _group(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of a first row of each distinct combination, and the combination's number for every row."""
    _, first, number = np.unique(gram_hash(columns), return_index=True, return_inverse=True)
    return first, number


@dataclasses.dataclass
class CharModels:
    """``grams[k]``: sorted hashes and log2 probabilities; ``contexts[k]``: sorted hashes and log2 backoff weights."""

    langs: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    unseen: float
    temperature: float = 1.0
    limits: np.ndarray | None = None  # [langs, length classes], bits per symbol

    def log_probs(self, history: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        """log2 p of each position in each language."""
        if order == 0:
            return np.full((len(history[0]), len(self.langs)), self.unseen)
        keys, values = self.grams[order]
        h = gram_hash(history[:order])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = values[at]
        miss = np.flatnonzero(keys[at] != h)
        if len(miss):
            fewer = [x[miss] for x in history]
            keys, weights = self.contexts[order]
            h = gram_hash(fewer[1:order] or [np.zeros(len(miss), np.uint64)])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            back = np.where((keys[at] == h)[:, None], weights[at], 0.0)
            out[miss] = back + self.log_probs(fewer, order - 1)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``([texts, langs] bits per symbol, symbols per text)``; 0 for a text without letters."""
        codes, first = symbols(texts)
        n = np.diff(first)
        if not len(codes):
            return np.zeros((len(texts), len(self.langs))), n
        logs = self.log_probs(histories(codes))
        sums = np.stack([bt.sums_between(logs[:, i], first) for i in range(len(self.langs))], 1)
        return -sums / np.maximum(n, 1)[:, None], n

    def probabilities(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -bits * np.sqrt(np.maximum(n, 1))[:, None] * self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def rejects(self, bits: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        return bits[np.arange(len(best)), best] > self.limits[best, np.digitize(n, LENGTHS)]


def kneser_ney(grams: list[np.ndarray], counts: np.ndarray, langs: list[str]) -> CharModels:
    """Models from the distinct n-grams (columns from the last symbol backwards) and their counts ``[grams, langs]``."""
    levels = {ORDER: (grams, counts)}
    for k in range(ORDER - 1, 0, -1):
        longer, raw = levels[k + 1]
        first, number = _group(longer[:k])
        total = np.zeros((len(first), len(langs)))
        np.add.at(total, number, raw)
        levels[k] = ([c[first] for c in longer[:k]], total)
    alphabet = len(levels[1][1]) + 1
    model = CharModels(langs, {}, {}, -float(np.log2(alphabet)))
    lower = np.full((1, len(langs)), 1 / alphabet)
    for k in range(1, ORDER + 1):
        parts, raw = levels[k]
        adjusted = raw
        if k < ORDER:  # lower orders count the symbols seen before, except at a word's start, where nothing is
            longer, more = levels[k + 1]
            _, number = _group(longer[:k])
            kinds = np.zeros_like(raw)
            np.add.at(kinds, number, more > 0)
            start = (parts[k - 1] == 0) if k > 1 else np.zeros(len(raw), bool)
            adjusted = np.where(start[:, None], raw, kinds)
        ones, twos = (adjusted == 1).sum(0), (adjusted == 2).sum(0)
        discount = np.clip(np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.95)
        context = parts[1:k] or [np.zeros(len(raw), np.uint64)]
        first, number = _group(context)
        total, kinds = np.zeros((len(first), len(langs))), np.zeros((len(first), len(langs)))
        np.add.at(total, number, adjusted)
        np.add.at(kinds, number, adjusted > 0)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        suffix = np.zeros(len(raw), np.int64)
        if k > 1:
            suffix = np.searchsorted(below, gram_hash(parts[:k - 1]))
        p = np.maximum(adjusted - discount, 0) / np.maximum(total, 1)[number] + back[number] * lower[suffix]
        key = gram_hash(parts)
        order = np.argsort(key)
        below, lower = key[order], p[order]
        model.grams[k] = below, np.log2(lower)
        key = gram_hash([c[first] for c in context])
        order = np.argsort(key)
        model.contexts[k] = key[order], np.log2(back[order])
    return model


def _counted(train: DataFrame, langs: list[str]) -> CharModels:
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                codes, first = symbols(part.column("text").to_pylist())
                lang = np.repeat([index[x] for x in part.column("lang").to_pylist()], np.diff(first)).astype(np.uint64)
                columns = [*histories(codes), lang]
                at, number = _group(columns)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[at].view(np.int64)) for c in columns),
                     pa.array(np.bincount(number, minlength=len(at)), pa.int64())], [*names, "lang", "n"])

    names = [f"s{i}" for i in range(ORDER)]
    rows = (train.select("text", "lang").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "lang", "n"]))
            .groupBy(*names, "lang").agg(F.sum("n").alias("n")).toPandas())  # n-grams of the bounded sample
    grams = [rows[c].to_numpy(np.int64).view(np.uint64) for c in names]
    first, number = _group(grams)
    counts = np.zeros((len(first), len(langs)))
    np.add.at(counts, (number, rows["lang"].to_numpy()), rows["n"].to_numpy())
    return kneser_ney([g[first] for g in grams], counts, langs)


def _calibrate(model: CharModels, held: DataFrame) -> None:
    """Temperature by likelihood, rejection limits by quantiles, on texts that the counts have not seen."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in bt.slices(batch, "text"):
                bits, n = shared.value.cross_entropies(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(n, pa.int64()),
                                                  pa.array(list(bits), pa.list_(pa.float64()))], ["lang", "n", "bits"])

    rows = held.select("text", "lang").mapInArrow(run, "lang string, n long, bits array<double>").filter("n > 0").collect()
    model.limits = np.full((len(model.langs), len(LENGTHS) + 1), np.inf)
    if not rows:
        return
    bits, n = np.array([r["bits"] for r in rows]), np.array([r["n"] for r in rows])
    truth = np.array([model.langs.index(r["lang"]) for r in rows])

    def loss(t):
        model.temperature = t
        return -np.log(model.probabilities(bits, n)[np.arange(len(n)), truth] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    for i in range(len(model.langs)):
        for j in range(len(LENGTHS) + 1):
            own = bits[(truth == i) & (np.digitize(n, LENGTHS) == j), i]
            if len(own) >= 1 / REJECT_SHARE / 10:
                model.limits[i, j] = np.quantile(own, 1 - REJECT_SHARE) * 1.1


def train(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = 42) -> CharModels | None:
    """Models of the languages in ``docs`` (``doc_id``, ``text``, ``lang``, all of them training rows); None without any.

    A language's distinct texts by id are sampled by a hash to at most ``max_docs``; a fifth of them calibrates where at least
    ``MIN_COUNTED`` others are left to count, else all are counted.  None too if no text has a letter.
    """
    docs = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    # a row per language; repeated rows of an id, and those without one, count once each text
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()}
    if not sizes:
        return None
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int(1_000_003 * min(1.0, 1.1 * max_docs / n)) + 1).otherwise(limit)
    picked = docs.filter(F.pmod(key, F.lit(1_000_003)) < limit).dropDuplicates(["doc_id", "text", "lang"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))  # of about max_docs rows
    sample = cut_lineage(picked.withColumn("_place", place).filter(F.col("_place") <= max_docs).drop("_place"))
    fifth = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(5)) == 0
    left = {r[0]: r[1] for r in sample.filter(~fifth).groupBy("lang").count().collect()}  # a row per language
    held = fifth & F.col("lang").isin([x for x in sizes if left.get(x, 0) >= MIN_COUNTED])
    model = _counted(sample.filter(~held), sorted(sizes))
    if not len(model.grams[1][0]):
        return None
    _calibrate(model, sample.filter(held))
    return model


def identify(docs: DataFrame, model: CharModels | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits, rejected`` of every whole text; map only, from the text alone.

    ``score`` is the calibrated probability of the prediction, ``bits`` its cross-entropy per symbol; ``rejected``
    says that this is above what true texts of that language have.  A text that is null or has no letter is ``und``
    with score 0 and not rejected; without a model every text is ``und``.  Rows repeat as they come, an empty table has
    none, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            for part in bt.slices(batch, "text", 1 << 20):
                rows = part.num_rows
                pred, score, best_bits, rejected = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.zeros(rows, bool)
                if m is not None:
                    bits, n = m.cross_entropies(part.column("text").to_pylist())
                    best = bits.argmin(1)
                    some = n > 0
                    at = np.arange(rows)
                    score = np.where(some, m.probabilities(bits, n)[at, best], 0.0)
                    best_bits = np.where(some, bits[at, best], 0.0)
                    rejected = some & m.rejects(bits, n, best)
                    pred = [m.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(best_bits),
                     pa.array(rejected)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))
