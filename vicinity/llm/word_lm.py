"""Word model: interpolated modified Kneser-Ney bigrams over the whole training text.

Counting and scoring are Spark jobs; the model is a set of sorted hash arrays in
the shared folder (``spark.checkpoint.dir``), cut into shards whose number grows
with the input, and memory-mapped by the workers that score.

* ``words``: the 64-bit hashes of all training words, ascending, with counts; a
  word's place in the arrays is its id.
* ``pairs``: ``id of context << 32 | id of word``, ascending within a shard, with
  counts.  A context's pairs share a shard, but those of a frequent context are
  dealt out by both words, so no shard holds a hot word's row.
* per word: the number of different contexts it follows (its lower-order count),
  and how many words follow it once, twice and more often.

Tasks count their own texts first and send packed arrays, one per shard.  The
driver sees one row per shard.  A text is its words and one end mark; contexts
begin with a start mark.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import bytetext as bt
from vicinity.llm.arraystore import map_array, pack, sum_by_key, unpack, write_array
from vicinity.session import checkpoint_dir, cut_lineage

_U = np.uint64
END = _U(1)           # hash of the end mark
SLICE = 4 << 20       # bytes of text that are looked up together: more share more words and pairs
HELD_ROWS = 3_000_000  # counts that a task gathers before it sends them
_LOW = _U(0xFFFFFFFF)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the words (A-Z lowered) of each text and its end mark; bounds of each text."""
    raw, offsets = bt.flat(col)
    start, end, first = bt.word_spans(raw, offsets)
    words = bt.span_hashes(bt.LOWER[raw], start, end)
    first = first + np.arange(len(first))
    out = np.full(first[-1], END)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = words
    return out, first


class _Held:
    """Counts by key, sent on when there are many."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys, counts) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = sum_by_key(np.concatenate([np.zeros(0, _U), *self.keys]),
                                  np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.keys, self.counts, self.n = [], [], 0
        return keys, counts


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per shard; ``keys`` ascending."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    rows = [(int(shard[order[a]]), pack(keys[order[a:b]], True), pack(counts[order[a:b]].astype(np.int64)))
            for a, b in zip(cuts[:-1], cuts[1:])]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])


PACKED = "shard int, keys binary, counts binary"


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [unpack(x.as_py(), _U, True) for x in table.column("keys")]
    counts = [unpack(x.as_py(), np.int64) for x in table.column("counts")]
    return table.column("shard")[0].as_py(), *sum_by_key(np.concatenate(keys), np.concatenate(counts))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of keys counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2):
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5
    return np.array([min(max(d, 0.05), 0.95 * k) for k, d in enumerate(raw, 1)])


@dataclasses.dataclass
class WordModel:
    """What the workers need besides the arrays in ``base``."""

    base: str
    bits: int                 # words are sharded by this many leading bits of their hash
    offsets: np.ndarray       # id of each shard's first word, and their number
    train_tokens: int = 0
    train_texts: int = 0
    pair_types: int = 0
    pair_discounts: np.ndarray | None = None
    word_discounts: np.ndarray | None = None
    word_types: np.ndarray | None = None   # words that follow 1, 2, 3 or more contexts
    start_types: np.ndarray | None = None  # words that follow the start mark 1, 2, 3 or more times

    @property
    def vocabulary(self) -> int:
        return int(self.offsets[-1])

    @property
    def shards(self) -> int:
        return len(self.offsets) - 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, -1 for words that the training text doesn't have."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(hashes >> _U(64 - self.bits) if self.bits else np.zeros(len(hashes), _U),
                               np.arange(self.shards + 1))
        for s in range(self.shards):
            if cuts[s] < cuts[s + 1] and self.offsets[s] < self.offsets[s + 1]:
                keys = map_array(self.base, f"words-{s}", "u8")
                at = np.searchsorted(keys, hashes[cuts[s]:cuts[s + 1]])
                hit = keys[np.minimum(at, len(keys) - 1)] == hashes[cuts[s]:cuts[s + 1]]
                out[cuts[s]:cuts[s + 1]][hit] = at[hit] + self.offsets[s]
        return out

    def of_words(self, name: str, ids: np.ndarray, dtype: str = "i8") -> np.ndarray:
        """Values of array ``name`` at ascending ids; 0 at -1."""
        out = np.zeros(len(ids), np.dtype(dtype))
        cuts = np.searchsorted(ids, self.offsets)
        for s in range(self.shards):
            if cuts[s] < cuts[s + 1]:
                out[cuts[s]:cuts[s + 1]] = map_array(self.base, f"{name}-{s}", dtype)[ids[cuts[s]:cuts[s + 1]] - self.offsets[s]]
        return out

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        order = np.argsort(ids, kind="stable")
        out = np.empty(len(ids), np.int64)
        out[order] = self.of_words("counts", ids[order])
        return out

    def pair_shards(self, pairs: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """Shard of each pair: by its context, or by both words where the context has many tokens."""
        context = pairs >> _U(32)
        hot = context_counts > max(self.train_tokens // (4 * self.shards), 1)
        return (bt.mix(np.where(hot, pairs, context) + _U(7)) % _U(self.shards)).astype(np.int64)

    def pair_counts(self, pairs: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """Training counts of ascending pairs."""
        shard = self.pair_shards(pairs, context_counts)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        out = np.zeros(len(pairs), np.int64)
        for s in range(self.shards):
            at = order[cuts[s]:cuts[s + 1]]
            if len(at):
                keys = map_array(self.base, f"pairs-{s}", "u8")
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, pairs[at]), len(keys) - 1)
                    counts = map_array(self.base, f"pair_counts-{s}", "u4")
                    if len(counts) > len(keys):
                        counts = map_array(self.base, f"pair_counts-{s}", "u8")
                    out[at] = np.where(keys[where] == pairs[at], counts[where], 0)
        return out

    # ---- probabilities

    def lower(self, follows: np.ndarray) -> np.ndarray:
        """Lower-order probability from the number of contexts; interpolated with a uniform share for each word and one unknown."""
        uniform = 1 / (self.vocabulary + 1)
        if not self.pair_types:
            return np.full(len(follows), uniform)
        kept = np.maximum(follows - _by_count(self.word_discounts, follows), 0) / self.pair_types
        return kept + float(self.word_discounts @ self.word_types) / self.pair_types * uniform

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: number of known tokens, base log10 probability, the model's."""
        words, place = np.unique(hashes, return_inverse=True)
        ids = self.ids(words)
        order = np.argsort(ids, kind="stable")
        counts, follows = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        counts[order], follows[order] = self.of_words("counts", ids[order]), self.of_words("follows", ids[order])
        backoff = np.zeros(len(ids))
        for k in range(3):
            followed = np.zeros(len(ids), np.int64)
            followed[order] = self.of_words(f"followed{k + 1}", ids[order], "u4")
            backoff += self.pair_discounts[k] * followed
        lower = self.lower(follows)

        base = np.log10((counts + 1) / (self.train_tokens + self.vocabulary + 1))
        # the context of a text's first token is the start mark, whose id comes after those of all words
        head = np.zeros(len(hashes) + 1, bool)
        head[first] = True
        head = head[:-1]
        before = np.concatenate((place[:1], place[:-1]))
        context = np.where(head, self.vocabulary, ids[before])
        total = np.where(head, self.train_texts, counts[before])
        back = np.where(head, float(self.pair_discounts @ self.start_types), backoff[before])
        token = ids[place]
        p = lower[place]
        known = np.flatnonzero((context >= 0) & (total > 0))
        seen = known[token[known] >= 0]
        pair = (context[seen].astype(_U) << _U(32)) | token[seen].astype(_U)
        pairs, at, which = np.unique(pair, return_index=True, return_inverse=True)
        c = np.zeros(len(hashes), np.int64)
        c[seen] = self.pair_counts(pairs, total[seen][at])[which]
        kept = np.maximum(c[known] - _by_count(self.pair_discounts, c[known]), 0)
        p[known] = (kept + back[known] * p[known]) / total[known]
        return (bt.sums_between(counts[place] > 0, first), bt.sums_between(base[place], first),
                bt.sums_between(np.log10(p), first))


def _by_count(discount: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], discount))[np.minimum(counts, 3)]


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as 32 bits where the largest fits, else 64; twice the length of the keys in 32-bit words tells a reader."""
    return counts.astype(np.uint32 if counts.max(initial=0) <= 0xFFFFFFFF else np.uint64)


def _count_words(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        held = _Held()

        def send():
            words, counts = held.drain()
            yield from _packed((words >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64),
                               words, counts)

        for batch in batches:
            for part in bt.slices(batch, "text", SLICE):
                held.add(*np.unique(tokens(part.column("text"))[0], return_counts=True))
                if held.n > HELD_ROWS:
                    yield from send()
        yield from send()

    return texts.mapInArrow(run, PACKED)


def _count_pairs(texts: DataFrame, model: WordModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        held = _Held()

        def send():
            pairs, counts = held.drain()
            context = (pairs >> _U(32)).astype(np.int64)
            at_start = context == model.vocabulary
            totals = np.where(at_start, model.train_texts, 0)
            totals[~at_start] = model.word_counts(context[~at_start])
            yield from _packed(model.pair_shards(pairs, totals), pairs, counts)

        for batch in batches:
            for part in bt.slices(batch, "text", SLICE):
                hashes, first = tokens(part.column("text"))
                words, place = np.unique(hashes, return_inverse=True)
                ids = model.ids(words)[place]
                before = np.concatenate((ids[:1], ids[:-1]))
                before[first[:-1]] = model.vocabulary
                held.add(*np.unique((before.astype(_U) << _U(32)) | ids.astype(_U), return_counts=True))
                if held.n > HELD_ROWS:
                    yield from send()
        yield from send()

    return texts.mapInArrow(run, PACKED)


def train(texts: DataFrame, shards: int | None = None) -> WordModel:
    """Model of all rows of ``texts`` (column ``text``; null counts as empty).

    ``shards`` is rounded up to a power of two and follows the number of input partitions unless given.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    bits = (max(shards or texts.rdd.getNumPartitions(), 1) - 1).bit_length()
    base = f"{checkpoint_dir(spark).rstrip('/')}/words-{uuid.uuid4().hex}"

    def store_words(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        write_array(base, f"words-{shard}", keys)
        write_array(base, f"counts-{shard}", counts)
        ends = counts[keys == END].sum()
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "ends": [int(ends)]})

    rows = (_count_words(texts, bits).groupBy("shard").applyInArrow(store_words, "shard int, n long, total long, ends long")
            .collect())  # a row per shard
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    model = WordModel(base, bits, np.concatenate(([0], np.cumsum(sizes))), sum(r["total"] for r in rows), sum(r["ends"] for r in rows))
    if model.vocabulary >= 1 << 32:
        raise ValueError(f"{model.vocabulary} distinct words; a pair of ids has 32 bits for each")
    model.pair_discounts = model.word_discounts = np.full(3, 0.5)
    model.word_types = model.start_types = np.zeros(3, np.int64)
    if not model.train_texts:
        return model

    def store_pairs(table: pa.Table) -> pa.Table:
        shard, pairs, counts = _merged(table)
        write_array(base, f"pairs-{shard}", pairs)
        write_array(base, f"pair_counts-{shard}", narrow(counts))
        context, word = pairs >> _U(32), pairs & _LOW
        sizes = np.bincount(np.minimum(counts, 5), minlength=6)
        own = context < _U(model.vocabulary)
        start = np.bincount(np.minimum(counts[~own], 3), minlength=4)[1:]
        out = [(-1, "sizes", b"", pack(np.concatenate((sizes[1:5], start, [len(pairs)]))))]
        kinds = [("follows", word, np.ones(len(word), np.int64))]
        for k in (1, 2, 3):
            at = own & ((counts == k) if k < 3 else (counts >= 3))
            kinds.append((f"followed{k}", context[at], np.ones(int(at.sum()), np.int64)))
        for kind, ids, ones in kinds:
            ids, n = sum_by_key(ids, ones)
            cuts = np.searchsorted(ids, model.offsets.astype(_U))
            out += [(s, kind, pack(ids[a:b], True), pack(n[a:b]))
                    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "kind": [x[1] for x in out],
                         "keys": pa.array([x[2] for x in out], pa.binary()), "counts": pa.array([x[3] for x in out], pa.binary())})

    partial = cut_lineage(_count_pairs(texts, model).groupBy("shard")
                          .applyInArrow(store_pairs, "shard int, kind string, keys binary, counts binary"))
    sizes = sum(unpack(r["counts"], np.int64) for r in partial.filter("shard < 0").select("counts").collect())  # a row per shard

    def store_types(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lo, n = int(model.offsets[shard]), int(model.offsets[shard + 1] - model.offsets[shard])
        values = {"follows": np.zeros(n, np.int64), **{f"followed{k}": np.zeros(n, np.uint32) for k in (1, 2, 3)}}
        for kind, keys, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
            values[kind][unpack(keys, _U, True).astype(np.int64) - lo] += unpack(counts, np.int64).astype(values[kind].dtype)
        for kind, v in values.items():
            write_array(base, f"{kind}-{shard}", v)
        sizes = np.bincount(np.minimum(values["follows"], 5), minlength=6)
        return pa.table({"sizes": pa.array([sizes.tolist()], pa.list_(pa.int64()))})

    types = (partial.filter("shard >= 0").groupBy("shard").applyInArrow(store_types, "sizes array<long>").collect())
    follows = np.sum([r["sizes"] for r in types], axis=0)
    model.pair_discounts, model.word_discounts = discounts(sizes[:4]), discounts(follows[1:5])
    model.start_types, model.pair_types = sizes[4:7], int(sizes[7])
    model.word_types = np.array([follows[1], follows[2], follows[3:].sum()])
    return model


def score(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10) of every whole text; map only.

    A null text counts as empty and has the end mark alone; rows and null ids repeat as they come; other columns are
    not read.  Perplexity is ``10 ** (-score / n_tokens)``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            for part in bt.slices(batch, "text", SLICE):
                hashes, first = tokens(part.column("text"))
                known, base, own = m.score(hashes, first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(known),
                     pa.array(np.full(len(known), m.train_tokens, np.int64)), pa.array(base), pa.array(own)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
