"""MaxSim of passages of words whose vectors come from a vocabulary.

The vectors of a word's occurrences are equal, so none is made per token: a packed block holds the numbers of its
passages' words and each of its words' vectors once.  Blocks are stored once and crossed as those of
:mod:`vicinity.operators.similarity`.  In a task the words of the two blocks are scored against each other, a strip of query
words at a time; a passage's best score for a word is the largest over its words, and a query's score the sum over its
words, each as often as it occurs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.hashing import bucket
from vicinity.operators.encode import lookup_token_vectors, vector_length
from vicinity.operators.similarity import (LONG, MATCH_SCHEMA, SCORE_CELLS, RunningTopk, _final_topk, _ids, _matrix, _np, block_columns,
                                           crossed)
from vicinity.session import cut_lineage

QUERY_WORDS = 1 << 21          # (query, word) rows of a block: the more, the fewer words are in several blocks
PASSAGE_WORDS = 1 << 18        # (passage, word) rows of a block
PASSAGES = 1 << 12             # passages of a block
WORD_BYTES = 256 << 20         # vectors of a block's words


def _blocks(words: DataFrame, vocab: DataFrame, rows: int, dim: int, vocab_rows: int, fill: int) -> tuple[DataFrame, int]:
    """Packed blocks of ``words(id, token, n)``, and how many there are: ``fill`` where the bounds ask for fewer."""
    count, ids = words.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if min(vocab_rows, rows) * dim * 8 > WORD_BYTES:
        rows = max(1, min(rows, WORD_BYTES // (dim * 8)))
    n = max(1, math.ceil(count / rows), math.ceil(ids / PASSAGES), min(fill, count >> 14))
    dealt = words.withColumn("_b", bucket("id", n).cast("int"))
    none = F.lit(None)
    vectors = lookup_token_vectors(dealt.select("_b", "token").distinct(), vocab)
    # a block's words and their vectors come to one task, in any order
    both = (dealt.select("_b", "id", "token", "n", none.cast("array<double>").alias("vec"))
            .unionByName(vectors.select("_b", none.cast("long").alias("id"), "token", F.lit(0).cast("long").alias("n"), "vec")))
    names = ["ids", "lens", "words", "counts", "vecs"]

    def run(batches):
        uses, known, vecs = [], [], []
        for b in batches:
            given = pc.is_valid(b.column("vec"))
            at = b.filter(given)
            known.append(at.column("token"))
            vecs.append(_matrix(at.column("vec")))
            uses.append(b.select(["id", "token", "n"]).filter(pc.invert(given)))
        if not any(len(v) for v in vecs):
            return
        V = np.concatenate([v for v in vecs if len(v)])
        t = pa.Table.from_batches(uses)
        t = t.append_column("word", pc.index_in(t.column("token"), pa.chunked_array(known).combine_chunks()))
        t = t.filter(pc.is_valid(t.column("word")))
        ids, word, n = _ids(t.column("id")), _np(t.column("word")).astype(np.int32), _np(t.column("n"))
        order = np.lexsort((word, ids))
        ids, lens = np.unique(ids, return_counts=True)
        packed = (ids, lens.astype(np.int64), word[order], n[order].astype(np.int64), V)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names)

    return cut_lineage(both.repartitionById(n, "_b").drop("_b").mapInArrow(run, ", ".join(f"{c} binary" for c in names))), n


def best_of_words(S: np.ndarray, words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``[passages, columns]``: the largest row entry of ``S`` over the words of each passage (``lens`` of them, at least 1)."""
    pieces = -(-lens // LONG)
    cut = np.full(pieces.sum(), LONG)
    cut[np.cumsum(pieces) - 1] = lens - (pieces - 1) * LONG
    order = np.argsort(-cut, kind="stable")
    starts = (np.cumsum(cut) - cut)[order]
    best = np.empty((len(cut), S.shape[1]))
    for lo in range(0, len(cut), 512):  # some pieces at a time, so that their best scores stay in the cache
        at, sizes = starts[lo:lo + 512], cut[order[lo:lo + 512]]
        top = S[words[at]]
        found = np.empty_like(top)
        for p in range(1, sizes[0]):
            n = int(np.searchsorted(-sizes, -p, side="left"))
            np.take(S, words[at[:n] + p], axis=0, out=found[:n], mode="clip")
            np.maximum(top[:n], found[:n], out=top[:n])
        best[order[lo:lo + 512]] = top
    return best if len(cut) == len(lens) else np.maximum.reduceat(best, np.cumsum(pieces) - pieces, axis=0)


def word_scores(query: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, Q: np.ndarray, words: np.ndarray, lens: np.ndarray,
                D: np.ndarray) -> np.ndarray:
    """``[queries, passages]`` scores of ``n`` queries, given as rows ``(query, word, count)`` sorted by word."""
    scores = np.zeros((n, len(lens)))
    used, words = np.unique(words, return_inverse=True)
    D = D[used]
    width = max(16, min(256, 4 * SCORE_CELLS // len(D)))
    step = max(1, SCORE_CELLS // len(lens))
    asked = np.unique(word)
    for at in range(0, len(asked), width):
        some = asked[at:at + width]
        best = np.ascontiguousarray(best_of_words(D @ Q[some].T, words, lens).T)
        lo, hi = np.searchsorted(word, some[0], side="left"), np.searchsorted(word, some[-1], side="right")
        place, order = np.searchsorted(some, word[lo:hi]), np.argsort(query[lo:hi], kind="stable")
        # a query's first words, then its second ones and so on: sums over few words each are whole rows added
        heads = np.flatnonzero(np.diff(query[lo:hi][order], prepend=-1))
        turn = np.arange(hi - lo) - np.repeat(heads, np.diff(np.append(heads, hi - lo)))
        order, ends = order[np.argsort(turn, kind="stable")], np.cumsum(np.bincount(turn))
        for first, last in zip(ends - np.bincount(turn), ends):
            for e in range(first, last, step):
                rows = order[e:min(last, e + step)]
                scores[query[lo:hi][rows]] += best[place[rows]] * count[lo:hi][rows, None]
    return scores


def maxsim_words(query_tokens: DataFrame, passage_tokens: DataFrame, vocab: DataFrame, k: int, exclude_self: bool = False,
                 query_words: int = QUERY_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Exact top-k by MaxSim of ``query_tokens(qid, token)`` and ``passage_tokens(pid, token)``, a row per occurrence, whose vectors
    are those that :func:`vicinity.operators.encode.lookup_token_vectors` finds in ``vocab(token, vec)`` -> ``(qid, rank, pid, score)``.

    The lookup is of the distinct tokens of each block; it drops tokens that the vocabulary doesn't have.
    """
    cores = query_tokens.sparkSession.sparkContext.defaultParallelism
    vocab = cut_lineage(vocab.select("token", "vec").filter("token is not null and vec is not null"))
    dim, rows = vector_length(vocab), vocab.count()

    def counted(tokens: DataFrame, key: str) -> DataFrame:
        return cut_lineage(tokens.groupBy(F.col(key).cast("long").alias("id"), "token").agg(F.count(F.lit(1)).alias("n")))

    q, _ = _blocks(counted(query_tokens, "qid"), vocab, query_words, dim, rows, 1)
    d, parts = _blocks(counted(passage_tokens, "pid"), vocab, passage_words, dim, rows, 2 * cores)
    names = ("ids", "lens", "words", "counts", "vecs")
    left, right = (side.select(*(F.col(c).alias(f"{at}{c}") for c in names)) for at, side in (("q", q), ("d", d)))
    kinds = {f"{at}{c}": t for at in "qd" for c, t in zip(names, (np.int64, np.int64, np.int32, np.int64, np.float64))
             if (at, c) != ("d", "counts")}

    def score(batches):
        for qids, qlens, word, count, Q, pids, lens, words, D in block_columns(batches, kinds):
            Q, D = Q.reshape(-1, dim), D.reshape(-1, dim)
            order = np.argsort(word, kind="stable")
            query, word, count = np.repeat(np.arange(len(qids)), qlens)[order], word[order], count[order]
            top, ends = RunningTopk(len(qids), k), np.cumsum(lens)
            step = max(1, 8 * SCORE_CELLS // len(qids))
            for at in range(0, len(pids), step):
                to = min(at + step, len(pids))
                key = word_scores(query, word, count, len(qids), Q, words[ends[at] - lens[at]:ends[to - 1]], lens[at:to], D)
                if exclude_self:
                    key[qids[:, None] == pids[None, at:to]] = -np.inf
                top.add(0, key, pids[at:to])
            yield from top.table(qids).to_batches()

    found = crossed(left, right.drop("dcounts")).mapInArrow(score, MATCH_SCHEMA)
    return found.repartition("qid") if parts == 1 else _final_topk(found, k, ascending=False)
