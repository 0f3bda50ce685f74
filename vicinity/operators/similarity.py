"""Top-k similarity joins: exact kNN (inner product / squared L2) and MaxSim.

Physical design
---------------
Three plans, picked by bounded size checks against ``vicinity.broadcast.maxBytes``:

* small corpus (centroid tables, small indexes): the corpus is broadcast and
  every query is finished inside its own task - a single map stage;
* small query side: the queries are broadcast, each task scores its own corpus
  rows in bounded chunks and keeps a running top-k; only ``queries x tasks x k``
  candidates reach the final cut;
* both large: both sides are cut into hash blocks of bounded size, each stored
  once as one packed row, and every (query block, corpus block) pair is a task of
  a cross join, so a task holds at most ``block_rows`` vectors per side and the
  disk one copy of each side, whatever the table sizes.

Kernels score with one numpy product and cut a local top-k (ties:
``round(score, 6)`` best first, then smaller pid).  The final ``row_number``
cut is planned by Spark as partial + final ``WindowGroupLimit``.

The exact join is all-pairs by nature; the scalable route for big corpora is
the inverted-file probe in :mod:`vicinity.operators.ivf`, which reduces the
candidate set by an equi-join on cell before calling the same kernels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.hashing import bucket
from vicinity.session import cut_lineage

METRICS = ("inner_product", "l2_distance")

MATCH_SCHEMA = "qid long, rank int, pid long, score double"
_CAND_SCHEMA = pa.schema([("qid", pa.int64()), ("rank", pa.int32()), ("pid", pa.int64()),
                          ("score", pa.float64())])


# --------------------------------------------------------------------------- helpers

def _matrix(col) -> np.ndarray:
    """ListArray of equal-length numeric lists -> 2-D float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def _np(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.int64())
    return col.to_numpy(zero_copy_only=False)


def topk_rows(qids: np.ndarray, pids: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    """Exact top-k per row of ``key`` (larger is better), ties by smaller pid.

    ``key`` / ``score`` are (n_queries, n_candidates); ``-inf`` keys are invalid.
    """
    nq, nc = key.shape
    if nq == 0 or nc == 0:
        return _CAND_SCHEMA.empty_table()
    kk = min(k, nc)
    kth = np.partition(key, nc - kk, axis=1)[:, nc - kk:nc - kk + 1]
    mask = (key >= kth) & np.isfinite(key)
    rows, cols = np.nonzero(mask)
    order = np.lexsort((pids[cols], -key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(nq))
    rank = np.arange(len(rows)) - starts[rows]
    keep = rank < kk
    rows, cols, rank = rows[keep], cols[keep], rank[keep]
    return pa.table({
        "qid": pa.array(qids[rows].astype(np.int64)),
        "rank": pa.array((rank + 1).astype(np.int32)),
        "pid": pa.array(pids[cols].astype(np.int64)),
        "score": pa.array(score[rows, cols].astype(np.float64)),
    }, schema=_CAND_SCHEMA)


class RunningTopk:
    """Top-k of each of some query rows over candidates that arrive in tiles: rows x k keys and ids, whatever arrives.

    ``key`` (larger is better) is rounded to 6 digits when kept; ties go to the smaller pid.  Only candidates that reach a
    row's k-th key so far are looked at again, so a tile costs little more than its scores.
    """

    def __init__(self, rows: int, k: int):
        self.k, self.key, self.pid = k, np.full((rows, k), -np.inf), None

    def add(self, lo: int, key: np.ndarray, pids: np.ndarray) -> None:
        """Candidates ``pids`` of the rows from ``lo`` on; ``key`` is (rows, candidates), ``-inf`` where there is none."""
        n, nc = key.shape
        if not n or not nc:
            return
        if self.pid is None:
            self.pid = np.zeros(self.key.shape, pids.dtype)
        elif pids.dtype != self.pid.dtype:  # ids are doubles where some are null
            self.pid = self.pid.astype(np.result_type(self.pid, pids))
        best, ids = self.key[lo:lo + n], self.pid[lo:lo + n]
        least = best[:, -1]
        if nc > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.nan_to_num(np.partition(key, nc - self.k, axis=1)[:, nc - self.k], nan=np.inf,
                                                    posinf=np.inf, neginf=-np.inf))
        rows, cols = np.nonzero(key >= (least - 1e-6)[:, None])  # rounding moves a key by half of that at most
        found = np.round(key[rows, cols], 6)
        some = np.isfinite(found) & (found >= best[rows, -1])
        rows, cols, found = rows[some], cols[some], found[some]
        if not len(rows):
            return
        hit = np.unique(rows)
        at = np.searchsorted(hit, rows)
        row = np.concatenate([np.repeat(np.arange(len(hit)), self.k), at])
        key_ = np.concatenate([best[hit].ravel(), found])
        pid_ = np.concatenate([ids[hit].ravel(), pids[cols]])
        order = np.lexsort((pid_, -key_, row))
        starts = np.searchsorted(row[order], np.arange(len(hit)))
        take = order[starts[:, None] + np.arange(self.k)]
        best[hit], ids[hit] = key_[take], pid_[take]

    def tables(self, qids: np.ndarray, negated: bool = False, step: int = 4096):
        """Match rows of the queries, some queries at a time."""
        for at in range(0, len(qids) if self.pid is not None else 0, step):
            key = self.key[at:at + step]
            rows, ranks = np.nonzero(np.isfinite(key))
            score = key[rows, ranks]
            yield pa.table({"qid": pa.array(qids[at:at + step][rows].astype(np.int64)), "rank": pa.array((ranks + 1).astype(np.int32)),
                            "pid": pa.array(self.pid[at:at + step][rows, ranks].astype(np.int64)),
                            "score": pa.array(-score if negated else score)}, schema=_CAND_SCHEMA)

    def table(self, qids: np.ndarray, negated: bool = False) -> pa.Table:
        return pa.concat_tables([_CAND_SCHEMA.empty_table(), *self.tables(qids, negated)])


def _block_counts(spark, n_q: int, n_c: int, block_rows: int) -> tuple[int, int]:
    n_cb = max(1, math.ceil(n_c / block_rows))
    target = 4 * max(1, spark.sparkContext.defaultParallelism)
    n_qb = max(1, math.ceil(n_q / block_rows))
    # split queries further (no extra merge cost) until the grid fills the cluster evenly
    n_qb = max(n_qb, min(math.ceil(target / n_cb), max(1, n_q // 64)))
    return n_qb, n_cb


def _final_topk(cands: DataFrame, k: int, ascending: bool) -> DataFrame:
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy("qid").orderBy(order, F.col("pid").asc())
    return (cands.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("qid", "rank", "pid", "score"))


def packed_blocks(df: DataFrame, key: str, n: int, pack: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``pack`` of each of ``n`` hash blocks of ``df`` by ``key``: a stored row per block, in a partition of its own."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            packed = pack(pa.Table.from_batches(rows))
            yield pa.RecordBatch.from_arrays([pa.array([packed[c].tobytes()], pa.binary()) for c in names], names)

    dealt = df.withColumn("_b", bucket(key, n).cast("int")).repartitionById(n, "_b").drop("_b")
    return cut_lineage(dealt.mapInArrow(run, schema))


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of ``left`` with every one of ``right``.

    A task reads its two blocks where they are stored: no block is copied through the shuffle.
    """
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def block_columns(batches, kinds: dict[str, type]):
    """The arrays of each row of packed blocks."""
    for b in batches:
        for i in range(b.num_rows):
            yield [np.frombuffer(b.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()]


def _ids(col) -> np.ndarray:
    """Ids as integers; all null ones are the smallest."""
    return _np(col.fill_null(np.iinfo(np.int64).min)).astype(np.int64, copy=False)


BROADCAST_BYTES_KEY = "vicinity.broadcast.maxBytes"
BROADCAST_BYTES_DEFAULT = 64 << 20
SCORE_CELLS = 1 << 21          # score-matrix elements per kernel call (16 MB of doubles)
TILE_ROWS = 512                # query rows of a tile of the kNN kernel
TILE_CELLS = 1 << 19           # scores that a tile of a kernel holds at a time, so that they stay in a core's cache
STRIP_CELLS = 1 << 17          # scores of a strip of the MaxSim kernel, which stay in a core's cache as well
STRIP_COLUMNS = 256            # columns of a strip
LONG = 256                     # vectors of a passage that the MaxSim kernel takes at a time
BLOCK_BYTES = 32 << 20         # vectors of one side of a block, where both sides are large


def broadcast_limit(spark) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(BROADCAST_BYTES_DEFAULT)))


def fetch_if_small(df: DataFrame, cap: int) -> pa.Table | None:
    """The rows of ``df`` if it has at most ``cap`` of them, else None.

    ``take`` of a constant column runs on a few partitions at a time and stops at ``cap + 1`` rows, without an
    exchange, so a big input is not read to find out that it is big.  What it computed is kept while the rows are
    fetched, so a small input is computed once.
    """
    kept = df.persist()
    try:
        return kept.toArrow() if len(kept.select(F.lit(1)).take(int(cap) + 1)) <= cap else None
    finally:
        kept.unpersist()


SMALL_SIDE_ROWS = 1 << 20


def small_side(df: DataFrame, rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    For per-label and per-cell tables: Spark's own estimate of an aggregate's size grows with its input, so a table of
    ten labels would be joined by shuffling the large side on a hot key.  The table is stored first, so checking it
    and joining it don't compute it twice.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if len(stored.select(F.lit(1)).take(rows + 1)) <= rows else stored


def _spread(df: DataFrame, *key: str) -> DataFrame:
    """Give a scan-side table at least one partition per core (small inputs are one split)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def _task_per_core(df: DataFrame) -> DataFrame:
    """At most one partition per core, where every task hands on k rows for each query."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if df.rdd.getNumPartitions() > cores else df


def _knn_scores(Q, C, qids, pids, l2: bool, exclude_self: bool):
    ip = Q @ C.T
    if l2:
        score = np.round((Q * Q).sum(1)[:, None] + (C * C).sum(1)[None, :] - 2.0 * ip, 6)
        key = -score
    else:
        score = np.round(ip, 6)
        key = score.copy()
    if exclude_self:
        key[qids[:, None] == pids[None, :]] = -np.inf
    return key, score


def _block_rows(dim: int) -> int:
    """Vectors of a block: larger blocks are copied to fewer others, so less is shuffled."""
    return max(2048, BLOCK_BYTES // (8 * max(1, dim)))


def knn_tiles(top: RunningTopk, Q: np.ndarray, qids: np.ndarray, C: np.ndarray, pids: np.ndarray, l2: bool, exclude_self: bool) -> None:
    """Add the candidates ``C`` to the running top-k of ``Q``'s rows, a tile of scores at a time."""
    if not len(qids) or not len(pids):
        return
    step = max(64, TILE_CELLS // min(TILE_ROWS, len(qids)))
    norms = (Q * Q).sum(1) if l2 else None
    for c0 in range(0, len(pids), step):
        c, ids = C[c0:c0 + step], pids[c0:c0 + step]
        c_norms = (c * c).sum(1) if l2 else None
        for q0 in range(0, len(qids), TILE_ROWS):
            key = Q[q0:q0 + TILE_ROWS] @ c.T
            if l2:
                key *= 2.0
                np.subtract(norms[q0:q0 + TILE_ROWS, None] + c_norms[None, :], key, out=key)
                np.negative(key, out=key)
            if exclude_self:
                key[qids[q0:q0 + TILE_ROWS, None] == ids[None, :]] = -np.inf
            top.add(q0, key, ids)


def knn_block(qids: np.ndarray, Q: np.ndarray, pids: np.ndarray, C: np.ndarray, k: int, l2: bool, exclude_self: bool = False) -> pa.Table:
    """Top-k of a block of queries over a block of candidates."""
    top = RunningTopk(len(qids), k)
    knn_tiles(top, Q, qids, C, pids, l2, exclude_self)
    return top.table(qids, l2)


# --------------------------------------------------------------------------- kNN

def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "inner_product",
             exclude_self: bool = False, block_rows: int | None = None,
             sizes: tuple[int, int] | None = None, broadcast: bool | str | None = None) -> DataFrame:
    """Exact top-k join.  ``queries(qid, vec)``, ``corpus(pid, vec)`` -> ``(qid, rank, pid, score)``.

    ``inner_product``: score = q.c, best = largest.  ``l2_distance``: score =
    squared Euclidean distance, best = smallest.  Scores are rounded to 6
    digits (the engine-wide tie rule).  ``exclude_self`` drops ``pid = qid``
    before the cut (J8).  Queries without any candidate produce no rows; use
    :func:`with_empty_matches` to keep them.

    Plan choice (``broadcast=None``), sizes checked from row count x dimension
    against ``vicinity.broadcast.maxBytes``: a small corpus is broadcast to the
    query scan (map-only, e.g. centroid assignment); else a small query side is
    broadcast to the corpus scan (running top-k per task, one small shuffle);
    else both sides go through the bounded block grid.  ``"corpus"``, ``True``
    (queries) and ``False`` (grid) force a plan; the tests compare all three.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    spark = queries.sparkSession
    q = queries.select(F.col("qid").cast("long"), F.col("vec").cast("array<double>")).filter(F.col("vec").isNotNull())
    c = corpus.select(F.col("pid").cast("long"), F.col("vec").cast("array<double>")).filter(F.col("vec").isNotNull())
    l2 = metric == "l2_distance"
    if broadcast == "corpus":
        return _knn_broadcast_corpus(q, c, k, l2, exclude_self)
    if broadcast is True:
        return _knn_broadcast(q, c, k, l2, exclude_self)
    if broadcast is None:
        dim = q.select(F.size("vec").alias("d")).first() or c.select(F.size("vec").alias("d")).first()
        cap = broadcast_limit(spark) // max(8, (dim["d"] if dim else 1) * 8)
        if sizes is None or sizes[1] <= cap:
            tbl = fetch_if_small(c, cap)
            if tbl is not None:
                return _knn_broadcast_corpus(q, c, k, l2, exclude_self, table=tbl)
        if sizes is None or sizes[0] <= cap:
            tbl = fetch_if_small(q, cap)
            if tbl is not None:
                return _knn_broadcast(q, c, k, l2, exclude_self, table=tbl)
    n_q, n_c = sizes if sizes else (q.count(), c.count())
    if block_rows is None:
        first = q.select(F.size("vec").alias("d")).first()
        block_rows = _block_rows(first["d"] if first else 1)
    n_qb, n_cb = _block_counts(spark, n_q, n_c, block_rows)
    left = packed_blocks(q, "qid", n_qb, lambda t: {"qids": _ids(t.column("qid")), "qvecs": _matrix(t.column("vec"))}, "qids binary, qvecs binary")
    right = packed_blocks(c, "pid", n_cb, lambda t: {"pids": _ids(t.column("pid")), "cvecs": _matrix(t.column("vec"))}, "pids binary, cvecs binary")

    def score(batches):
        for qids, Q, pids, C in block_columns(batches, {"qids": np.int64, "qvecs": np.float64, "pids": np.int64, "cvecs": np.float64}):
            yield from knn_block(qids, Q.reshape(len(qids), -1), pids, C.reshape(len(pids), -1), k, l2, exclude_self).to_batches()

    cands = crossed(left, right).mapInArrow(score, MATCH_SCHEMA)
    if n_cb == 1:
        return cands.repartition("qid")  # who uses the matches twice shares this exchange
    return _final_topk(cands, k, ascending=l2)


def _knn_broadcast(q: DataFrame, c: DataFrame, k: int, l2: bool, exclude_self: bool,
                   table: pa.Table | None = None) -> DataFrame:
    """Small query side (size checked by the caller) broadcast to the corpus scan.

    The corpus is never shuffled: each task scores its own rows against all
    queries tile by tile and keeps a running top-k (queries x k numbers); only
    ``queries x tasks x k`` candidates reach the final top-k shuffle.
    """
    spark = q.sparkSession
    tbl = table if table is not None else q.toArrow()
    qids, Q = _np(tbl.column("qid")), _matrix(tbl.column("vec"))
    bc = spark.sparkContext.broadcast((qids, Q))

    def run(batches):
        qids_, Q_ = bc.value
        if len(qids_) == 0:
            return
        top = RunningTopk(len(qids_), k)
        for b in batches:
            knn_tiles(top, Q_, qids_, _matrix(b.column("vec")), _np(b.column("pid")), l2, exclude_self)
        for out in top.tables(qids_, l2):
            yield from out.to_batches()

    cands = _task_per_core(_spread(c, "pid")).mapInArrow(run, MATCH_SCHEMA)
    return _final_topk(cands, k, ascending=l2)


def _knn_broadcast_corpus(q: DataFrame, c: DataFrame, k: int, l2: bool, exclude_self: bool,
                          table: pa.Table | None = None) -> DataFrame:
    """Small corpus (size checked by the caller: centroid tables, small indexes) broadcast
    to the query scan: every query is finished inside its own task, so the whole
    join is one map stage - no shuffle at all."""
    spark = q.sparkSession
    tbl = table if table is not None else c.toArrow()
    pids, C = _np(tbl.column("pid")), _matrix(tbl.column("vec"))
    order = np.argsort(pids, kind="stable")
    bc = spark.sparkContext.broadcast((pids[order], C[order] if len(C) else C))

    def run(batches):
        pids_, C_ = bc.value
        if len(pids_) == 0:
            return
        for b in batches:
            for at in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(at, TILE_ROWS)
                out = knn_block(_np(part.column("qid")), _matrix(part.column("vec")), pids_, C_, k, l2, exclude_self)
                if out.num_rows:
                    yield from out.combine_chunks().to_batches()

    # hash the (small) match rows by query: consumers that reuse the matches in
    # several branches share this exchange instead of re-running the kernel, and
    # per-query aggregations downstream need no further shuffle
    return _spread(q, "qid").mapInArrow(run, MATCH_SCHEMA).repartition("qid")


def with_empty_matches(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Packed form ``(qid, matches ARRAY<STRUCT<pid, score>>)``; unmatched queries keep ``[]``."""
    packed = (matches.groupBy("qid")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "pid", "score"))).alias("m"))
              .select("qid", F.transform("m", lambda x: F.struct(x["pid"].alias("pid"),
                                                                x["score"].alias("score"))).alias("matches")))
    return (queries.select("qid").join(packed, "qid", "left")
            .select("qid", F.coalesce("matches", F.array().cast(
                "array<struct<pid:bigint,score:double>>")).alias("matches")))


# --------------------------------------------------------------------------- MaxSim

def _segments(ids: np.ndarray, pos: np.ndarray):
    order = np.lexsort((pos, ids))
    ids_sorted = ids[order]
    starts = np.flatnonzero(np.r_[True, ids_sorted[1:] != ids_sorted[:-1]])
    return order, ids_sorted[starts], starts


def maxsim_scores(Q: np.ndarray, q_starts: np.ndarray, D: np.ndarray, d_starts: np.ndarray) -> np.ndarray:
    """score[q, d] = sum over q's vectors of max over d's vectors of the dot product."""
    lens = np.diff(np.append(d_starts, len(D)))
    return np.concatenate([s for _, s in maxsim_tiles(query_blocks(Q, q_starts), D, lens)], axis=1).T


class QueryBlock:
    """Some queries: their distinct vectors (as columns), and which of them each vector of each query is."""

    def __init__(self, lo: int, Q: np.ndarray, starts: np.ndarray):
        # identical query vectors (repeated tokens) are scored once
        unique, inv = np.unique(Q, axis=0, return_inverse=True)
        self.lo, self.columns, self.inv, self.starts = lo, np.ascontiguousarray(unique.T), inv.reshape(-1).astype(np.int32), starts
        norms = np.sqrt((unique * unique).sum(1))
        self.largest = norms.max(initial=0.0)
        self.norms = np.add.reduceat(norms[self.inv], starts)  # sum of the lengths of each query's vectors
        self._narrow = None

    def narrow(self) -> np.ndarray:
        """The columns in single precision."""
        if self._narrow is None:
            self._narrow = self.columns.astype(np.float32)
        return self._narrow

    def scores(self, row: int, D: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores of one of the queries with the passages of ``D`` that begin at ``starts``."""
        to = self.starts[row + 1] if row + 1 < len(self.starts) else len(self.inv)
        q = self.columns[:, self.inv[self.starts[row]:to]].T
        heads = np.cumsum(lens) - lens
        V = D[np.arange(lens.sum()) + np.repeat(starts - heads, lens)].T
        total, step = np.zeros(len(lens)), max(1, SCORE_CELLS // V.shape[1])
        for at in range(0, len(q), step):
            total += np.maximum.reduceat(q[at:at + step] @ V, heads, axis=1).sum(0)
        return total


def query_blocks(Q: np.ndarray, starts: np.ndarray, vectors: int = 1 << 14) -> list[QueryBlock]:
    """Whole queries in blocks of about ``vectors`` vectors (or one query, if it has more)."""
    ends = np.append(starts[1:], len(Q))
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + vectors, side="right")))
        out.append(QueryBlock(at, Q[starts[at]:ends[to - 1]], starts[at:to] - starts[at]))
        at = to
    return out


def _pieces(lens: np.ndarray) -> int:
    """How many vectors of passages of about these lengths to lay out together: a power of two, so that little is filled up."""
    sizes = 1 << np.arange(7)
    return int(sizes[np.argmin([(-(-lens // p) * (p + 1.0)).sum() for p in sizes])])


def _strips(lens: np.ndarray, starts: np.ndarray, rows: int):
    """``(first, last, rows, passages at each place)`` for strips of about ``rows`` vectors of passages of falling length.

    A passage is filled up to whole pieces with its last vector, which changes no maximum.  The rows are the first vectors
    of all pieces, then the second ones and so on; pieces are ordered by their place in the passage.
    """
    ends = np.cumsum(lens)
    at = 0
    while at < len(lens):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - lens[at] + rows, side="right")))
        some = lens[at:to]
        piece = _pieces(some)
        counts = -(-some // piece)
        places = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # passages that have a piece at a place
        of = np.concatenate([np.arange(n) for n in places])
        first = np.repeat(np.arange(len(places)) * piece, places)
        yield at, to, (starts[at:to][of] + np.minimum(first + np.arange(piece)[:, None], some[of] - 1)).ravel(), places
        at = to


def _best_of_passages(columns: np.ndarray, D: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``[passages, columns]``: the best dot product of each passage's vectors with each column.

    Passages are sorted by length and laid out by position, so that the maximum is taken over whole rows, by halves; a strip
    of passages and columns at a time, whose scores stay in the cache.
    """
    pieces = -(-lens // LONG)  # long passages in parts, so that neither the positions nor the scores grow with the length
    cut = np.full(pieces.sum(), LONG)
    cut[np.cumsum(pieces) - 1] = lens - (pieces - 1) * LONG
    order = np.argsort(-cut, kind="stable")
    best = np.empty((len(cut), columns.shape[1]), columns.dtype)
    width = min(STRIP_COLUMNS, columns.shape[1])
    strip = np.empty(0, columns.dtype)  # used again for each strip: fresh pages cost more than the scores
    for lo, hi, rows, places in _strips(cut[order], (np.cumsum(cut) - cut)[order], STRIP_CELLS // STRIP_COLUMNS):
        V, n_pieces = D[rows], places.sum()
        if len(V) * width > len(strip):
            strip = np.empty(len(V) * width, columns.dtype)
        for c in range(0, columns.shape[1], width):
            some = columns[:, c:c + width]
            S = np.matmul(V, some, out=strip[:len(V) * some.shape[1]].reshape(len(V), -1))
            n = len(V)
            while n > n_pieces:
                n //= 2
                np.maximum(S[:n], S[n:2 * n], out=S[:n])
            top, at = S[:places[0]], places[0]
            for m in places[1:]:
                np.maximum(top[:m], S[at:at + m], out=top[:m])
                at += m
            best[order[lo:hi], c:c + width] = top
    return best if len(cut) == len(lens) else np.maximum.reduceat(best, np.cumsum(pieces) - pieces, axis=0)


def maxsim_tiles(blocks: list[QueryBlock], D: np.ndarray, lens: np.ndarray, vectors: int = 4096):
    """``(first query, [passages, queries] scores)`` of each block with passages of ``lens`` (at least 1) vectors.

    Where ``D`` has single precision, the products have it too, but not their sums.
    """
    ends = np.cumsum(lens)
    for block in blocks:
        scores = np.empty((len(lens), len(block.starts)))
        columns = block.narrow() if D.dtype == np.float32 else block.columns
        step = max(1, SCORE_CELLS // max(len(block.inv), block.columns.shape[1]))
        at = 0
        while at < len(lens):
            done = ends[at] - lens[at]
            to = min(max(at + 1, int(np.searchsorted(ends, done + vectors, side="right"))), at + step)
            best = _best_of_passages(columns, D[done:ends[to - 1]], lens[at:to])
            scores[at:to] = np.add.reduceat(best[:, block.inv], block.starts, axis=1, dtype=np.float64)
            at = to
        yield block.lo, scores


def add_maxsim(top: RunningTopk, blocks: list[QueryBlock], qids: np.ndarray, pids: np.ndarray, D: np.ndarray, lens: np.ndarray,
               exclude_self: bool = False, passages: int = 1024) -> None:
    """Add passages (``lens`` vectors of ``D`` each) to the running top-k of the blocks' queries, some passages at a time.

    Long passages, which have the best scores, come first.  All are scored in single precision; those that the error bound
    leaves a place among the best are scored again in double precision, and only these scores are kept.
    """
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")[:np.count_nonzero(lens)]
    with np.errstate(over="ignore"):
        norm = math.sqrt((D * D).sum(1).max(initial=0.0))
    most = np.max([b.largest for b in blocks], initial=0.0)
    narrow = norm < 1e15 and most < 1e15  # neither infinite nor NaN, nor beyond single precision
    at = 0
    while at < len(order):
        taken = np.cumsum(lens[order[at:at + passages]])
        some = order[at:at + max(1, int(np.searchsorted(taken, TILE_CELLS // max(1, D.shape[1]), side="right")))]
        at += len(some)
        ids, n, first = pids[some], lens[some], starts[some]
        V = D[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        single = V.astype(np.float32) if narrow else None
        for block in blocks:
            _, scores = next(maxsim_tiles([block], single if narrow else V, n))
            key, lo = scores.T, block.lo
            same = qids[lo:lo + len(key), None] == ids[None, :] if exclude_self else None
            if exclude_self:
                key = np.where(same, -np.inf, key)
            if narrow:
                # of a product of d terms, with its factors rounded: less than (d + 4) / 2^24 of the lengths
                error = (D.shape[1] + 4) * 2.0 ** -23 * norm * block.norms + 1e-9
                least = top.key[lo:lo + len(key), -1] - error
                if len(ids) > top.k and not np.isfinite(least).all():
                    least = np.maximum(least, np.partition(key, len(ids) - top.k, axis=1)[:, len(ids) - top.k] - 2 * error)
                stay = np.isfinite(key) & (key >= (least - 1e-6)[:, None])
                if not stay.any():
                    continue
                if np.count_nonzero(stay) > max(4 * top.k * len(key), stay.size // 8):
                    key = next(maxsim_tiles([block], V, n))[1].T
                    if exclude_self:
                        key = np.where(same, -np.inf, key)
                else:
                    key = np.full(key.shape, -np.inf)
                    for row in np.flatnonzero(stay.any(1)):
                        cols = np.flatnonzero(stay[row])
                        key[row, cols] = block.scores(row, D, first[cols], n[cols])
            top.add(lo, key, ids)


def pack_passages(doc_vecs: DataFrame) -> DataFrame:
    """Long ``(pid, pos, vec)`` -> ``(pid, vecs ARRAY<ARRAY<DOUBLE>>)`` in position order.
    One group per passage (bounded by the passage length)."""
    packed = doc_vecs.groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"),
                                             F.col("vec").cast("array<double>").alias("vec")))).alias("_p"))
    return packed.select("pid", F.transform("_p", lambda x: x["vec"]).alias("vecs"))


def maxsim_join(query_vecs: DataFrame, doc_vecs: DataFrame | None, k: int, exclude_self: bool = False,
                block_vectors: int | None = None, sizes: tuple[int, int] | None = None,
                broadcast: bool | None = None, packed_docs: DataFrame | None = None,
                encode: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Exact late-interaction top-k.

    ``query_vecs(qid, qpos, vec)`` and either the long ``doc_vecs(pid, pos, vec)``
    or ``packed_docs(pid, vecs)`` -> ``(qid, rank, pid, score)``.  With ``encode``
    the packed documents have other columns, from which it makes a batch of
    ``(pid, vecs)`` in the task that scores them.  With ``vocabulary(token, vec)``
    both sides are rows of ``(id, token)``, and :mod:`vicinity.operators.word_join`
    looks a token's vector up once per block.

    Plans: a query side of at most ``vicinity.broadcast.maxBytes`` is broadcast
    and the packed documents are scored where they are (no document shuffle
    when they arrive packed); otherwise both sides are packed in bounded blocks
    by passage id, so a passage never straddles blocks, and blocks are crossed.
    """
    if vocabulary is not None:
        from vicinity.operators.word_join import maxsim_words
        return maxsim_words(query_vecs, doc_vecs, vocabulary, k, exclude_self)
    spark = query_vecs.sparkSession
    q = query_vecs.select(F.col("qid").cast("long"), F.col("qpos").cast("long").alias("pos"),
                          F.col("vec").cast("array<double>")).filter(F.col("vec").isNotNull())
    if broadcast is not False:
        dim = q.select(F.size("vec").alias("d")).first()
        cap = broadcast_limit(spark) // max(8, (dim["d"] if dim else 1) * 8)
        tbl = q.toArrow() if broadcast is True else fetch_if_small(q, cap) if not sizes or sizes[0] <= cap else None
        if tbl is not None:
            docs = packed_docs if packed_docs is not None else pack_passages(doc_vecs)
            return _maxsim_broadcast(tbl, docs, k, exclude_self, encode)
    n_q = sizes[0] if sizes else q.count()
    if doc_vecs is None:
        if encode is not None:
            packed_docs = packed_docs.mapInArrow(_encoded(encode), "pid long, vecs array<array<double>>")
        doc_vecs = packed_docs.select("pid", F.posexplode("vecs").alias("pos", "vec"))
    d = doc_vecs.select(F.col("pid").cast("long"), F.col("pos").cast("long"),
                        F.col("vec").cast("array<double>")).filter(F.col("vec").isNotNull())
    n_c = sizes[1] if sizes else d.count()
    if block_vectors is None:
        first = q.select(F.size("vec").alias("d")).first()
        block_vectors = _block_rows(first["d"] if first else 1)
    n_qb, n_cb = _block_counts(spark, n_q, n_c, block_vectors)
    left = packed_blocks(q, "qid", n_qb, lambda t: _pack_passages(t, "qid", "q"), "qids binary, qlens binary, qvecs binary")
    right = packed_blocks(d, "pid", n_cb, lambda t: _pack_passages(t, "pid", "d", distinct=True), "dids binary, dlens binary, dvecs binary")
    kinds = {f"{side}{name}": kind for side in "qd" for name, kind in (("ids", np.int64), ("lens", np.int64), ("vecs", np.float64))}

    def score(batches):
        for qids, qlens, Q, pids, lens, D in block_columns(batches, kinds):
            top = RunningTopk(len(qids), k)
            add_maxsim(top, query_blocks(Q.reshape(qlens.sum(), -1), np.cumsum(qlens) - qlens), qids, pids, D.reshape(lens.sum(), -1),
                       lens, exclude_self)
            yield from top.table(qids).to_batches()

    cands = crossed(left, right).mapInArrow(score, MATCH_SCHEMA)
    if n_cb == 1:
        return cands.repartition("qid")  # who uses the matches twice shares this exchange
    return _final_topk(cands, k, ascending=False)


def _distinct_vectors(passages: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Rows that hold a vector of a passage for the first time; ``passages`` are integers of 8 bytes."""
    rows = np.concatenate([passages.view(np.float64)[:, None], vecs], axis=1)
    _, first = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True)
    return np.sort(first)


def _pack_passages(t: pa.Table, key: str, side: str, distinct: bool = False) -> dict:
    """Ids and lengths of a block's passages and their vectors, by position; ``distinct`` keeps equal ones of a passage once,
    as only the best of them counts."""
    ids, vecs = _ids(t.column(key)), _matrix(t.column("vec"))
    order, _, _ = _segments(ids, _np(t.column("pos")))
    ids, vecs = ids[order], vecs[order] + 0.0
    if distinct:
        first = _distinct_vectors(ids, vecs)
        ids, vecs = ids[first], vecs[first]
    ids, lens = np.unique(ids, return_counts=True)
    return {f"{side}ids": ids, f"{side}lens": lens.astype(np.int64), f"{side}vecs": vecs}


def _encoded(encode: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable:
    """``encode`` over the slices of batches."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield encode(b.slice(at, rows))
    return run


def _maxsim_broadcast(tbl: pa.Table, packed_docs: DataFrame, k: int, exclude_self: bool,
                      encode: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Broadcast query vectors (size checked by the caller); packed passages scored in
    chunks of bounded vector count with a running top-k per task."""
    import pyarrow.compute as pc
    spark = packed_docs.sparkSession
    qo, qids, qs = _segments(_np(tbl.column("qid")), _np(tbl.column("pos")))
    Q = _matrix(tbl.column("vec"))[qo] if tbl.num_rows else np.zeros((0, 0))
    bc = spark.sparkContext.broadcast((qids, Q, qs))

    def run(batches):
        qids_, Q_, qs_ = bc.value
        if len(qids_) == 0:
            return
        blocks = query_blocks(Q_, qs_)
        top = RunningTopk(len(qids_), k)
        for b in batches if encode is None else _encoded(encode)(batches):
            lens = pc.list_value_length(b.column("vecs")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lens)
            at = 0
            while at < b.num_rows:  # slices of bounded vectors
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + SCORE_CELLS // max(1, Q_.shape[1]), side="right")))
                part = b.slice(at, to - at)
                if ends[to - 1] > done:
                    D, row = _matrix(part.column("vecs").flatten()), np.repeat(np.arange(to - at), lens[at:to])
                    first = _distinct_vectors(row, D)
                    add_maxsim(top, blocks, qids_, _np(part.column("pid")), D[first], np.bincount(row[first], minlength=to - at), exclude_self)
                at = to
        for out in top.tables(qids_):
            yield from out.to_batches()

    docs = packed_docs
    if encode is None:
        docs = docs.select(F.col("pid").cast("long"), F.col("vecs").cast("array<array<double>>"))
    docs = _spread(docs, "pid")
    return _final_topk(_task_per_core(docs).mapInArrow(run, MATCH_SCHEMA), k, ascending=False)


def best_vectors(pairs: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    """``(qid, pid, qpos, pos, sim)``: for the pairs ``(qid, pid)`` the best document vector(s) of every query vector, ties
    kept; similarities have 6 digits.

    A pair meets as one row with the vectors of both sides (bounded by the length of two passages); only the best leave it.
    """
    def packed(vecs, key, pos, name):
        return (vecs.filter("vec is not null").groupBy(key).agg(F.collect_list(F.struct(
            F.col(pos).alias("pos"), F.col("vec").cast("array<double>").alias("vec"))).alias(name)))

    wanted = doc_vecs.join(pairs.select("pid").distinct(), "pid", "left_semi")
    rows = (pairs.select("qid", "pid").join(packed(query_vecs, "qid", "qpos", "_q"), "qid")
            .join(packed(wanted, "pid", "pos", "_d"), "pid").select("qid", "pid", "_q", "_d"))
    kinds = [(n, t.schema[n].dataType.simpleString()) for n, t in (("qid", pairs), ("pid", pairs), ("qpos", query_vecs), ("pos", doc_vecs))]
    names = [n for n, _ in kinds] + ["sim", "top"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                q, d = b.column("_q")[i].values, b.column("_d")[i].values
                Q, D = _matrix(q.field("vec")), _matrix(d.field("vec"))
                _, place = np.unique(_np(q.field("pos")), return_inverse=True)
                top = np.full(place.max() + 1, -np.inf)
                step = max(1, TILE_CELLS // len(D))
                for at in range(0, len(Q), step):
                    np.maximum.at(top, place[at:at + step], (Q[at:at + step] @ D.T).max(1))
                for at in range(0, len(Q), step):
                    S, best = Q[at:at + step] @ D.T, top[place[at:at + step]]
                    r, c = np.nonzero(S >= best[:, None] - 2e-6)  # equal ones after rounding are among these
                    same = pa.array(np.full(len(r), i))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("qid").take(same), b.column("pid").take(same), q.field("pos").take(pa.array(r + at)),
                         d.field("pos").take(pa.array(c)), pa.array(S[r, c]), pa.array(best[r])], names)

    found = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds) + ", sim double, top double")
    return found.withColumn("sim", F.round("sim", 6)).filter(F.col("sim") == F.round("top", 6)).drop("top")


def maxsim_pairs(query_vecs: DataFrame, doc_vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """MaxSim for given candidate pairs ``(qid, pid)`` (J5 stage 4, J9) in long-table form.

    Join on candidates first, then ``max`` per (qid, pid, qpos) and ``sum`` per
    (qid, pid): work is candidates x vectors, never queries x corpus.
    """
    qv = query_vecs.select("qid", "qpos", F.col("vec").alias("qvec"))
    dv = doc_vecs.select("pid", "pos", F.col("vec").alias("dvec"))
    from vicinity.functions.vectors import dot
    sims = (pairs.select("qid", "pid").join(qv, "qid").join(dv, "pid")
            .select("qid", "pid", "qpos", dot("qvec", "dvec").alias("sim")))
    return (sims.groupBy("qid", "pid", "qpos").agg(F.max("sim").alias("m"))
            .groupBy("qid", "pid").agg(F.sum("m").alias("score")))
