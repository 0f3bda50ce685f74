"""Vector indexes as ordinary tables (I1-I6, S6-S9) and probed search.

* flat index: the vectors table plus one metadata row (metric, ntotal, dim,
  fingerprint);
* inverted file: centroids ``(cell, centroid)`` trained with MLlib KMeans (or
  given), assignments ``(pid, cell)`` by arg-max inner product, residual codes;
* probing: per query vector the ``ncells`` best centroids, then an **equi-join
  on cell** brings only the corpus rows of probed cells.  Scoring runs in
  bounded ``(cell, query block, corpus block)`` groups, so a hot cell is split
  into many tasks instead of one (salting by block, sized from a per-cell
  count table).
"""

from __future__ import annotations

import functools
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.vectors import dot, l2_normalize
from vicinity.operators.encode import checked_length, vector_length
from vicinity.operators.similarity import (MATCH_SCHEMA, SCORE_CELLS, _CAND_SCHEMA, _final_topk, _knn_scores, knn_block, _matrix, _np, _segments,
                                           _spread, broadcast_limit, fetch_if_small, knn_join, maxsim_scores, small_side, topk_rows)
from vicinity.session import cut_lineage

INDEX_METRICS = ("inner_product", "l2_distance")

# ---- fixed values: k-dependent search defaults (J6) ---------------------------------
# k <= 10: 1 cell, centroid score threshold 0.5, 256 candidate documents
# k <= 100: 2 cells, threshold 0.45, 1024 documents
# larger k: 4 cells, threshold 0.4, max(4 * k, 1024) documents
PROBE_DEFAULTS = ((10, 1, 0.5, 256), (100, 2, 0.45, 1024))
PROBE_DEFAULT_LARGE = (4, 0.4, 1024)
# automatic cell count: largest power of two <= 16 * sqrt(number of vectors); 4 k-means iterations
AUTO_CELLS_FACTOR = 16
KMEANS_ITERATIONS = 4
# -------------------------------------------------------------------------------------


# --------------------------------------------------------------------------- I1 / S6-S9

def fingerprint(vectors: DataFrame) -> DataFrame:
    """Order-independent content hash: ``bit_xor(xxhash64(pid, vec))`` and ``count(*)``."""
    return vectors.agg(F.count(F.lit(1)).alias("ntotal"),
                       F.bit_xor(F.xxhash64("pid", "vec")).alias("fingerprint"))


def _stored(spark, path: str):
    """``(vectors, metadata)`` of a complete index, None if there is none; any other failure is raised."""
    try:
        meta = spark.read.parquet(f"{path}/metadata")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    row = meta.first()
    return (spark.read.parquet(f"{path}/{row['folder']}"), meta) if row else None


def _same(meta_row, source_row, metric: str) -> bool:
    return (meta_row["metric"] == metric and meta_row["ntotal"] == source_row["ntotal"]
            and meta_row["fingerprint"] == source_row["fingerprint"])


def build_flat_index(vectors: DataFrame, path: str, metric: str = "inner_product", resume: bool = False):
    """Flat exact index: vectors parquet + one metadata row (I1, S6, S7); -> ``(vectors, metadata)``.

    The vectors go into a new folder that the metadata row names, and that row is written last: readers of an older
    index (the source itself, perhaps) are not disturbed, and a build that was cut off leaves the old one valid.
    ``resume=True`` keeps a complete index of the same vectors and metric; ``False`` always builds.
    """
    if metric not in INDEX_METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {INDEX_METRICS}")
    if resume:
        return load_or_build_index(vectors, path, metric)
    v = vectors.select(F.col("pid").cast("long"), F.col("vec").cast("array<double>"))
    spark = v.sparkSession
    folder = f"vectors-{uuid.uuid4().hex}"
    v.write.parquet(f"{path}/{folder}")
    stored = spark.read.parquet(f"{path}/{folder}")
    meta = stored.agg(F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("ntotal"),
                      F.max(F.size("vec")).alias("dim"), F.bit_xor(F.xxhash64("pid", "vec")).alias("fingerprint"),
                      F.lit(folder).alias("folder"))
    meta.write.mode("overwrite").parquet(f"{path}/metadata")
    return stored, spark.read.parquet(f"{path}/metadata")


def load_or_build_index(vectors: DataFrame, path: str, metric: str = "inner_product", reuse: bool = True):
    """Reuse the stored index when its fingerprint equals the source's, else rebuild (S9; D11)."""
    stored = _stored(vectors.sparkSession, path) if reuse else None
    if stored is not None:
        source = fingerprint(vectors.select(F.col("pid").cast("long"), F.col("vec").cast("array<double>"))).first()
        if _same(stored[1].first(), source, metric):
            return stored
    return build_flat_index(vectors, path, metric)


# --------------------------------------------------------------------------- I2 / I3 / I4

def auto_num_cells(n_vectors: int, factor: int = AUTO_CELLS_FACTOR) -> int:
    """Largest power of two <= ``factor`` * sqrt(n): 16 for token vectors, 1 for passage vectors."""
    target = max(1, int(factor * math.sqrt(max(n_vectors, 1))))
    return 1 << (target.bit_length() - 1)


def parse_layout(layout: str) -> int | None:
    """Number of cells of ``IVF<n>,Flat`` (0: automatic, for ``IVF,Flat``); None for ``Flat``."""
    if layout == "Flat":
        return None
    found = re.fullmatch(r"IVF(\d*),Flat", layout)
    if not found:
        raise ValueError(f"unknown index layout {layout!r}; expected Flat or IVF<n>,Flat")
    return int(found[1] or 0)


def train_centroids(vectors: DataFrame, num_cells: int | None = None, max_iter: int = KMEANS_ITERATIONS,
                    seed: int = 12345, train_size: int | None = None, init_mode: str = "random",
                    metric: str = "inner_product", factor: int = AUTO_CELLS_FACTOR) -> DataFrame:
    """K-means centroids with MLlib (I2, I3): cosine and L2-normalised for inner product, Euclidean for L2.

    ``train_size``: about so many vectors are drawn for the training.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if train_size or not num_cells:
        n = data.count()
        num_cells = num_cells or auto_num_cells(n, factor)
        if train_size and train_size < n:
            data = data.sample(False, train_size / n, seed)
    # Lloyd iterations re-read the input: keep the (projected) training vectors cached
    data = data.persist()
    # random initial centroids (sampled vectors), as flat k-means trainers for IVF do;
    # k-means|| seeding costs more than the 4 Lloyd iterations it would precede
    l2 = metric == "l2_distance"
    model = KMeans(k=num_cells, maxIter=max_iter, seed=seed, distanceMeasure="euclidean" if l2 else "cosine",
                   initMode=init_mode, featuresCol="features").fit(data)
    data.unpersist()
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cents = spark.createDataFrame(rows, "cell int, centroid array<double>")
    return cents if l2 else cents.select("cell", l2_normalize("centroid").alias("centroid"))


def centroids_from_labels(vectors: DataFrame, dim: int, label: str = "label") -> DataFrame:
    """Per-label mean vectors as centroids (the fixed centroids of the oracle checks)."""
    mean = F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)])
    return vectors.withColumn("vec", checked_length("vec", dim)).groupBy(F.col(label).cast("int").alias("cell")).agg(mean.alias("centroid"))


def assign_cells(vectors: DataFrame, centroids: DataFrame, id_col: str | list[str] = "pid") -> DataFrame:
    """Arg-max inner product centroid per vector (I4); ``id_col`` may name several key columns."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return cell_map(vectors, centroids, 1, ids, keep=False).select(*ids, "cell", "cell_score")


def inverted_lists(assignments: DataFrame, id_col: str = "pid") -> DataFrame:
    """Distinct ``(cell, pid)`` (I6); for multi-vector passages one row per passage and cell."""
    return assignments.select("cell", id_col).distinct()


# --------------------------------------------------------------------------- I5

def residuals(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame, ids: list[str]) -> DataFrame:
    """``(ids ..., cell, residual)``: ``vec - centroid`` of the assigned cell; the cell table is broadcast if it is small."""
    j = (vectors.select(*ids, F.col("vec").cast("array<double>").alias("vec"))
         .join(assignments.select(*ids, "cell"), ids)
         .join(small_side(centroids.select("cell", "centroid")), "cell"))
    return j.select(*ids, "cell", F.zip_with("vec", "centroid", lambda a, b: a - b).alias("residual"))


def _code(cut_points: list[float]):
    cuts = F.array(*[F.lit(float(c)) for c in cut_points])
    return lambda r: F.size(F.filter(cuts, lambda c: c < r))


def residual_codes(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame,
                   cut_points: list[float], id_col: str | list[str] = "pid") -> DataFrame:
    """Residual ``vec - centroid`` coded per dimension by ``len(cut_points)+1`` buckets.

    With ``nbits`` per dimension there are ``2^nbits - 1`` cut points; code =
    number of cut points strictly below the component.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return residuals(vectors, assignments, centroids, ids).select(
        *ids, "cell", F.transform("residual", _code(cut_points)).alias("codes"))


def global_cut_points(residual: DataFrame, nbits: int = 2, rel_err: float = 1e-3) -> list[float]:
    """``2^nbits - 1`` global quantile cut points of all residual components (approximate)."""
    comps = residual.select(F.explode("residual").alias("x"))
    probs = [(i + 1) / (2 ** nbits) for i in range(2 ** nbits - 1)]
    return comps.approxQuantile("x", probs, rel_err)


def bucket_means(residual: DataFrame, cut_points: list[float]) -> list[float]:
    """Mean residual component of each bucket (0 for an empty one): what a code stands for when decoded."""
    x = residual.select(F.explode("residual").alias("x")).select(_code(cut_points)(F.col("x")).alias("code"), "x")
    means = {r[0]: r[1] for r in x.groupBy("code").agg(F.avg("x")).collect()}  # a row per bucket
    return [float(means.get(i, 0.0)) for i in range(len(cut_points) + 1)]


def train_codec(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame, nbits: int = 2,
                id_col: str | list[str] = "pid", rel_err: float = 1e-3) -> tuple[list[float], list[float]]:
    """``(cut_points, means)`` of a residual code with ``2^nbits`` buckets of about equal size."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    r = cut_lineage(residuals(vectors, assignments, centroids, ids))
    cuts = global_cut_points(r, nbits, rel_err)
    return cuts, bucket_means(r, cuts)


def residual_decode(codes: DataFrame, centroids: DataFrame, means: list[float], id_col: str | list[str] = "pid") -> DataFrame:
    """``(ids ..., vec)``: centroid plus the bucket means of the codes, L2-normalised."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    table = F.array(*[F.lit(float(m)) for m in means])
    j = codes.join(small_side(centroids.select("cell", "centroid")), "cell")
    return j.select(*ids, l2_normalize(F.zip_with("centroid", "codes", lambda c, k: c + F.element_at(table, k + 1))).alias("vec"))


# --------------------------------------------------------------------------- J4 / J6 single-vector probing

def probe_defaults(k: int) -> tuple[int, float, int]:
    """(ncells, centroid_score_threshold, ndocs) by k."""
    for max_k, ncells, threshold, ndocs in PROBE_DEFAULTS:
        if k <= max_k:
            return ncells, threshold, ndocs
    ncells, threshold, min_docs = PROBE_DEFAULT_LARGE
    return ncells, threshold, max(4 * k, min_docs)


def probe_cells(queries: DataFrame, centroids: DataFrame, ncells: int, id_col: str = "qid",
                pos_col: str | None = None) -> DataFrame:
    """Per query (vector) the ``ncells`` best centroids by inner product."""
    ids = [id_col] if pos_col is None else [id_col, pos_col]
    return cell_map(queries, centroids, ncells, ids, keep=False).select(*ids, "cell", "cell_score")


def cell_map(vectors: DataFrame, centroids: DataFrame, ncells: int, id_col: str | list[str] = "pid",
             metric: str = "inner_product", keep: bool = True) -> DataFrame:
    """The ``ncells`` best centroids of every vector, the vector passed through if it is to be kept:
    ``(ids ..., cell, cell_score, vec)``, one row per (vector, cell).  Best is the largest inner product or, for
    ``l2_distance``, the smallest squared distance.

    Map-only: the centroid table (cells x dim, bounded by the cell count and
    checked against ``vicinity.broadcast.maxBytes``) is broadcast and each task
    scores its own rows in chunks of at most ``SCORE_CELLS`` scores; ties by
    smaller cell id.  Batches that go out have at most ``SCORE_CELLS`` components
    of vectors.  Beyond the limit the centroids are searched in two levels.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    spark = vectors.sparkSession
    cents = centroids.select(F.col("cell").cast("long").alias("cell"),
                             F.col("centroid").cast("array<double>").alias("c"))
    dim = vector_length(cents, "c")
    src = vectors.select(*ids, F.col("vec").cast("array<double>")).filter(F.col("vec").isNotNull())
    ct = fetch_if_small(cents, broadcast_limit(spark) // max(8, dim * 8))
    if ct is None:
        found = _cell_tree(src, cents, ncells, ids, metric)
        return found if keep else found.drop("vec")
    cells, C = _np(ct.column("cell")), _matrix(ct.column("c"))
    bc = spark.sparkContext.broadcast((cells, C))
    types = ", ".join(f"{i} {src.schema[i].dataType.simpleString()}" for i in ids)

    def run(batches):
        cells_, C_ = bc.value
        step = max(1, SCORE_CELLS // max(1, len(cells_)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(cells_) else 0, step):
                b = whole.slice(at, step)
                key, score = _knn_scores(_matrix(b.column("vec")), C_, None, None, metric == "l2_distance", False)
                t = topk_rows(np.arange(b.num_rows), cells_, key, score, ncells)
                t, most = t.combine_chunks(), max(1, SCORE_CELLS // max(1, dim)) if keep else SCORE_CELLS
                for lo in range(0, t.num_rows, most):
                    some = t.slice(lo, most)
                    rows = pa.array(_np(some.column("qid")))
                    out = [*(b.column(i).take(rows) for i in ids), pa.array(_np(some.column("pid")).astype(np.int32)),
                           pa.array(_np(some.column("score")))]
                    if keep:
                        out.append(b.column("vec").take(rows).cast(pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(out, names)

    names = [*ids, "cell", "cell_score", *(["vec"] if keep else [])]
    return _spread(src, *ids).mapInArrow(run, f"{types}, cell int, cell_score double" + (", vec array<double>" if keep else ""))


def _cell_tree(src: DataFrame, cents: DataFrame, ncells: int, ids: list[str], metric: str) -> DataFrame:
    """:func:`cell_map` for more centroids than a broadcast holds: two levels, and still the exact best cells.

    Some centroids, as many as a broadcast holds and at most the square root of all, are the heads of groups; each
    centroid joins its nearest head, and a group's radius is its farthest member.  A vector first meets the group with
    the best bound on its scores (head's score and radius), then, by equi-joins on the group, only groups whose bound
    reaches its ``ncells``-th best score so far.  No other group can hold a better cell.
    """
    spark, l2 = src.sparkSession, metric == "l2_distance"
    keyed = cut_lineage(src.withColumn("_key", F.monotonically_increasing_id()))
    total, dim = cents.count(), max(1, vector_length(cents, "c"))
    heads = max(1, min(math.isqrt(total), broadcast_limit(spark) // (8 * dim)))
    picked = cents.orderBy(F.xxhash64("cell"), "cell").limit(heads).toArrow()  # bounded by the limit
    shared = spark.sparkContext.broadcast(_matrix(picked.column("c")))

    def join_heads(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                c, h = _matrix(b.column("c")), shared.value
                near = ((h * h).sum(1) - 2 * c @ h.T).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cell"), pa.array(near.astype(np.int32)), b.column("c").cast(pa.list_(pa.float64())),
                     pa.array(np.sqrt(((c - h[near]) ** 2).sum(1)))], ["pid", "cell", "vec", "away"])

    grouped = cut_lineage(cents.select("cell", "c").mapInArrow(join_heads, "pid long, cell int, vec array<double>, away double"))
    radius = np.full(heads, -1.0)  # -1: no member
    for r in grouped.groupBy("cell").agg(F.max("away").alias("r")).collect():  # a row per head
        radius[r["cell"]] = r["r"] * (1 + 1e-9) + 1e-9
    bounds = spark.sparkContext.broadcast((_matrix(picked.column("c")), radius))

    def meet(first: bool):
        def run(batches):
            h, r = bounds.value
            for whole in batches:
                for at in range(0, whole.num_rows, max(1, SCORE_CELLS // (4 * heads))):
                    b = whole.slice(at, max(1, SCORE_CELLS // (4 * heads)))
                    v = _matrix(b.column("vec"))
                    norm = (v * v).sum(1)[:, None]
                    if l2:  # the larger, the nearer a member can be
                        bound = -np.maximum(np.sqrt(np.maximum(norm + (h * h).sum(1) - 2 * v @ h.T, 0)) - r, 0) ** 2
                    else:
                        bound = v @ h.T + np.sqrt(norm) * r
                    bound[:, r < 0] = -np.inf
                    best = bound.argmax(1)
                    if first:
                        rows, groups = np.arange(len(v)), best
                    else:
                        least = b.column("least").to_numpy(zero_copy_only=False)
                        reach = bound >= (-least if l2 else least)[:, None] - 2e-6  # scores are rounded to 6 digits
                        reach[np.arange(len(v)), best] = False
                        reach[:, r < 0] = False
                        rows, groups = np.nonzero(reach)
                    at_rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("qid").take(at_rows), pa.array(groups.astype(np.int32)), b.column("vec").take(at_rows)], ["qid", "cell", "vec"])
        return run

    probe = "qid long, cell int, vec array<double>"
    queries = keyed.select(F.col("_key").alias("qid"), "vec")
    found = cut_lineage(_scored_blocks(cut_lineage(queries.mapInArrow(meet(True), probe)), grouped, ncells, 2048, l2))
    # the score to beat; where the first group has fewer than ncells members anything does
    worst, none = (F.max, np.inf) if l2 else (F.min, -np.inf)
    least = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= ncells, worst("score")).otherwise(F.lit(float(none))).alias("least"))
    more = queries.join(least, "qid", "left").fillna({"least": float(none)}).mapInArrow(meet(False), probe)
    best = _final_topk(found.unionByName(_scored_blocks(cut_lineage(more), grouped, ncells, 2048, l2)), ncells, ascending=l2)
    best = best.select(F.col("qid").alias("_key"), F.col("pid").cast("int").alias("cell"), F.col("score").alias("cell_score"))
    return best.join(keyed, "_key").select(*ids, "cell", "cell_score", "vec")


def build_ivf_index(vectors: DataFrame, centroids: DataFrame, metric: str = "inner_product") -> DataFrame:
    """Inverted-file index table ``(pid, cell, vec)``: each vector stored with its cell
    (I4 + I6), map-only.  Callers persist it (parquet, optionally partitioned by
    cell) or cut its lineage; searches then never join vectors back by pid."""
    return cell_map(vectors, centroids, 1, "pid", metric).select("pid", "cell", "vec")


def complete_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, ncells: int,
                    metric: str = "inner_product", block_rows: int = 2048) -> DataFrame:
    """:func:`ivf_search` that gives every query ``k`` matches (or all rows, if there are fewer).

    Queries whose probed cells hold fewer than ``k`` rows are searched again with four times the cells, and so on to
    all cells; the others' matches stand.
    """
    total = centroids.count()
    want = min(k, index.count())
    left, parts = queries.select("qid", "vec"), []
    while True:
        found = cut_lineage(ivf_search(left, index, centroids, k, ncells, block_rows, metric))
        enough = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= want).select("qid")
        if ncells >= total:
            parts.append(found)
            break
        parts.append(found.join(enough, "qid", "left_semi"))
        left = cut_lineage(left.join(enough, "qid", "left_anti"))
        if left.isEmpty():
            break
        ncells = min(ncells * 4, total)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cells_for_recall(index: DataFrame, centroids: DataFrame, k: int, recall: float, metric: str = "inner_product",
                     sample: int = 256, seed: int = 12345) -> int:
    """Number of cells to probe so that about ``recall`` of the true ``k`` neighbours lie in them.

    Measured on ``sample`` index vectors (by a hash of their ids) against the exact join: each true neighbour's cell has
    a place in its query's order of cells, and the answer is a quantile of those places, a little above ``recall``.
    """
    n, total = index.count(), centroids.count()
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("pid")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))) + 1
    q = cut_lineage(index.filter(pick).select(F.col("pid").alias("qid"), "vec"))
    exact = knn_join(q, index.select("pid", "vec"), k, metric, exclude_self=True).join(index.select("pid", "cell"), "pid")
    order = F.col("cell_score").asc() if metric == "l2_distance" else F.col("cell_score").desc()
    place = F.row_number().over(Window.partitionBy("qid").orderBy(order, "cell"))
    places = cell_map(q, centroids, total, "qid", metric, keep=False).select("qid", "cell", place.alias("place"))
    found = (exact.join(places, ["qid", "cell"])
             .agg(F.percentile_approx("place", min(1.0, recall + 0.3 * (1 - recall)), 10_000)).first()[0])
    return int(found or 1)


def ivf_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, ncells: int,
               block_rows: int = 2048, metric: str = "inner_product") -> DataFrame:
    """Inverted-file top-k (J4): probe ``ncells`` cells per query, score only the index
    rows of probed cells (equi-join on cell), exact score per cell block.

    ``index(pid, cell, vec)`` from :func:`build_ivf_index`.  A cell with many
    rows or many probing queries is split into (query block, corpus block)
    groups sized from per-cell counts (one row per cell, broadcast), so a hot
    cell is spread over many tasks.  Probing every cell equals the exact join.
    """
    probes = cut_lineage(cell_map(queries.select("qid", "vec"), centroids, ncells, "qid", metric)
                         .select("qid", "cell", "vec"))  # counted and joined
    l2 = metric == "l2_distance"
    return _final_topk(_scored_blocks(probes, index, k, block_rows, l2), k, ascending=l2)


def _scored_blocks(probes: DataFrame, index: DataFrame, k: int, block_rows: int, l2: bool) -> DataFrame:
    """Best ``k`` of each block of the rows of a probed cell, for each of ``probes(qid, cell, vec)``, which is stored.

    The number of blocks of a cell follows from the counts of both sides, a table with a row per cell.
    """
    csize = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n_c"))
    qsize = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n_q"))
    # stored, so that both sides reuse it; broadcast only if it is small
    blocks = small_side(csize.join(qsize, "cell")
                        .select("cell", F.greatest(F.ceil(F.col("n_c") / block_rows), F.lit(1)).cast("long").alias("ncb"),
                                F.greatest(F.ceil(F.col("n_q") / block_rows), F.lit(1)).cast("long").alias("nqb")))
    lq = (probes.join(blocks, "cell")
          .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")))
          .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ncb") - 1)))
          .select("cell", "qb", "cb", "qid", "vec"))
    rc = (index.select("pid", "cell", F.col("vec").cast("array<double>").alias("vec")).join(blocks, "cell")
          .withColumn("cb", F.pmod(F.xxhash64("pid"), F.col("ncb")))
          .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nqb") - 1)))
          .select("cell", "qb", "cb", "pid", "vec"))

    def score_block(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or ct.num_rows == 0:
            return _CAND_SCHEMA.empty_table()
        return knn_block(_np(qt.column("qid")), _matrix(qt.column("vec")), _np(ct.column("pid")), _matrix(ct.column("vec")), k, l2)

    return (lq.groupBy("cell", "qb", "cb").cogroup(rc.groupBy("cell", "qb", "cb"))
            .applyInArrow(score_block, MATCH_SCHEMA))


# --------------------------------------------------------------------------- J5 multi-stage (multi-vector)

def plaid_search(query_vecs: DataFrame, doc_vecs: DataFrame, doc_cells: DataFrame, centroids: DataFrame, k: int,
                 ncells: int | None = None, threshold: float | None = None, ndocs: int | None = None,
                 skip_stage3: bool = False, exclude_self: bool = False) -> DataFrame:
    """Pruned late-interaction search (J4 + J5, defaults J6) on tables of vectors.

    1. probe: per query vector the ``ncells`` best centroids; candidates =
       passages with a token in a probed cell (equi-join on cell, distinct);
    2. approximate MaxSim with centroid scores, centroids scoring below the
       threshold ignored -> keep ``ndocs`` per query;
    3. full centroid MaxSim -> keep ``ndocs / 4`` (skippable);
    4. exact MaxSim on the candidates' vectors -> top k.
    ``query_vecs(qid, qpos, vec)``, ``doc_vecs(pid, pos, vec)``, ``doc_cells(pid, pos, cell)``.

    Stages 2 and 3 run in the kernels of :mod:`vicinity.operators.token_index`: on one row per (query, passage) with the
    passage's cells as a list or, where most pairs are candidates, on blocks of queries and of passages.  Centroids beyond the broadcast limit are joined, per (query, passage, cell), instead.
    """
    from vicinity.operators import token_index
    d_nc, d_th, d_nd = probe_defaults(k)
    ncells = d_nc if ncells is None else ncells
    threshold = d_th if threshold is None else threshold
    ndocs = d_nd if ndocs is None else ndocs
    lists = cut_lineage(doc_cells.select("cell", "pid").distinct())  # read by the candidates and by the passages' cells
    probes = functools.cache(lambda: token_index.probed_cells(query_vecs, centroids, ncells))
    fetched = token_index._fetch_centroids(centroids)
    if fetched is None:
        pairs = token_index.candidate_pairs(query_vecs, lists, centroids, ncells, exclude_self, probes=probes())
        kept = _joined_stages(query_vecs, cut_lineage(pairs), lists, centroids, threshold, ndocs, skip_stage3)
    else:
        packed = lists.groupBy("pid").agg(F.collect_list("cell").alias("cells"))  # bounded by a passage's length
        sizes = lists.agg(F.countDistinct("pid"), F.count(F.lit(1))).first()
        if token_index.mostly_candidates(probes, lists, sizes[0], len(fetched[0]), ncells):
            kept = token_index.search_blocks(query_vecs, packed, sizes[0], sizes[1], fetched, ncells, threshold, ndocs, skip_stage3, exclude_self)
        else:
            pairs = token_index.candidate_pairs(query_vecs, lists, centroids, ncells, exclude_self, probes=probes())
            kept = token_index.pruned_pairs(query_vecs, packed.join(small_side(pairs), "pid").select("qid", "pid", "cells"),
                                            fetched, threshold, ndocs, skip_stage3)
    return exact_maxsim_pairs(query_vecs, doc_vecs, cut_lineage(kept), k)


def _joined_stages(query_vecs: DataFrame, cands: DataFrame, dcell: DataFrame, centroids: DataFrame, threshold: float,
                   ndocs: int, skip_stage3: bool) -> DataFrame:
    """Stages 2 and 3 of :func:`plaid_search` as joins of long tables, whatever the number of centroids."""
    # centroid scores of a query's vectors, for the cells of its candidates only; both approximations from one join
    qc = (cands.join(dcell, "pid").select("qid", "cell").distinct()
          .join(query_vecs.select("qid", "qpos", F.col("vec").cast("array<double>").alias("vec")), "qid")
          .join(centroids.select("cell", "centroid"), "cell")
          .select("qid", "qpos", "cell", F.round(dot("vec", "centroid"), 6).alias("cs")))
    high = F.when(F.col("cs") >= threshold, F.col("cs")).otherwise(F.lit(0.0))
    per = (cands.join(dcell, "pid").join(qc, ["qid", "cell"]).groupBy("qid", "pid", "qpos")
           .agg(F.max(high).alias("high"), F.max("cs").alias("full")))
    scored = per.groupBy("qid", "pid").agg(F.sum("high").alias("high"), F.sum("full").alias("full"))

    def keep_top(df, score, n):
        w = Window.partitionBy("qid").orderBy(F.round(score, 6).desc(), F.col("pid"))
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

    kept = keep_top(scored, "high", ndocs)
    return (kept if skip_stage3 else keep_top(kept, "full", max(1, ndocs // 4))).select("qid", "pid")


def exact_maxsim_pairs(query_vecs: DataFrame, doc_vecs: DataFrame, pairs: DataFrame, k: int,
                       block_pairs: int = 512) -> DataFrame:
    """Exact MaxSim for candidate pairs, top k per query (J5 stage 4).

    Pairs are grouped by query and cut into bounded blocks; each block
    cogroups the query's vectors with the candidate passages' vectors.
    """
    # candidates per query are bounded (ndocs / 4): cut them into blocks of block_pairs
    pb = pairs.withColumn("blk", F.floor(F.row_number().over(Window.partitionBy("qid").orderBy("pid")) / block_pairs))
    qv = query_vecs.select("qid", F.col("qpos").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    left = pb.select("qid", "blk").distinct().join(qv, "qid")
    right = (pb.select(F.col("qid").alias("rq"), F.col("blk").alias("rb"), "pid")
             .join(doc_vecs.select("pid", "pos", F.col("vec").cast("array<double>").alias("vec")), "pid"))

    def score_block(qt: pa.Table, dt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or dt.num_rows == 0:
            return _CAND_SCHEMA.empty_table()
        qo, qids, qs = _segments(_np(qt.column("qid")), _np(qt.column("pos")))
        do, pids, ds = _segments(_np(dt.column("pid")), _np(dt.column("pos")))
        Q = _matrix(qt.column("vec"))[qo]
        D = _matrix(dt.column("vec"))[do]
        score = np.round(maxsim_scores(Q, qs, D, ds), 6)
        return topk_rows(qids, pids, score.copy(), score, k)

    cands = left.groupBy("qid", "blk").cogroup(right.groupBy("rq", "rb")).applyInArrow(score_block, MATCH_SCHEMA)
    return _final_topk(cands, k, ascending=False)
