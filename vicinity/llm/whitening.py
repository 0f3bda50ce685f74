"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Vectors are put on an integer grid, ``x = floor(steps * c) + offset``.  The fit list is each distinct grid vector once,
found by a shuffle of packed rows (a byte an entry for unit vectors), so copies of a vector weigh nothing and a hot
one is reduced in its tasks.  Sums over the list are exact integers; the scatter is summed in Spark from one matrix a
task, centred before it is multiplied.  Only ``dim x dim`` numbers reach the driver, whatever the number of rows.

There the covariance V becomes ``L L'`` by Cholesky with the largest remaining variance as pivot, which shows the
rank.  Rotations of pairs of L's columns make them orthogonal: their squared norms are V's eigenvalues and the
normalised columns its eigenvectors.  V itself is never diagonalised, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.session import cut_lineage

STEPS = 64
OFFSET = 1_000_000
COMPONENTS = 16
_ENTRIES = 1 << 21  # matrix entries that a kernel holds at a time
_LARGEST = 2.0 ** 61  # entries of a larger grid value don't fit the integer sums
_BLOCK = 64  # columns of a row of the scatter that are summed together
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def grid_rows(col: pa.Array, steps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, floor(steps * c) as long [rows, dim])`` of the usable vectors, by their length.

    Unusable: null, a null or non-finite entry, no entry, an entry of 2^61 or more on the grid.
    """
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    entries = pc.fill_null(col.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        grid = np.floor(entries * steps)
        bad = np.concatenate(([0], np.cumsum(~(np.abs(grid) < _LARGEST))))
    usable = (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for dim in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == dim))
        for at in range(0, len(rows), max(1, _ENTRIES // int(dim))):
            some = rows[at:at + max(1, _ENTRIES // int(dim))]
            yield some, grid[starts[some][:, None] + np.arange(dim)].astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], steps: float) -> Iterator[pa.RecordBatch]:
    """``dim, x``: each usable vector as its entries' width in bytes and the entries in the fewest bytes that hold them."""
    for batch in batches:
        for _, values in grid_rows(batch.column("vec"), steps):
            widths = np.full(len(values), 8)
            for width in (4, 2, 1):
                top = 1 << (8 * width - 1)
                widths[(values.min(1) >= -top) & (values.max(1) < top)] = width
            for width in np.unique(widths):
                some = values[widths == width].astype(f"<i{width}")
                data = np.concatenate((np.full((len(some), 1), width, np.uint8), some.view(np.uint8)), 1)
                x = pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(data), [None, pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data), values.shape[1], np.int32)), x.cast(pa.binary())], ["dim", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Grid values (without the offset) of the packed vectors, in matrices of bounded size."""
    step = max(1, _ENTRIES // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.column("x").slice(at, step).to_pylist()
            for width in (1, 2, 4, 8):
                some = [r for r in rows if r[0] == width]
                if some:
                    data = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)[:, 1:]
                    yield np.ascontiguousarray(data).view(f"<i{width}").astype(np.int64)


def _sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sums of the grid values (without the offset) by dimension; ``dim`` rows reach the driver."""
    def run(batches):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)  # of 32 bits each
        for values in _unpacked(batches, dim):
            high += (values >> 32).sum(0)
            low += (values & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low)],
                                         ["i", "high", "low"])

    total = (fit.mapInArrow(run, "i int, high long, low long").groupBy("i")
             .agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect())
    return [int(r["high"]) * (1 << 32) + int(r["low"]) for r in sorted(total, key=lambda r: r["i"])]


def _products(fit: DataFrame, dim: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``r r'`` over the rows ``r`` (of ``width`` entries) that ``rows_of`` makes of the fit list's grid values.

    A task sends one matrix, cut into pieces of at most 64 entries, and Spark sums the pieces.
    """
    block = min(width, _BLOCK)
    pieces = -(-width // block)

    def run(batches):
        total = np.zeros((width, pieces * block))
        for values in _unpacked(batches, dim):
            r = rows_of(values)
            total[:, :width] += r.T @ r
        i, piece = np.divmod(np.arange(width * pieces, dtype=np.int32), np.int32(pieces))
        flat = pa.array(total.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(piece), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, block, dtype=np.int32)), flat)],
            ["i", "piece", "values"])

    found = (fit.mapInArrow(run, "i int, piece int, values array<double>").groupBy("i", "piece")
             .agg(F.array(*(F.sum(F.col("values")[k]) for k in range(block))).alias("values")).collect())
    out = np.zeros((width, pieces * block))
    for r in found:
        out[r["i"], r["piece"] * block:(r["piece"] + 1) * block] = r["values"]
    return out[:, :width]


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factor [d, rank], pivots)`` with ``a = factor factor'``; ``factor[pivots]`` is lower triangular.

    Each step takes the dimension with the largest remaining variance.  What is left of a dimension after rounding
    (a few ulps of its variance for each step) counts as nothing, so the number of columns is the numerical rank.
    """
    left = a.diagonal().copy()
    noise = left * (8 * len(a) * np.finfo(float).eps)
    factor, pivots = np.zeros_like(a), []
    while True:
        open_ = np.where(left > noise, left, 0.0)
        p = int(np.argmax(open_)) if len(open_) else 0
        if not len(open_) or open_[p] <= 0:
            return factor[:, :len(pivots)], np.array(pivots, np.int64)
        r = len(pivots)
        column = a[:, p] - factor[:, :r] @ factor[p, :r]
        column[pivots] = 0.0
        column /= np.sqrt(left[p])
        column[p] = np.sqrt(left[p])
        factor[:, r] = column
        left -= column * column
        left[p] = 0.0
        pivots.append(p)


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: eigenvalues (falling) and unit eigenvectors (columns) of ``factor factor'``.

    Disjoint pairs of columns are rotated to right angles together, in rounds in which each column meets each other
    once, until no pair of a sweep is off by more than rounding (or, below 1e-10, gets any better).
    """
    g = np.ascontiguousarray(factor.T)
    n = len(g)
    tolerance = np.finfo(float).eps * max(factor.shape[0], 8)
    seats = np.arange(n + n % 2)
    worst = np.inf if n > 1 else 0.0
    while worst > tolerance:
        before, worst = worst, 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            real = (i < n) & (j < n)
            i, j = i[real], j[real]
            a, b = np.einsum("ij,ij->i", g[i], g[i]), np.einsum("ij,ij->i", g[j], g[j])
            c = np.einsum("ij,ij->i", g[i], g[j])
            off = np.abs(c) / np.sqrt(a) / np.sqrt(b)
            worst = max(worst, float(off.max()))
            turn = off > tolerance
            i, j, a, b, c = i[turn], j[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[i], g[j] = cos[:, None] * g[i] - sin[:, None] * g[j], sin[:, None] * g[i] + cos[:, None] * g[j]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst < 1e-10 and worst >= before:
            break
    norms = np.sqrt(np.einsum("ij,ij->i", g, g))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (g[order] / norms[order, None]).T


class Whitener:
    """Fitted model: ``dim``, ``n`` distinct vectors, exact ``sums``, ``values``, ``vectors``, ``explained``, ``identity_error``.

    ``dim`` is 0 where there is no usable vector.  ``values`` and ``vectors`` have ``min(components, rank)`` entries.
    """

    def __init__(self, steps: float, offset: int, dim: int, n: int, sums: list[int]):
        self.steps, self.offset, self.dim, self.n, self.sums = steps, offset, dim, n, sums
        self.mean = np.array([s // max(n, 1) for s in sums], np.int64)  # whole part; the rest is sums - n * mean
        self.rest = np.array([s % max(n, 1) for s in sums], np.int64)
        self.values, self.vectors, self.explained = np.zeros(0), np.zeros((dim, 0)), np.zeros(0)
        self.identity_error = 0.0

    def centred(self, grid: np.ndarray) -> np.ndarray:
        """``x - S/n`` as doubles: the whole part of the mean is taken off in integers."""
        return (grid - self.mean) - self.rest / self.n

    def deviations(self, grid: np.ndarray) -> pa.Array:
        """Exact sum over dimensions of ``(n x - S)^2``; null where it doesn't fit a long."""
        y = grid - self.mean
        largest = max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1
        if (self.n * largest) ** 2 * max(self.dim, 1) < 1 << 63:
            return pa.array(((self.n * y - self.rest) ** 2).sum(1))
        big = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in big], pa.int64())

    def whitened(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, steps: float = STEPS, offset: int = OFFSET, components: int = COMPONENTS,
        vec_col: str = "embedding") -> Whitener:
    """Learn the whitening of the usable vectors of ``vectors`` (see :func:`whiten` for the rest)."""
    src = vectors.select(F.col(vec_col).cast("array<double>").alias("vec"))
    listed = cut_lineage(src.mapInArrow(lambda batches: _packed(batches, steps), "dim int, x binary").distinct())
    top = listed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return Whitener(steps, offset, 0, 0, [])
    dim, n = top["dim"], top["n"]
    listed = listed.filter(F.col("dim") == dim).select("x")
    model = Whitener(steps, offset, dim, n, _sums(listed, dim))
    covariance = _products(listed, dim, dim, model.centred) / n
    factor, _ = pivoted_cholesky(covariance)
    values, found = one_sided_jacobi(factor)
    model.values, model.vectors = values[:components], found[:, :components]
    model.explained = model.values / covariance.trace() if len(values) else model.values
    if len(model.values):
        def with_one(grid):  # the last row of the products holds the sums
            return np.concatenate((model.whitened(grid), np.ones((len(grid), 1))), 1)
        p = _products(listed, dim, len(model.values) + 1, with_one) / n
        white = p[:-1, :-1] - np.outer(p[-1, :-1], p[-1, :-1])
        model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whiten(vectors: DataFrame, model: Whitener, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``SCHEMA``: a row for each usable vector and component, map only.

    * null vectors, and vectors with a null, NaN or infinite entry, no entry, or an entry beyond 2^61 on the grid: no row;
    * vectors of several lengths: the length with the most distinct vectors counts (the longest, if several), the others
      give no row;
    * repeated vectors and ids, null ids: a row each; a repeated vector counts once in the fit;
    * rank below the number of components (linearly dependent or constant dimensions, fewer vectors than components):
      the components with variance only, none at all if every vector is equal; an empty table gives no rows;
    * equal eigenvalues: any orthonormal components of their space, the same for all rows; other columns are not read.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for rows, grid in grid_rows(batch.column("vec"), m.steps):
                if grid.shape[1] != m.dim or not k:
                    continue
                step = max(1, _ENTRIES // (16 * k))
                for at in range(0, len(rows), step):
                    some = grid[at:at + step]
                    each = pa.array(np.repeat(np.arange(len(some)), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(rows[at:at + step])).take(each),
                         pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                         pa.array(np.full(len(some) * k, m.n)), m.deviations(some).take(each), pa.array(m.whitened(some).ravel()),
                         pa.array(np.tile(m.explained, len(some))), pa.array(np.full(len(some) * k, m.identity_error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return src.mapInArrow(run, SCHEMA)
