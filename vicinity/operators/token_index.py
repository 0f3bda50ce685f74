"""Trained, stored index of multi-vector passages and its pruned search.

What is stored, under one folder:

* ``model-*``: k-means centroids of the token vectors, and the residual codec (cut points, bucket means);
* ``passages``: one row per passage with two binary columns, the cell of every token and its residual code of ``nbits``
  a dimension, packed; partitioned by a hash of the id;
* ``lists``: inverted lists ``(cell, pid)``, partitioned by bands of neighbouring cells, so a search reads the probed ones;
* ``manifest``: a row per finished shard of passages with the shard's fingerprint.  A build that was cut off and is
  resumed writes the missing and changed shards only;
* ``metadata``: the row that makes the index readable, written last.

A search is four joins on ids.  The kernels between them see rows of (query, passage) with packed cells or codes, never
a row per token: one computes the scores of a query with the cells that occur, and from them both approximations of
all its candidates; the other decodes candidates by table lookup and scores them exactly.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinity.functions.hashing import bucket
from vicinity.operators.encode import vector_length
from vicinity.operators.similarity import (MATCH_SCHEMA, SCORE_CELLS, RunningTopk, _final_topk, _matrix, _np, _segments, broadcast_limit,
                                           fetch_if_small, maxsim_join, maxsim_tiles, query_blocks, small_side)
from vicinity.session import cut_lineage

BITS = (1, 2, 4, 8)
BANDS = 64                  # partitions of the inverted lists
TRAIN_SIZE = 1 << 18        # token vectors that the centroids are trained on, at most about
PER_CELL = 39               # training vectors that a cell has at least, on average
CODEC_SIZE = 1 << 15        # token vectors that the codec is trained on, at most about
SHARD_TOKENS = 1 << 22      # tokens of a shard of passages
_ROWS = 1 << 12             # candidates or query vectors of a block, where neither side is broadcast
BLOCK_SHARE = 1 / 16        # of all pairs: from here on queries and passages meet in blocks, not as pairs
_DECODED = 1 << 21          # vector components decoded at a time


# --------------------------------------------------------------------------- codes

def pack_codes(codes: np.ndarray, nbits: int) -> np.ndarray:
    """``[n, dim]`` codes -> ``[n, bytes]``; the first code is in a byte's lowest bits, the last byte is filled with 0."""
    per = 8 // nbits
    size = -(-codes.shape[1] // per)
    padded = np.zeros((len(codes), size * per), np.uint8)
    padded[:, :codes.shape[1]] = codes
    shifted = padded.reshape(len(codes), size, per) << (np.arange(per, dtype=np.uint8) * np.uint8(nbits))
    return np.bitwise_or.reduce(shifted, axis=2)


def decode_table(means: list[float], nbits: int) -> np.ndarray:
    """``[256, 8 / nbits]``: the bucket means that a byte of packed codes stands for."""
    codes = (np.arange(256)[:, None] >> (np.arange(8 // nbits) * nbits)) & ((1 << nbits) - 1)
    return np.asarray(means, np.float64)[codes]


def decode(packed: np.ndarray, rows: np.ndarray, centroids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """L2-normalised vectors from packed codes ``[n, bytes]`` and the centroid row of each."""
    v = centroids[rows] + table[packed].reshape(len(packed), -1)[:, :centroids.shape[1]]
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def _fetch_centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """``(cells ascending, matrix)``, None if they are beyond the broadcast limit."""
    c = centroids.select(F.col("cell").cast("int").alias("cell"), F.col("centroid").cast("array<double>").alias("c"))
    t = fetch_if_small(c, broadcast_limit(c.sparkSession) // max(8, vector_length(c, "c") * 8))
    if t is None:
        return None
    cells, matrix = _np(t.column("cell")), _matrix(t.column("c"))
    order = np.argsort(cells)
    return cells[order], matrix[order]


def token_codes(vectors: DataFrame, centroids: DataFrame, cuts: list[float], nbits: int) -> DataFrame:
    """``(pid, pos, cell, codes)``: each token's nearest centroid by inner product and its packed residual code; map only
    (centroids beyond the broadcast limit are joined by cell instead)."""
    from vicinity.operators.ivf import cell_map
    assigned = cell_map(vectors, centroids, 1, ["pid", "pos"]).select("pid", "pos", "cell", "vec")
    schema = (f"pid {assigned.schema['pid'].dataType.simpleString()}, pos {assigned.schema['pos'].dataType.simpleString()}, "
              "cell int, codes binary")
    limits = np.asarray(cuts, np.float64)
    fetched = _fetch_centroids(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(fetched)
    if fetched is None:
        assigned = assigned.join(centroids.select(F.col("cell").cast("int").alias("cell"), "centroid"), "cell")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                if shared.value is None:
                    near = _matrix(b.column("centroid"))
                else:
                    near = shared.value[1][np.searchsorted(shared.value[0], _np(b.column("cell")))]
                codes = np.searchsorted(limits, _matrix(b.column("vec")) - near, side="left")  # cuts strictly below
                yield pa.RecordBatch.from_arrays(
                    [b.column("pid"), b.column("pos"), b.column("cell"), _binary(pack_codes(codes, nbits))],
                    ["pid", "pos", "cell", "codes"])

    return assigned.mapInArrow(run, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


# --------------------------------------------------------------------------- build

@dataclasses.dataclass(frozen=True)
class TokenIndex:
    """A stored index: ``passages(part, pid, cells, codes)``, ``lists(band, cell, pid)``, ``centroids(cell, centroid)``."""

    passages: DataFrame
    lists: DataFrame
    centroids: DataFrame
    cuts: list[float]
    means: list[float]
    nbits: int
    dim: int
    first_cell: int
    band_width: int
    parts: int
    ntokens: int
    npassages: int
    path: str


def _rows(spark: SparkSession, path: str) -> list:
    """Rows of a small table, none if it isn't there."""
    try:
        return spark.read.parquet(path).collect()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def _part(parts: int):
    return F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int")


def _sampled(vectors: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """About ``size`` of ``n`` token vectors, chosen by a hash of their ids."""
    share = int(1_000_003 * min(1.0, size / max(n, 1))) + 1
    return vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "pid", "pos"), F.lit(1_000_003)) < share)


def train_model(vectors: DataFrame, n: int, cells: int | None = None, nbits: int = 2, iterations: int = 4, seed: int = 12345,
                train_size: int = TRAIN_SIZE, centroids: DataFrame | None = None) -> tuple[DataFrame, list[float], list[float]]:
    """``(centroids, cut points, bucket means)`` of ``n`` token vectors; centroids are trained unless given.

    k-means sees about ``train_size`` vectors and the codec about ``CODEC_SIZE``, both chosen by hash; without a number
    of cells it is the largest power of two up to 16 * sqrt(n) that leaves each ``PER_CELL`` training vectors.
    """
    from vicinity.operators import ivf
    if centroids is None:
        most = max(1, min(n, train_size) // PER_CELL)
        cells = cells or min(ivf.auto_num_cells(n), 1 << (most.bit_length() - 1))
        centroids = ivf.train_centroids(_sampled(vectors, n, train_size, seed).select("vec"), cells, iterations, seed)
    centroids = cut_lineage(centroids.select(F.col("cell").cast("int").alias("cell"),
                                             F.col("centroid").cast("array<double>").alias("centroid")))
    some = cut_lineage(_sampled(vectors, n, CODEC_SIZE, seed + 1).select("pid", "pos", "vec"))
    near = ivf.assign_cells(some, centroids, ["pid", "pos"])
    return centroids, *ivf.train_codec(some, near, centroids, nbits, ["pid", "pos"])


def parse_residual_layout(layout: str) -> tuple[int, int] | None:
    """``(cells, bits)`` of ``IVF<n>,R<bits>`` (0 cells: automatic); None for another layout."""
    found = re.fullmatch(r"IVF(\d*),R(\d+)", layout)
    if not found:
        return None
    if int(found[2]) not in BITS:
        raise ValueError(f"a residual code has {BITS} bits, not {found[2]}")
    return int(found[1] or 0), int(found[2])


def build_token_index(vectors: DataFrame, path: str, cells: int | None = None, nbits: int = 2, iterations: int = 4,
                      seed: int = 12345, train_size: int = TRAIN_SIZE, centroids: DataFrame | None = None,
                      codec: tuple[list[float], list[float]] | None = None, waves: int = 8, shard_tokens: int = SHARD_TOKENS,
                      resume: bool = False) -> TokenIndex:
    """Train, encode and store the passages of ``vectors(pid, pos, vec)``; null ids and null vectors are left out.

    Passages are dealt to shards of about ``shard_tokens`` tokens by a hash of their id and written in at most ``waves``
    jobs; each writes its shards and then their rows of the manifest.  ``resume=True`` goes on with the model of an earlier, perhaps unfinished build of the
    same settings and writes only shards whose vectors have no equal fingerprint in its manifest; ``False`` begins anew.
    ``centroids(cell, centroid)`` and ``codec`` (cut points, bucket means) are trained unless given.
    """
    if nbits not in BITS:
        raise ValueError(f"nbits must be one of {BITS}, got {nbits}")
    spark = vectors.sparkSession
    src = (vectors.select(F.col("pid").cast("long").alias("pid"), F.col("pos").cast("long").alias("pos"),
                          F.col("vec").cast("array<double>").alias("vec")).filter("pid is not null and vec is not null"))
    settings = f"cells={cells} nbits={nbits} iterations={iterations} seed={seed} train_size={train_size} given={centroids is not None}"
    earlier = [r for r in _rows(spark, f"{path}/models") if r["settings"] == settings] if resume else []
    if earlier:
        model = max(earlier, key=lambda r: r["made"])
    else:
        n = src.count()
        cents, cuts, means = (train_model(src, n, cells, nbits, iterations, seed, train_size, centroids) if codec is None
                              else (centroids, *codec))
        name = f"model-{uuid.uuid4().hex}"
        cents.select(F.col("cell").cast("int").alias("cell"), F.col("centroid").cast("array<double>").alias("centroid")) \
            .write.parquet(f"{path}/{name}")
        low, high = spark.read.parquet(f"{path}/{name}").agg(F.min("cell"), F.max("cell")).first()
        width = max(1, -(-((high or 0) - (low or 0) + 1) // BANDS))
        made = len(_rows(spark, f"{path}/models"))
        row = (name, settings, made, list(map(float, cuts)), list(map(float, means)), nbits, vector_length(src),
               low or 0, width, max(1, -(-n // shard_tokens)))
        spark.createDataFrame([row], "name string, settings string, made long, cuts array<double>, means array<double>, nbits int, "
                                     "dim int, first_cell int, band_width int, parts int") \
            .coalesce(1).write.mode("append").parquet(f"{path}/models")
        model = next(r for r in _rows(spark, f"{path}/models") if r["name"] == name)
    wanted = {r["part"]: (r["ntokens"], r["fingerprint"]) for r in src.groupBy(_part(model["parts"]).alias("part")).agg(
        F.count(F.lit(1)).alias("ntokens"), F.bit_xor(F.xxhash64("pid", "pos", "vec")).alias("fingerprint")).collect()}
    finished = {r["part"]: r for r in _rows(spark, f"{path}/manifest")
                if r["model"] == model["name"] and wanted.get(r["part"]) == (r["ntokens"], r["fingerprint"])}
    missing = sorted(set(wanted) - set(finished))
    step = max(1, -(-model["parts"] // waves))
    for at in range(0, len(missing), step):
        _write_shards(src, path, model, {p: wanted[p] for p in missing[at:at + step]})
    rows = {r["part"]: r for r in _rows(spark, f"{path}/manifest")
            if r["model"] == model["name"] and wanted.get(r["part"]) == (r["ntokens"], r["fingerprint"])}
    folders = sorted((r["part"], r["folder"]) for r in rows.values())
    spark.createDataFrame(
        [(model["name"], [f for _, f in folders], [p for p, _ in folders], sum(r["ntokens"] for r in rows.values()),
          sum(r["npassages"] for r in rows.values()))],
        "model string, folders array<string>, parts array<int>, ntokens long, npassages long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return open_token_index(spark, path)


def _write_shards(src: DataFrame, path: str, model, shards: dict[int, tuple[int, int]]) -> None:
    """Encode and store the passages of some shards, their inverted lists, and last the shards' rows of the manifest."""
    spark = src.sparkSession
    folder = uuid.uuid4().hex
    part = _part(model["parts"])
    centroids = spark.read.parquet(f"{path}/{model['name']}")
    coded = cut_lineage(token_codes(src.filter(part.isin(list(shards))), centroids, model["cuts"], model["nbits"])
                        .withColumn("part", part))
    by = ["part", "pid"]  # ranges of whole passages: the grouping below needs no further exchange
    packed = (coded.repartitionByRange(*by).groupBy(*by)
              .agg(F.array_sort(F.collect_list(F.struct("pos", "cell", "codes"))).alias("t")))

    def pack(batches):
        for b in batches:
            t = b.column("t")
            sizes = pc.list_value_length(t).to_numpy(zero_copy_only=False)
            tokens = t.flatten()
            cells = _np(tokens.field("cell")).astype("<i4").view("V4")
            codes = tokens.field("codes").to_pylist()
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("pid"),
                 pa.array([cells[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary()),
                 pa.array([b"".join(codes[e - n:e]) for e, n in zip(ends, sizes)], pa.binary())], ["part", "pid", "cells", "codes"])

    packed.mapInArrow(pack, "part int, pid long, cells binary, codes binary").write.partitionBy("part").parquet(f"{path}/passages/{folder}")
    band = F.expr(f"cast((cell - {model['first_cell']}) div {model['band_width']} as int)")
    lists = coded.select("part", "cell", "pid").distinct().withColumn("band", band)
    (lists.repartitionByRange("part", "cell", "pid").sortWithinPartitions("part", "cell", "pid")
     .write.partitionBy("part", "band").parquet(f"{path}/lists/{folder}"))
    found = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/passages/{folder}").groupBy("part")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    spark.createDataFrame([(model["name"], p, folder, n, print_, found[p]) for p, (n, print_) in shards.items()],
                          "model string, part int, folder string, ntokens long, fingerprint long, npassages long") \
        .coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def open_token_index(spark: SparkSession, path: str) -> TokenIndex:
    """The finished index stored at ``path``."""
    meta = _rows(spark, f"{path}/metadata")
    if not meta:
        raise FileNotFoundError(f"no finished token index at {path}")
    meta = meta[0]
    model = next(r for r in _rows(spark, f"{path}/models") if r["name"] == meta["model"])

    def shards(kind: str, columns: str) -> DataFrame:
        by_folder: dict[str, list[int]] = {}
        for folder, part in zip(meta["folders"], meta["parts"]):
            by_folder.setdefault(folder, []).append(part)
        out = spark.createDataFrame([], columns)
        for folder, some in by_folder.items():  # a folder per wave and resumed build
            out = out.unionByName(spark.read.parquet(f"{path}/{kind}/{folder}").filter(F.col("part").isin(some))
                                  .selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in columns.split(", "))))
        return out

    return TokenIndex(shards("passages", "part int, pid bigint, cells binary, codes binary"),
                      shards("lists", "part int, band int, cell int, pid bigint"), spark.read.parquet(f"{path}/{model['name']}"),
                      list(model["cuts"]), list(model["means"]), model["nbits"], model["dim"], model["first_cell"],
                      model["band_width"], model["parts"], meta["ntokens"], meta["npassages"], path)


def decoded_tokens(index: TokenIndex) -> DataFrame:
    """``(pid, pos, cell, vec)`` of the stored passages: codes decoded by table lookup; ``pos`` counts from 0.

    Map only; centroids beyond the broadcast limit are joined to the tokens by cell.
    """
    spark = index.passages.sparkSession
    fetched = _fetch_centroids(index.centroids)
    table, dim = decode_table(index.means, index.nbits), index.dim
    shared = spark.sparkContext.broadcast(fetched)

    def tokens(batches):
        for batch in batches:
            for b, sizes, ids, codes in _passage_slices(batch, dim):
                ends = np.cumsum(sizes)
                head = [b.column("pid").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                        pa.array(np.arange(len(ids)) - np.repeat(ends - sizes, sizes)), pa.array(ids.astype(np.int32))]
                if shared.value is None:
                    yield pa.RecordBatch.from_arrays([*head, _binary(codes)], ["pid", "pos", "cell", "codes"])
                else:
                    cells, matrix = shared.value
                    v = decode(codes, np.searchsorted(cells, ids), matrix, table)
                    yield pa.RecordBatch.from_arrays([*head, _vectors(v)], ["pid", "pos", "cell", "vec"])

    def joined(batches):
        for b in batches:
            v = decode(_flat_binary(b.column("codes"))[0].reshape(b.num_rows, -1), np.arange(b.num_rows), _matrix(b.column("centroid")), table)
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("pos"), b.column("cell"), _vectors(v)], ["pid", "pos", "cell", "vec"])

    rows = index.passages.select("pid", "cells", "codes")
    if fetched is not None:
        return rows.mapInArrow(tokens, "pid long, pos long, cell int, vec array<double>")
    return (rows.mapInArrow(tokens, "pid long, pos long, cell int, codes binary").join(index.centroids, "cell")
            .mapInArrow(joined, "pid long, pos long, cell int, vec array<double>"))


def _vectors(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(v.shape[1])), pa.array(v.ravel()))


def _flat_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes end to end, length of each)`` of a binary column without nulls."""
    lengths = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8), lengths


def _cell_ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(cells end to end, number of each)`` of a column of packed cells or of lists of cells."""
    if pa.types.is_list(col.type):
        return _np(col.flatten()).astype(np.int64), pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    data, lengths = _flat_binary(col)
    return data.view("<i4").astype(np.int64), lengths // 4


def _passage_slices(batch: pa.RecordBatch, dim: int):
    """``(rows, tokens of each, cell of each token, packed codes)`` for slices of at most ``_DECODED`` components."""
    sizes = pc.binary_length(batch.column("cells")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max(1, _DECODED // dim), side="right")))
        b = batch.slice(at, to - at)
        ids = _cell_ids(b.column("cells"))[0]
        yield b, sizes[at:to], ids, _flat_binary(b.column("codes"))[0].reshape(len(ids), -1)
        at = to


# --------------------------------------------------------------------------- search

def candidate_pairs(query_vecs: DataFrame, lists: DataFrame, centroids: DataFrame, ncells: int, exclude_self: bool = False,
                    band: tuple[int, int] | None = None, probes: DataFrame | None = None) -> DataFrame:
    """Distinct ``(qid, pid)``: passages with a token in one of the ``ncells`` best cells of one of the query's vectors
    (``probes``, if they are there already).

    With ``band`` (first cell, width) only the bands of the probed cells are read (at most ``BANDS`` numbers reach the driver).
    """
    probes = probed_cells(query_vecs, centroids, ncells) if probes is None else probes
    if band is not None:
        number = F.expr(f"cast((cell - {band[0]}) div {band[1]} as int)")
        lists = lists.filter(F.col("band").isin([r[0] for r in probes.select(number).distinct().collect()]))
    pairs = lists.select("cell", "pid").join(probes, "cell").select("qid", "pid").distinct()
    return pairs.filter("qid <> pid") if exclude_self else pairs


def probed_cells(query_vecs: DataFrame, centroids: DataFrame, ncells: int) -> DataFrame:
    """Distinct ``(qid, cell)``: the ``ncells`` best cells of each of a query's vectors."""
    from vicinity.operators.ivf import cell_map
    return small_side(cell_map(query_vecs, centroids, ncells, ["qid", "qpos"], keep=False).select("qid", "cell").distinct())


def mostly_candidates(probes: Callable[[], DataFrame], lists: DataFrame, npassages: int, cells: int, ncells: int) -> bool:
    """Whether the probed lists hold so many of all (query, passage) pairs that queries should meet passages in blocks.

    Where already the ``ncells`` shortest lists do, no probes are made: many probed cells of many queries are many rows.  At
    most ``cells`` numbers reach the driver.
    """
    sizes = cut_lineage(lists.filter("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("np")))
    shortest = sorted(r[0] for r in sizes.select("np").collect())
    if sum(shortest[:max(0, ncells - max(0, cells - len(shortest)))]) > BLOCK_SHARE * npassages:
        return True
    asked = probes().groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    pairs = asked.join(sizes, "cell").agg(F.sum(F.col("nq") * F.col("np"))).first()[0] or 0
    return pairs > BLOCK_SHARE * probes().select("qid").distinct().count() * npassages


def _first_best(key: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest keys above ``-inf``, ascending; of equal ones the first."""
    valid = np.flatnonzero(key > -np.inf)
    if len(valid) <= n:
        return valid
    some = key[valid]
    least = np.partition(some, len(some) - n)[len(some) - n]
    above = valid[some > least]
    return np.sort(np.concatenate([above, valid[some == least][:n - len(above)]]))


def _cell_sets(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(set of each passage, cells of the sets end to end, start of each set)``: passages with the same cells share a set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])))
    n = np.bincount(owner[new], minlength=len(sizes))
    data, ends = ids[new].astype("<i4").tobytes(), 4 * np.cumsum(n)
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(data[e - 4 * m:e], len(known)) for e, m in zip(ends.tolist(), n.tolist())])
    lengths = np.array([len(k) // 4 for k in known])
    return of, np.frombuffer(b"".join(known), "<i4").astype(np.int64), np.cumsum(lengths) - lengths


def search_blocks(query_vecs: DataFrame, passages: DataFrame, npassages: int, ntokens: int, centroids: tuple[np.ndarray, np.ndarray],
                  ncells: int, threshold: float, ndocs: int, skip_stage3: bool = False, exclude_self: bool = False,
                  k: int | None = None, table: np.ndarray | None = None) -> DataFrame:
    """The pairs ``(qid, pid)`` of :func:`pruned_pairs`, or with ``k`` the matches, where most pairs are candidates.

    Blocks of queries meet blocks of ``passages(pid, cells)``, and only the passages that stay leave a block; no row per
    candidate is made.  Passages with the same set of cells have the same scores up to stage 3, which are computed once
    for the set.  With ``k``, decoding ``table`` and ``codes`` beside the cells, the last stage scores all passages of the
    block; that needs them in one block.
    """
    spark = query_vecs.sparkSession
    shared = spark.sparkContext.broadcast((*centroids, table))
    q = query_vecs.select(F.col("qid").cast("long").alias("qid"), F.col("qpos").cast("long").alias("pos"),
                          F.col("vec").cast("array<double>").alias("vec")).filter("qid is not null and vec is not null")
    n_pb = passage_blocks(ntokens)
    nq = q.select("qid").distinct().count()
    # a block's queries x passages are at most 2^25, and there are blocks for all cores
    n_qb = max(1, -(-nq * max(1, npassages // n_pb) // (1 << 25)), min(2 * spark.sparkContext.defaultParallelism, nq // 16))
    left = (q.withColumn("qb", bucket("qid", n_qb))
            .withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(n_pb - 1)).cast("array<long>"))))
    right = (passages.filter("pid is not null").withColumn("pb", bucket("pid", n_pb))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)).cast("array<long>"))))
    names = ["qid", "pid", "high", "full"]
    schema = MATCH_SCHEMA if k else "qid long, pid long, high double, full double"
    empty = RunningTopk(0, 1).table(np.zeros(0, np.int64)) if k else pa.table({n: pa.array([], pa.int64() if n in ("qid", "pid") else pa.float64()) for n in names})

    def block(qt: pa.Table, pt: pa.Table) -> pa.Table:
        if not qt.num_rows or not pt.num_rows:
            return empty
        cells, matrix, decoding = shared.value
        ids, starts, vectors = _sorted_queries(qt)
        ends = np.append(starts[1:], len(vectors))
        rows = pt.take(pa.array(np.argsort(_np(pt.column("pid")), kind="stable"))).combine_chunks().to_batches()[0]
        pids = _np(rows.column("pid"))
        of, set_cells, at = _cell_sets(*_cell_ids(rows.column("cells")))
        found, column = np.unique(set_cells, return_inverse=True)
        near = matrix[np.searchsorted(cells, found)]
        stored = cells.astype(np.int64).astype(np.int32)  # as the lists have them, also where a cell is null
        place = np.minimum(np.searchsorted(found, stored), len(found) - 1)
        occurs = found[place] == stored

        def all_cells(v):
            return np.round(v @ near.T, 6)[:, column]

        def high_cells(v):
            s = np.round(v @ near.T, 6)
            return np.where(s >= threshold, s, 0.0)[:, column]

        parts, kept = [], np.zeros((len(ids), len(pids)), bool) if k else None
        for i, qid in enumerate(ids):
            v = vectors[starts[i]:ends[i]]
            scores = np.round(v @ matrix.T, 6)
            probed = np.zeros(len(cells), bool)
            for row in scores:
                probed[_first_best(row, ncells)] = True
            high = np.round(_best_sums(high_cells, v, at, len(column)), 6)
            full = np.round(_best_sums(all_cells, v, at, len(column)), 6)
            hit = np.zeros(len(found), bool)
            hit[place[probed & occurs]] = True
            high[~np.logical_or.reduceat(hit[column], at)] = -np.inf
            key = high[of]
            if exclude_self:
                key[pids == qid] = -np.inf
            stay = _first_best(key, ndocs)
            if n_pb == 1 and not skip_stage3:
                stay = stay[_first_best(full[of[stay]], max(1, ndocs // 4))]
            if k:
                kept[i, stay] = True
            else:
                parts.append((np.full(len(stay), qid), pids[stay], key[stay], full[of[stay]]))
        if not k:
            return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*parts)))))
        top, blocks, done = RunningTopk(len(ids), k), query_blocks(vectors, starts), 0
        for b, sizes, some, codes in _passage_slices(rows, matrix.shape[1]):
            decoded = decode(codes, np.searchsorted(cells, some), matrix, decoding)
            for lo, scored in maxsim_tiles(blocks, decoded, sizes):
                stays = kept[lo:lo + scored.shape[1], done:done + len(sizes)]
                top.add(lo, np.where(stays, scored.T, -np.inf), pids[done:done + len(sizes)])
            done += len(sizes)
        return top.table(ids)

    out = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(block, schema)
    if k or n_pb == 1:
        return out if k else out.select("qid", "pid")
    return _staged(out, ndocs, skip_stage3)


def passage_blocks(ntokens: int) -> int:
    return max(1, -(-ntokens // SHARD_TOKENS))


def _staged(scored: DataFrame, ndocs: int, skip_stage3: bool) -> DataFrame:
    """The best ``ndocs`` by the score of stage 2, and of these a quarter of that by the score of stage 3."""
    def keep(df, score, n):
        w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("pid"))
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

    kept = keep(scored, "high", ndocs)
    return (kept if skip_stage3 else keep(kept, "full", max(1, ndocs // 4))).select("qid", "pid")


def _by_query(rows: DataFrame, query_vecs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(rows of one query, its vectors)`` over ``rows`` (``qid``, ``pid`` ...): a record batch of ``schema``.

    Query vectors within the broadcast limit go to the rows where they are.  Beyond it, blocks of queries meet blocks of
    their rows; a block's rows are dealt out by passage, as often as the fullest block needs.
    """
    q = query_vecs.select(F.col("qid").cast("long").alias("qid"), F.col("qpos").cast("long").alias("pos"),
                          F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    names = [f.split()[0] for f in schema.split(", ")]
    empty = pa.schema([(n, pa.int64() if t == "long" else pa.float64()) for n, t in (f.split() for f in schema.split(", "))]).empty_table()

    def scored(table: pa.RecordBatch, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray):
        order = np.argsort(_np(table.column("qid")), kind="stable")
        table = table.take(pa.array(order))
        qids = _np(table.column("qid"))
        heads = np.flatnonzero(np.concatenate(([True], qids[1:] != qids[:-1]))) if len(qids) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(vectors))
        for lo, hi in zip(heads, np.append(heads[1:], len(qids))):
            i = np.searchsorted(ids, qids[lo])
            if i < len(ids) and ids[i] == qids[lo]:
                yield from kernel(table.slice(lo, hi - lo), vectors[starts[i]:ends[i]])

    cap = broadcast_limit(rows.sparkSession) // max(8, vector_length(q) * 8)
    fetched = fetch_if_small(q, cap)
    if fetched is not None:
        shared = rows.sparkSession.sparkContext.broadcast(_sorted_queries(fetched))

        def run(batches):
            for b in batches:
                for columns in scored(b, *shared.value):
                    yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(run, schema)
    nq = max(1, math.ceil(q.count() / _ROWS))
    rows = cut_lineage(rows.withColumn("qb", bucket("qid", nq)))
    most = rows.groupBy("qb").count().agg(F.max("count")).first()[0] or 1
    np_ = math.ceil(most / _ROWS)
    left = q.withColumn("qb", bucket("qid", nq)).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1)).cast("array<long>")))
    right = rows.withColumn("pb", bucket("pid", np_))

    def block(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if not qt.num_rows or not rt.num_rows:
            return empty
        parts = [pa.RecordBatch.from_arrays(c, names) for b in rt.combine_chunks().to_batches() for c in scored(b, *_sorted_queries(qt))]
        return pa.Table.from_batches(parts) if parts else empty

    return left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(block, schema)


def _sorted_queries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
    order, ids, starts = _segments(_np(table.column("qid")), _np(table.column("pos")))
    return ids, starts, _matrix(table.column("vec"))[order]


def _best_sums(scores: Callable[[np.ndarray], np.ndarray], vectors: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Sum over a query's vectors of the best score in each segment; as many vectors at a time as fit ``SCORE_CELLS``."""
    total = np.zeros(len(starts))
    step = max(1, SCORE_CELLS // max(1, width))
    for at in range(0, len(vectors), step):
        total += np.maximum.reduceat(scores(vectors[at:at + step]), starts, axis=1).sum(0)
    return total


def pruned_pairs(query_vecs: DataFrame, candidates: DataFrame, centroids: tuple[np.ndarray, np.ndarray], threshold: float,
                 ndocs: int, skip_stage3: bool = False) -> DataFrame:
    """Stages 2 and 3: ``(qid, pid)`` of the candidates ``(qid, pid, cells binary)`` that stay.

    A query's scores with the cells of its candidates are computed once.  Stage 2 sums, over the query's vectors, the
    best score among a passage's cells that reach ``threshold`` (0 if none does) and keeps ``ndocs``; stage 3 sums the best
    of all its cells and keeps a quarter of that.  Both are ranked in one exchange by query.
    """
    shared = query_vecs.sparkSession.sparkContext.broadcast(centroids)

    def kernel(rows: pa.RecordBatch, vectors: np.ndarray):
        cells, matrix = shared.value
        step = 2048
        for at in range(0, rows.num_rows, step):
            b = rows.slice(at, step)
            ids, sizes = _cell_ids(b.column("cells"))
            found, of = np.unique(ids, return_inverse=True)
            near = matrix[np.searchsorted(cells, found)]
            starts = np.cumsum(sizes) - sizes

            def all_cells(v):
                return np.round(v @ near.T, 6)[:, of]

            def high_cells(v):
                s = np.round(v @ near.T, 6)
                return np.where(s >= threshold, s, 0.0)[:, of]

            yield [b.column("qid"), b.column("pid"), pa.array(np.round(_best_sums(high_cells, vectors, starts, len(of)), 6)),
                   pa.array(np.round(_best_sums(all_cells, vectors, starts, len(of)), 6))]

    scored = _by_query(candidates, query_vecs, kernel, "qid long, pid long, high double, full double")

    return _staged(scored, ndocs, skip_stage3)


def probes_for_recall(index: TokenIndex, k: int, recall: float, sample: int = 64, seed: int = 12345) -> tuple[int, float, int]:
    """``(ncells, threshold, ndocs)`` with which the search finds about ``recall`` of the true ``k`` best passages.

    Measured with about ``sample`` stored passages (by a hash of their ids) as queries against MaxSim over all decoded
    passages, themselves left out.  From the defaults for ``k`` on, cells and candidates double and the threshold halves
    until the recall is reached or nothing is pruned.
    """
    from vicinity.operators import ivf
    share = int(1_000_003 * min(1.0, sample / max(index.npassages, 1))) + 1
    picked = dataclasses.replace(index, passages=index.passages.filter(F.pmod(F.xxhash64(F.lit(seed), "pid"), F.lit(1_000_003)) < share))
    queries = cut_lineage(decoded_tokens(picked).select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec"))
    true = cut_lineage(maxsim_join(queries, decoded_tokens(index).select("pid", "pos", "vec"), k, exclude_self=True)
                       .select("qid", "pid"))
    wanted, cells = true.count(), index.centroids.count()
    ncells, threshold, ndocs = ivf.probe_defaults(k)
    while True:
        found = search_token_index(index, queries, k, ncells, threshold, ndocs, exclude_self=True)
        if found.join(true, ["qid", "pid"], "left_semi").count() >= recall * wanted or (ncells >= cells and ndocs >= 4 * index.npassages):
            return ncells, threshold, ndocs
        ncells, threshold, ndocs = min(2 * ncells, cells), threshold / 2, 2 * ndocs


def search_token_index(index: TokenIndex, query_vecs: DataFrame, k: int, ncells: int | None = None, threshold: float | None = None,
                       ndocs: int | None = None, skip_stage3: bool = False, exclude_self: bool = False) -> DataFrame:
    """``(qid, rank, pid, score)``: pruned late-interaction search of ``query_vecs(qid, qpos, vec)``.

    ``ncells``, ``threshold`` and ``ndocs`` are those of :func:`vicinity.operators.ivf.probe_defaults` unless given.  The score is
    MaxSim on decoded vectors.  Queries without a candidate have no rows.
    """
    from vicinity.operators import ivf
    defaults = ivf.probe_defaults(k)
    ncells, threshold, ndocs = (d if x is None else x for x, d in zip((ncells, threshold, ndocs), defaults))
    fetched = _fetch_centroids(index.centroids)
    if fetched is None:  # more centroids than a broadcast holds: the stages as joins of long tables
        tokens = decoded_tokens(index)
        return ivf.plaid_search(query_vecs, tokens.select("pid", "pos", "vec"), tokens.select("pid", "pos", "cell"), index.centroids, k,
                                ncells, threshold, ndocs, skip_stage3, exclude_self)
    last = ndocs if skip_stage3 else max(1, ndocs // 4)
    if ncells >= len(fetched[0]) and last >= index.npassages:  # nothing is pruned
        return maxsim_join(query_vecs, decoded_tokens(index).select("pid", "pos", "vec"), k, exclude_self)
    table = decode_table(index.means, index.nbits)
    probes = functools.cache(lambda: probed_cells(query_vecs, index.centroids, ncells))
    if mostly_candidates(probes, index.lists, index.npassages, len(fetched[0]), ncells):
        sizes = (index.npassages, index.ntokens)
        if last > BLOCK_SHARE * index.npassages and passage_blocks(index.ntokens) == 1:
            found = search_blocks(query_vecs, index.passages.select("pid", "cells", "codes"), *sizes, fetched, ncells, threshold, ndocs,
                                  skip_stage3, exclude_self, k, table)
            return found.select("qid", "rank", "pid", "score")
        kept = search_blocks(query_vecs, index.passages.select("pid", "cells"), *sizes, fetched, ncells, threshold, ndocs, skip_stage3, exclude_self)
    else:
        pairs = small_side(candidate_pairs(query_vecs, index.lists, index.centroids, ncells, exclude_self,
                                           (index.first_cell, index.band_width), probes()))
        candidates = index.passages.select("pid", "cells").join(pairs, "pid").select("qid", "pid", "cells")
        kept = pruned_pairs(query_vecs, candidates, fetched, threshold, ndocs, skip_stage3)
    kept = small_side(kept.withColumn("part", _part(index.parts)))
    shards = [r[0] for r in kept.select("part").distinct().collect()]  # a row per shard at most: codes of the others are not read
    rows = index.passages.select("part", "pid", "cells", "codes").filter(F.col("part").isin(shards)).join(kept, ["part", "pid"]).select("qid", "pid", "cells", "codes")
    rows = rows.repartition("qid").sortWithinPartitions("qid")  # a query's rows side by side: the kernel sees them at once
    shared = query_vecs.sparkSession.sparkContext.broadcast((*fetched, table))

    def kernel(rows_: pa.RecordBatch, vectors: np.ndarray):
        cells, matrix, table = shared.value
        for b, sizes, ids, codes in _passage_slices(rows_, matrix.shape[1]):
            v = decode(codes, np.searchsorted(cells, ids), matrix, table)
            score = _best_sums(lambda some: some @ v.T, vectors, np.cumsum(sizes) - sizes, len(v))
            yield [b.column("qid"), b.column("pid"), pa.array(np.round(score, 6))]

    scored = _by_query(rows, query_vecs, kernel, "qid long, pid long, score double")
    return _final_topk(scored, k, ascending=False).select("qid", F.col("rank").cast("int").alias("rank"), "pid", "score")
