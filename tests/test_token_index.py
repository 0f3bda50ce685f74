"""Stored token index: codes, resumed builds, and searches against exact MaxSim and the long-table stages."""

import dataclasses
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import ivf
from vicinity.operators import token_index as ti
from vicinity.operators.similarity import maxsim_join
from vicinity.pipeline import ClassificationPipeline, IndexConfig, SearchConfig, build_index, search, stored_index
from vicinity.session import checkpoint_dir, cut_lineage, ship_package


@pytest.fixture(scope="module")
def vectors(spark):
    """40 passages of 1 to 6 vectors in 12 dimensions, as ``(pid, pos, vec)``."""
    ship_package(spark)
    rng = np.random.default_rng(5)
    rows = []
    for pid in range(40):
        for pos in range(pid % 6 + 1):
            v = rng.normal(size=12)
            rows.append((pid, pos, [float(x) for x in v / np.linalg.norm(v)]))
    return cut_lineage(spark.createDataFrame(rows, "pid long, pos long, vec array<double>"))


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.filter("pid % 5 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec")


def _path(spark):
    return f"{checkpoint_dir(spark)}/ti-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def index(spark, vectors):
    return ti.build_token_index(vectors, _path(spark), cells=8, nbits=4, shard_tokens=40, waves=3)


def _rows(matches):
    return sorted((r["qid"], r["rank"], r["pid"], r["score"]) for r in matches.collect())


@pytest.mark.parametrize("nbits", [1, 2, 4, 8])
def test_codes_round_trip(nbits):
    rng = np.random.default_rng(nbits)
    codes = rng.integers(0, 1 << nbits, size=(9, 13)).astype(np.uint8)
    packed = ti.pack_codes(codes, nbits)
    assert packed.shape == (9, -(-13 * nbits // 8))
    means = rng.normal(size=1 << nbits)
    cents = rng.normal(size=(3, 13))
    rows = rng.integers(0, 3, size=9)
    want = cents[rows] + means[codes]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(ti.decode(packed, rows, cents, ti.decode_table(list(means), nbits)), want, atol=1e-15)
    assert ti.pack_codes(codes[:0], nbits).shape == (0, packed.shape[1])


def test_stored_rows(spark, vectors, index):
    assert (index.ntokens, index.npassages, index.parts, index.dim) == (vectors.count(), 40, 4, 12)
    tokens = {(r["pid"], r["pos"]): r for r in ti.decoded_tokens(index).collect()}
    cents = {r["cell"]: np.array(r["centroid"]) for r in index.centroids.collect()}
    for r in vectors.collect():
        got, v = tokens.pop((r["pid"], r["pos"])), np.array(r["vec"])
        assert v @ cents[got["cell"]] >= max(v @ c for c in cents.values()) - 1e-6
        u = cents[got["cell"]] + np.array(index.means)[np.searchsorted(index.cuts, v - cents[got["cell"]])]
        assert np.allclose(got["vec"], u / np.linalg.norm(u))
    assert not tokens
    cells = {(r["cell"], r["pid"]) for r in ti.decoded_tokens(index).collect()}
    assert sorted((r["cell"], r["pid"]) for r in index.lists.collect()) == sorted(cells)


def test_unpruned_search_is_exact_on_decoded_vectors(index, queries):
    tokens = ti.decoded_tokens(index).select("pid", "pos", "vec")
    got = ti.search_token_index(index, queries, 5, ncells=8, threshold=-1.0, ndocs=400)
    assert _rows(got) == _rows(maxsim_join(queries, tokens, 5))
    alone = ti.search_token_index(index, queries, 5, ncells=8, threshold=-1.0, ndocs=400, exclude_self=True)
    assert _rows(alone) == _rows(maxsim_join(queries, tokens, 5, exclude_self=True))


@pytest.mark.parametrize("options", [dict(ncells=1, threshold=0.3, ndocs=12), dict(ncells=2, threshold=0.0, ndocs=20, skip_stage3=True), {}])
def test_plans_agree(spark, index, queries, options):
    """Broadcast kernels, blocks of queries, and joins of long tables give the same rows."""
    want = _rows(ti.search_token_index(index, queries, 3, **options))
    tokens = ti.decoded_tokens(index)
    assert want == _rows(ivf.plaid_search(queries, tokens.select("pid", "pos", "vec"), tokens.select("pid", "pos", "cell"),
                                          index.centroids, 3, **options))
    cents = 8 * 12 * 8
    for limit in (str(cents), "1"):  # room for the centroids but not the queries; for neither
        spark.conf.set("vicinity.broadcast.maxBytes", limit)
        try:
            assert want == _rows(ti.search_token_index(index, queries, 3, **options))
        finally:
            spark.conf.unset("vicinity.broadcast.maxBytes")


def test_small_blocks(spark, index, queries, monkeypatch):
    want = _rows(ti.search_token_index(index, queries, 4, ncells=3, ndocs=30))
    for name, value in (("_ROWS", 5), ("_DECODED", 20), ("SCORE_CELLS", 7)):
        monkeypatch.setattr(ti, name, value)
    spark.conf.set("vicinity.broadcast.maxBytes", str(8 * 12 * 8))
    try:
        assert want == _rows(ti.search_token_index(index, queries, 4, ncells=3, ndocs=30))
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")


def test_plan_has_a_row_per_passage_and_reads_probed_bands(index, queries):
    pairs = ti.candidate_pairs(queries.filter("qid = 0"), index.lists, index.centroids, 1, band=(index.first_cell, index.band_width))
    plan = pairs._jdf.queryExecution().explainString(pairs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "band" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pairs.columns == ["qid", "pid"]


def test_recall_of_a_measured_search(vectors, queries):
    index = build_index(vectors, IndexConfig(layout="IVF8,R8"))
    got = search(index, queries, SearchConfig(k=5, recall=0.95))
    true = maxsim_join(queries, vectors, 5).select("qid", "pid")
    assert got.join(true, ["qid", "pid"], "left_semi").count() >= 0.9 * true.count()


def test_cut_off_build_goes_on(spark, vectors, index, monkeypatch):
    path, written = _path(spark), []
    write = ti._write_shards

    def cut_off(src, path_, model, shards):
        if written:
            raise RuntimeError("lost")
        written.extend(shards)
        write(src, path_, model, shards)

    monkeypatch.setattr(ti, "_write_shards", cut_off)
    with pytest.raises(RuntimeError):
        ti.build_token_index(vectors, path, cells=8, nbits=4, shard_tokens=40, waves=2)
    with pytest.raises(FileNotFoundError):
        ti.open_token_index(spark, path)
    later = []
    monkeypatch.setattr(ti, "_write_shards", lambda s, p, m, shards: (later.extend(shards), write(s, p, m, shards)))
    done = ti.build_token_index(vectors, path, cells=8, nbits=4, shard_tokens=40, waves=2, resume=True)
    assert written and later and not set(written) & set(later) and len(written) + len(later) == done.parts
    assert sorted(map(str, done.passages.collect())) == sorted(map(str, index.passages.collect()))
    again = ti.build_token_index(vectors.filter("pid <> 3"), path, cells=8, nbits=4, shard_tokens=40, waves=2, resume=True)
    assert len(later) + len(written) == done.parts + 1 and again.npassages == 39
    assert again.passages.filter("pid = 3").isEmpty() and again.lists.filter("pid = 3").isEmpty()
    ti.build_token_index(vectors, path, cells=8, nbits=2, shard_tokens=40, waves=2, resume=True)  # other settings: another model
    assert ti.open_token_index(spark, path).nbits == 2


def test_nulls_and_empty(spark, vectors, queries):
    odd = spark.createDataFrame([(None, 0, [1.0] * 12), (99, 0, None)], "pid long, pos long, vec array<double>")
    index = ti.build_token_index(vectors.unionByName(odd), _path(spark), cells=4)
    assert index.npassages == 40
    assert ti.search_token_index(index, queries.limit(0), 5).collect() == []
    nulls = queries.limit(1).withColumn("vec", F.lit(None).cast("array<double>"))
    assert ti.search_token_index(index, nulls, 5).collect() == []


def test_configs(index):
    for wrong in (dict(layout="IVF8,R3"), dict(layout="IVF8,R4", metric="l2_distance"), dict(layout="R4")):
        with pytest.raises(ValueError):
            IndexConfig(**wrong)
    for wrong in (dict(k=0), dict(ncells=0), dict(recall=0.0), dict(ndocs=0)):
        with pytest.raises(ValueError):
            SearchConfig(**wrong)
    assert stored_index(index).config.layout == "IVF,R4" and stored_index(index).multi_vector
    with pytest.raises(ValueError):
        dataclasses.replace(IndexConfig(), layout="IVF,R16")


def test_pipeline_on_a_stored_index(spark):
    docs = spark.createDataFrame([(i, f"red apple tree {i}" if i % 2 else f"blue whale sea {i}", i % 2) for i in range(12)],
                                 "pid long, text string, label int")
    model = ClassificationPipeline("colbert", IndexConfig(layout="IVF4,R8"), SearchConfig(k=3, ncells=4, threshold=-1.0, ndocs=100))
    got = model.train_index(docs).predict(docs.select(F.col("pid"), "text")).collect()
    assert {r["qid"]: r["pred"] for r in got} == {i: i % 2 for i in range(12)}
    assert model.explain_prediction(docs.filter("pid < 2")).select("qid").distinct().count() == 2


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("options", [dict(ncells=2, threshold=0.1, ndocs=6), dict(ncells=3, threshold=0.1, ndocs=40, exclude_self=True),
                                     dict(ncells=8, threshold=0.0, ndocs=9, skip_stage3=True), dict(ncells=8, threshold=0.0, ndocs=200)])
def test_blocks_equal_pairs(index, queries, monkeypatch, options, blocks):
    """Where most pairs are candidates no row is made for a candidate; the matches are those of the pairs."""
    monkeypatch.setattr(ti, "passage_blocks", lambda n: blocks)
    monkeypatch.setattr(ti, "BLOCK_SHARE", 1e9)
    want = _rows(ti.search_token_index(index, queries, 4, **options))
    for share in (0.0, 0.3):
        monkeypatch.setattr(ti, "BLOCK_SHARE", share)
        monkeypatch.setattr(ti, "pruned_pairs", None)
        if share == 0.3:
            monkeypatch.setattr(ti, "mostly_candidates", lambda *a: True)
        assert _rows(ti.search_token_index(index, queries, 4, **options)) == want and want


def test_sets_of_cells():
    of, cells, at = ti._cell_sets(np.array([3, 1, 3, 2, 1, 3, 2, 2]), np.array([3, 1, 2, 2]))
    assert of.tolist() == [0, 1, 0, 1] and cells.tolist() == [1, 3, 2] and at.tolist() == [0, 2]


def test_blocks_with_a_null_cell(spark, vectors, queries, monkeypatch):
    cents = vectors.filter("pos = 0 and pid < 6").select(F.when(F.col("pid") > 0, F.col("pid").cast("int")).alias("cell"), F.col("vec").alias("centroid"))
    index = ti.build_token_index(vectors, _path(spark), nbits=2, centroids=cut_lineage(cents), codec=([-0.1, 0.0, 0.1], [-0.2, -0.05, 0.05, 0.2]))
    found = []
    for share in (1e9, 0.0):
        monkeypatch.setattr(ti, "BLOCK_SHARE", share)
        found.append(_rows(ti.search_token_index(index, queries, 4, ncells=1, threshold=0.1, ndocs=12)))
    assert found[0] == found[1] and found[0]


def test_many_probed_cells_make_no_rows(spark, index, queries, monkeypatch):
    """Probes carry no vectors, and where the shortest lists already hold most pairs none are made."""
    kept = ivf.cell_map(queries, index.centroids, 3, ["qid", "qpos"])
    bare = ivf.cell_map(queries, index.centroids, 3, ["qid", "qpos"], keep=False)
    assert bare.columns == ["qid", "qpos", "cell", "cell_score"]
    assert sorted(map(tuple, bare.collect())) == sorted(tuple(r)[:4] for r in kept.collect())
    want = _rows(ti.search_token_index(index, queries, 3, 8, 0.0, 24))
    made, probed = [], ti.probed_cells
    monkeypatch.setattr(ti, "probed_cells", lambda *a: made.append(a) or probed(*a))
    assert _rows(ti.search_token_index(index, queries, 3, 8, 0.0, 24)) == want and not made
    monkeypatch.setattr(ti, "BLOCK_SHARE", 8.0)  # as pairs
    assert _rows(ti.search_token_index(index, queries, 3, 8, 0.0, 24)) == want and made


def test_batches_of_probes_are_bounded(index, queries, monkeypatch):
    """A batch has so many components of vectors at most, however many cells are probed."""
    from pyspark.sql.classic.dataframe import DataFrame
    monkeypatch.setattr(ivf, "SCORE_CELLS", 100)
    seen, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *a, **k: seen.append(run) or real(self, run, *a, **k))
    ivf.cell_map(queries, index.centroids, 8, ["qid", "qpos"])
    batches = list(seen[-1](iter(queries.select("qid", "qpos", "vec").toArrow().combine_chunks().to_batches())))
    assert sum(b.num_rows for b in batches) == 8 * queries.count()
    assert max(b.num_rows for b in batches) * 12 <= 100
