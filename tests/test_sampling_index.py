"""Sampling invariants, partition independence, IVF equalities, encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import encode, ivf, sampling
from vicinity.operators.similarity import knn_join
from vicinity.functions.vectors import with_hashed_vectors


def _passages(spark, n=300, labels=5, seed=1):
    r = np.random.default_rng(seed)
    lab = r.integers(0, labels, size=n)
    lab[-1] = labels          # a label with a single passage (no positive)
    return spark.createDataFrame([(int(i * 3 + 1), int(l)) for i, l in enumerate(lab)], "pid long, label int")


def _tuples(t):
    out = {}
    for r in t.collect():
        out.setdefault(r.anchor, {})[r.slot] = r.pid
    return out


def test_random_tuples_invariants(spark):
    p = _passages(spark)
    lab = {r.pid: r.label for r in p.collect()}
    t = _tuples(sampling.random_tuples(p, 5, seed=11))
    assert set(t) == set(lab)
    for a, slots in t.items():
        assert sorted(slots) == [0, 1, 2, 3, 4]
        assert slots[0] == a
        if sum(1 for v in lab.values() if v == lab[a]) > 1:
            assert slots[1] != a and lab[slots[1]] == lab[a]
        else:
            assert slots[1] == a                       # alone in its label
        negs = [slots[i] for i in (2, 3, 4)]
        assert len(set(negs)) == 3                     # without replacement
        assert all(lab[x] != lab[a] for x in negs)


def test_random_tuples_partition_independent(spark):
    p = _passages(spark)
    a = sorted(map(tuple, sampling.random_tuples(p.repartition(1), 4, seed=3).collect()))
    b = sorted(map(tuple, sampling.random_tuples(p.repartition(9), 4, seed=3).collect()))
    assert a == b


def test_classwise_tuples(spark):
    p = _passages(spark, labels=4).filter(F.col("label") < 4)
    lab = {r.pid: r.label for r in p.collect()}
    t = _tuples(sampling.classwise_tuples(p, 2 + 3 * 2, seed=2))
    for a, slots in t.items():
        negs = [slots[i] for i in range(2, 8)]
        per = {}
        for x in negs:
            per[lab[x]] = per.get(lab[x], 0) + 1
        assert lab[a] not in per and sorted(per.values()) == [2, 2, 2]
    with pytest.raises(ValueError):
        sampling.classwise_tuples(p, 6, seed=2)


def test_searched_candidates_fill_up_and_draw(spark):
    p = _passages(spark, n=120, labels=4, seed=4)
    lab = {r.pid: r.label for r in p.collect()}
    r = np.random.default_rng(0)
    # two matches per anchor (self first): fewer than the wanted negatives -> fill-ups
    pids = list(lab)
    rows = []
    for a in pids:
        others = r.choice([x for x in pids if x != a], size=2, replace=False)
        rows += [(a, 1, a, 1.0), (a, 2, int(others[0]), 0.8), (a, 3, int(others[1]), 0.5)]
    m = spark.createDataFrame(rows, "qid long, rank int, pid long, score double")
    c = sampling.searched_candidates(m, p, 1, 3, seed=7)
    cand = {}
    for x in c.collect():
        cand.setdefault(x.anchor, []).append(x)
    for a, cs in cand.items():
        assert all(x.pid != a for x in cs)
        assert all((lab[x.pid] == lab[a]) == (x.role == "pos") for x in cs)
        negs = [x for x in cs if x.role == "neg"]
        assert len(negs) == 3 and len({x.pid for x in negs}) == 3
        retrieved = [x.score for x in cs if not x.is_fill and x.role == "neg"]
        for x in negs:
            if x.is_fill:
                assert x.ord > 3
                assert x.score == (min(retrieved) if retrieved else 1.0)
    w = sampling.candidate_weights(c, "scores")
    for x in w.collect():
        assert 0.0 <= x.weight <= 1.0
    t = _tuples(sampling.draw_tuples(w, 4, seed=1))
    for a, slots in t.items():
        assert sorted(slots) == [0, 1, 2, 3] and len({slots[2], slots[3]}) == 2


def test_ivf_full_probe_equals_exact(spark):
    r = np.random.default_rng(5)
    C, Q = r.normal(size=(200, 6)), r.normal(size=(20, 6))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(C)], "pid long, vec array<double>")
    q = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(Q)], "qid long, vec array<double>")
    cents = ivf.train_centroids(c, num_cells=8, max_iter=3)
    index = ivf.build_ivf_index(c, cents)
    asg = {r.pid: r.cell for r in ivf.assign_cells(c, cents).collect()}
    assert {r.pid: r.cell for r in index.collect()} == asg
    full = {tuple(x) for x in ivf.ivf_search(q, index, cents, 5, ncells=8, block_rows=16).collect()}
    exact = {tuple(x) for x in knn_join(q, c, 5).collect()}
    assert full == exact
    one = ivf.ivf_search(q, index, cents, 5, ncells=1).collect()
    assert {x.pid for x in one} <= set(range(200))
    assert ivf.auto_num_cells(1600) == 512 and ivf.probe_defaults(10) == (1, 0.5, 256)
    assert ivf.probe_defaults(50) == (2, 0.45, 1024) and ivf.probe_defaults(300) == (4, 0.4, 1200)


def test_hashed_encoders_agree(spark):
    toks = ["alpha", "beta", "gamma", "été", "alpha"]
    df = spark.createDataFrame([(t,) for t in toks], "token string")
    jvm = {r.token: r.vec for r in with_hashed_vectors(df).collect()}
    py = encode.hashed_vector_np(toks)
    for t, v in zip(toks, py):
        assert np.allclose(jvm[t], v, atol=1e-12)
        assert abs(np.linalg.norm(v) - 1) < 1e-12


def test_index_sink_and_reuse(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "pid long, vec array<double>")
    path = str(tmp_path / "idx")
    _, meta = ivf.build_flat_index(v, path)
    m = meta.first()
    assert m.ntotal == 10 and m.dim == 2 and m.metric == "inner_product"
    _, again = ivf.load_or_build_index(v, path)
    assert again.first().fingerprint == m.fingerprint
    with pytest.raises(ValueError):
        ivf.build_flat_index(v, path, metric="cosine")


def test_random_tuples_multilabel(spark):
    r = np.random.default_rng(8)
    rows = [(i, sorted(set(r.integers(0, 6, size=r.integers(1, 3)).tolist()))) for i in range(80)]
    rows.append((500, [42]))                      # shares no label: positive is itself
    p = spark.createDataFrame(rows, "pid long, labels array<int>")
    lab = {i: set(l) for i, l in rows}
    t = _tuples(sampling.random_tuples_ml(p, 4, seed=5))
    assert set(t) == set(lab)
    for a, slots in t.items():
        assert slots[0] == a
        if a == 500:
            assert slots[1] == 500
        else:
            assert slots[1] != a and lab[slots[1]] & lab[a]
        negs = [v for s_, v in slots.items() if s_ >= 2]
        assert len(negs) == len(set(negs)) <= 2
        assert all(not (lab[x] & lab[a]) for x in negs)


def test_flat_index_resume_and_rebuild_from_itself(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "pid long, vec array<double>")
    path = str(tmp_path / "idx2")
    first = ivf.build_flat_index(v, path, resume=True)[1].first()
    assert ivf.build_flat_index(v, path, resume=True)[1].first() == first
    stored, _ = ivf.load_or_build_index(v, path)
    more, meta = ivf.build_flat_index(stored.union(spark.createDataFrame([(9, [9.0])], stored.schema)), path)
    assert meta.first().ntotal == 4 == more.count() and stored.count() == 3
    for part in (tmp_path / "idx2" / "metadata").glob("part-*.parquet"):
        part.write_bytes(b"no parquet")
    with pytest.raises(Exception):  # an unreadable index is not taken for a missing one
        ivf.load_or_build_index(v, path)


def test_size_check_needs_no_exchange_of_a_big_input(spark):
    from vicinity.operators.similarity import fetch_if_small
    big = spark.range(0, 2_000_000, 1, 40)
    spark.sparkContext.setJobGroup("size check", "")
    assert fetch_if_small(big, 1000) is None
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("size check")]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert sum(s.numTasks for s in stages) < 10 and len(stages) == len(jobs)
    small = fetch_if_small(spark.range(100), 100)
    assert small.num_rows == 100 and fetch_if_small(spark.range(101), 100) is None


def test_wide_ids_and_positions(spark):
    v = spark.createDataFrame([(2 ** 50, 2 ** 21, [1.0, 0.0]), (-2 ** 62, 1, [0.0, 1.0])], "pid long, pos long, vec array<double>")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, centroid array<double>")
    got = {tuple(r) for r in ivf.probe_cells(v.withColumnRenamed("pid", "qid"), cents, 1, "qid", "pos").collect()}
    assert got == {(2 ** 50, 2 ** 21, 0, 1.0), (-2 ** 62, 1, 1, 1.0)}


def test_group_mean_takes_the_length_of_its_input(spark):
    v = spark.createDataFrame([(1, [float(i) for i in range(128)]), (1, [0.0] * 128)], "pid long, vec array<double>")
    assert encode.group_mean(v, ["pid"], normalize=False).first().vec == [i / 2 for i in range(128)]
    ragged = v.union(spark.createDataFrame([(1, [0.0] * 64)], v.schema))
    with pytest.raises(Exception, match="components"):
        encode.group_mean(ragged, ["pid"]).collect()


def test_mlknn_model_save_load(spark, tmp_path):
    from vicinity.operators import mlknn
    train = spark.createDataFrame([(0, [0]), (1, [1]), (2, [0, 1])], "pid long, labels array<int>")
    m = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 0)], "qid long, rank int, pid long")
    model = mlknn.fit(train, m, k=1)
    model.save(str(tmp_path / "mlknn"))
    back = mlknn.MLKNNModel.load(spark, str(tmp_path / "mlknn"))
    assert (back.k, back.num_labels, back.num_examples) == (1, 2, 3)
    assert sorted(map(tuple, back.posterior.collect())) == sorted(map(tuple, model.posterior.collect()))


def test_cell_map_grid_fallback_equals_broadcast(spark):
    r = np.random.default_rng(9)
    V = r.normal(size=(60, 4))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(V)], "pid long, vec array<double>")
    cents = spark.createDataFrame([(j, [float(x) for x in r.normal(size=4)]) for j in range(6)],
                                  "cell int, centroid array<double>")
    a = sorted((x.pid, x.cell, x.cell_score) for x in ivf.cell_map(v, cents, 2).collect())
    spark.conf.set("vicinity.broadcast.maxBytes", "8")          # forces the grid fallback
    try:
        b = sorted((x.pid, x.cell, x.cell_score) for x in ivf.cell_map(v, cents, 2).collect())
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")
    assert a == b and len(a) == 120


def test_one_label_multilabel_rows_end_quickly(spark):
    p = spark.createDataFrame([(i, [7]) for i in range(2000)], "pid long, labels array<int>")
    t = _tuples(sampling.random_tuples_ml(p, 4, seed=2))
    assert len(t) == 2000 and all(sorted(s) == [0, 1] and s[1] != a for a, s in t.items())


def test_pool_order_does_not_depend_on_bucket_size(spark):
    p = spark.createDataFrame([(i, i % 3) for i in range(300)], "pid long, label int")
    a, _ = sampling.label_pools(p, 5)
    b, _ = sampling.label_pools(p, 5, target=10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_uniform_has_52_bits(spark, duck):
    from vicinity.functions.hashing import uniform, uniform_sql
    got = [r[0] for r in spark.range(200).select(uniform(3, "id")).collect()]
    assert got == [r[0] for r in duck.sql(f"SELECT {uniform_sql(3, 'id')} FROM range(200) t(id) ORDER BY id").fetchall()]
    assert any((x * 2 ** 32) % 1 for x in got) and all(0 <= x < 1 for x in got)
