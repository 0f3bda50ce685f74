"""kNN and MaxSim joins against brute force; plan choices must agree."""

import numpy as np
import pytest

from vicinity.operators.similarity import knn_join, maxsim_join, with_empty_matches


def _rand(n, d, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d))


def _frame(spark, ids, M, id_col):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, M)],
                                 f"{id_col} long, vec array<double>")


def _brute(Q, C, qids, pids, k, metric="inner_product", exclude_self=False):
    out = set()
    for qi, q in zip(qids, Q):
        if metric == "inner_product":
            s = np.round(C @ q, 6)
            key = s
        else:
            s = np.round((C * C).sum(1) + q @ q - 2 * C @ q, 6)
            key = -s
        cand = [(-key[j], pids[j], s[j]) for j in range(len(pids)) if not (exclude_self and pids[j] == qi)]
        cand.sort()
        for r, (_, p, sc) in enumerate(cand[:k]):
            out.add((int(qi), r + 1, int(p), round(float(sc), 6)))
    return out


def _rows(df):
    return {(r.qid, r.rank, r.pid, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["inner_product", "l2_distance"])
@pytest.mark.parametrize("broadcast", [True, False, "corpus"])
def test_knn_matches_brute_force(spark, metric, broadcast):
    Q, C = _rand(37, 5, 1), _rand(211, 5, 2)
    qids, pids = np.arange(1000, 1037), np.arange(211) * 3
    q, c = _frame(spark, qids, Q, "qid"), _frame(spark, pids, C, "pid")
    got = _rows(knn_join(q, c, 7, metric, block_rows=50, broadcast=broadcast))
    assert got == _brute(Q, C, qids, pids, 7, metric)


def test_knn_self_exclusion_and_ties(spark):
    # duplicated corpus vectors -> equal scores, ties go to the smaller pid
    C = np.repeat(_rand(10, 4, 3), 3, axis=0)
    pids = np.arange(30)
    v = _frame(spark, pids, C, "pid")
    for plan in (False, True, "corpus"):
        got = _rows(knn_join(v.withColumnRenamed("pid", "qid"), v, 4, exclude_self=True, block_rows=8,
                             broadcast=plan))
        assert got == _brute(C, C, pids, pids, 4, exclude_self=True)
    assert all(q != p for q, _, p, _ in got)


def test_knn_fewer_candidates_than_k_and_empty_lists(spark):
    Q, C = _rand(3, 4, 5), _rand(2, 4, 6)
    q, c = _frame(spark, [1, 2, 3], Q, "qid"), _frame(spark, [7, 8], C, "pid")
    m = knn_join(q, c, 5)
    assert m.count() == 6
    packed = with_empty_matches(q.union(_frame(spark, [9], Q[:1], "qid")), m)
    sizes = {r.qid: len(r.matches) for r in packed.collect()}
    assert sizes == {1: 2, 2: 2, 3: 2, 9: 0}   # 9 was never searched: empty list kept
    empty = with_empty_matches(spark.createDataFrame([(4,)], "qid long"), m)
    assert empty.first().matches == []


def _maxsim_brute(qv, dv, k):
    out = set()
    for qid, Qm in qv.items():
        scores = []
        for pid, Dm in dv.items():
            scores.append((-round(float((Qm @ Dm.T).max(1).sum()), 6), pid))
        scores.sort()
        for r, (s, p) in enumerate(scores[:k]):
            out.add((qid, r + 1, p, -s))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_maxsim_matches_brute_force(spark, broadcast):
    rng = np.random.default_rng(7)
    qv = {i: rng.normal(size=(rng.integers(1, 5), 6)) for i in range(9)}
    # duplicate query vectors exercise the de-duplicated kernel
    qv[3] = np.vstack([qv[3], qv[3][:1]])
    dv = {100 + j: rng.normal(size=(rng.integers(1, 7), 6)) for j in range(40)}
    qdf = spark.createDataFrame([(q, p, [float(x) for x in v]) for q, M in qv.items() for p, v in enumerate(M)],
                                "qid long, qpos int, vec array<double>")
    ddf = spark.createDataFrame([(d, p, [float(x) for x in v]) for d, M in dv.items() for p, v in enumerate(M)],
                                "pid long, pos int, vec array<double>")
    got = _rows(maxsim_join(qdf, ddf, 5, block_vectors=16, broadcast=broadcast))
    assert got == _maxsim_brute(qv, dv, 5)


def test_kernel_memory_is_bounded():
    """Scores are held a tile at a time: four times the candidates take no more memory."""
    import tracemalloc
    from vicinity.operators.similarity import knn_block
    Q, peaks = _rand(512, 4, 8), []
    for n in (50_000, 200_000):
        C, pids = _rand(n, 4, 9), np.arange(n)
        tracemalloc.start()
        found = knn_block(np.arange(512), Q, pids, C, 10, True)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found.num_rows == 5120
    assert peaks[1] < 1.2 * peaks[0] < 60e6  # one matrix of 512 x 50,000 scores has 205 MB


def test_running_topk_keeps_ties_over_tiles(monkeypatch):
    """Tiles of a few rows and candidates give what one matrix gives, with equal scores and null-free ids in any order."""
    from vicinity.operators import similarity
    monkeypatch.setattr(similarity, "TILE_ROWS", 7)
    monkeypatch.setattr(similarity, "TILE_CELLS", 1)
    rng = np.random.default_rng(3)
    Q, C = np.round(_rand(40, 3, 1)), np.round(_rand(700, 3, 2))
    pids = rng.permutation(700)
    for l2, name in ((False, "inner_product"), (True, "l2_distance")):
        t = similarity.knn_block(np.arange(40), Q, pids, C, 9, l2).to_pylist()
        assert {tuple(r.values()) for r in t} == _brute(Q, C, range(40), pids, 9, name)


@pytest.mark.parametrize("long", [3, 256])
def test_long_passages_in_pieces(monkeypatch, long):
    from vicinity.operators import similarity
    monkeypatch.setattr(similarity, "LONG", long)
    rng = np.random.default_rng(4)
    ql, dl = rng.integers(1, 6, 20), rng.integers(1, 40, 30)
    Q, D = _rand(ql.sum(), 5, 5), _rand(dl.sum(), 5, 6)
    qs, ds = np.cumsum(ql) - ql, np.cumsum(dl) - dl
    want = np.add.reduceat(np.maximum.reduceat(Q @ D.T, ds, axis=1), qs, axis=0)
    assert np.allclose(similarity.maxsim_scores(Q, qs, D, ds), want)


def test_tokens_are_encoded_where_they_are_scored(spark):
    """Packed passages given as tokens: the same matches as from their vectors, and no vectors between two Python steps."""
    from pyspark.sql import functions as F
    from vicinity.operators import encode
    docs = spark.createDataFrame([(i, None if i == 3 else f"word{chr(97 + i % 7)} other{chr(97 + i % 5)} third") for i in range(30)], "pid long, text string")
    enc = encode.HashedTokenEncoder()
    q = enc.encode_queries(docs.filter("pid < 4").withColumnRenamed("pid", "qid")).select("qid", "qpos", "vec")
    want = _rows(maxsim_join(q, None, 5, packed_docs=enc.encode_packed(docs, distinct=True)))
    for broadcast in (None, False):
        found = maxsim_join(q, None, 5, packed_docs=encode.token_lists(docs, distinct=True), encode=encode.hashed_vectors_batch, broadcast=broadcast)
        assert _rows(found) == want and len(want) == 15
        if broadcast is None:
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("MapInArrow") == 1


def test_best_vectors_of_pairs(spark):
    """A row per pair between the two sides; ties of the best vector are kept."""
    from vicinity.operators.similarity import best_vectors
    qv = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0])], "qid long, qpos int, vec array<double>")
    dv = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [1.0, 0.0000000001]), (7, 2, [0.0, 0.5]), (8, 4, [2.0, 0.0]), (9, 0, None)], "pid long, pos int, vec array<double>")
    pairs = spark.createDataFrame([(1, 7), (2, 8), (2, 7)], "qid long, pid long")
    found = best_vectors(pairs, qv, dv)
    assert {tuple(r) for r in found.collect()} == {(1, 7, 0, 0, 1.0), (1, 7, 0, 1, 1.0), (1, 7, 1, 2, 0.5), (2, 8, 0, 4, 2.0),
                                                   (2, 7, 0, 0, 1.0), (2, 7, 0, 1, 1.0)}
    assert "zip_with" not in str(found._jdf.queryExecution().optimizedPlan())  # no row per pair of vectors


def test_blocks_follow_bytes(spark):
    """Blocks have 32 MB of vectors: 1.8 million query and 7.3 million document vectors of 8 dimensions are copied few times."""
    from vicinity.operators.similarity import _block_counts, _block_rows
    n_qb, n_cb = _block_counts(spark, 1_800_000, 7_300_000, _block_rows(8))
    assert n_cb <= 14 and n_qb <= 14


def test_blocks_are_stored_once(spark):
    """Where both sides are large, blocks are crossed where they are stored: no row per copy of a vector, none in a shuffle."""
    from vicinity.operators.similarity import _pack_passages
    q, c = _frame(spark, range(40), _rand(40, 4, 1), "qid"), _frame(spark, range(60), _rand(60, 4, 2), "pid")
    passages = spark.createDataFrame([(p // 3, p % 3, [float(p // 3), 1.0]) for p in range(90)], "pid long, pos int, vec array<double>")
    queries = passages.withColumnsRenamed({"pid": "qid", "pos": "qpos"})
    for found in (knn_join(q, c, 3, block_rows=10, broadcast=False), maxsim_join(queries, passages, 3, block_vectors=9, broadcast=False)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan
    packed = _pack_passages(passages.toArrow(), "pid", "d", distinct=True)  # a passage's equal vectors are kept once
    assert packed["dlens"].tolist() == [1] * 30 and len(packed["dvecs"]) == 30


def _ragged(seed, lens, dim, near=None):
    r = np.random.default_rng(seed)
    V = r.normal(size=(int(lens.sum()), dim)) if near is None else near + 1e-8 * r.normal(size=(int(lens.sum()), dim))
    return V / np.sqrt((V * V).sum(1, keepdims=True))


def _kernel_best(queries, q_lens, D, lens, qids, pids, k, exclude_self=False):
    from vicinity.operators.similarity import RunningTopk, add_maxsim, query_blocks
    top = RunningTopk(len(q_lens), k)
    for some in np.array_split(np.arange(len(lens)), 3):  # passages arrive in batches
        lo = int(lens[:some[0]].sum())
        add_maxsim(top, query_blocks(queries, np.cumsum(q_lens) - q_lens, 64), qids, pids[some],
                   D[lo:lo + int(lens[some].sum())], lens[some], exclude_self, 50)
    return [(r["qid"], r["rank"], r["pid"], r["score"]) for r in top.table(qids).to_pylist()]


def _slow_best(queries, q_lens, D, lens, qids, pids, k, exclude_self=False):
    out, at = [], np.cumsum(q_lens) - q_lens
    to = np.cumsum(lens)
    for i, qid in enumerate(qids):
        q, found = queries[at[i]:at[i] + q_lens[i]], []
        for j, pid in enumerate(pids):
            if lens[j] and not (exclude_self and pid == qid):
                found.append((-np.round((q @ D[to[j] - lens[j]:to[j]].T).max(1).sum(), 6), pid))
        out += [(qid, r + 1, pid, -s) for r, (s, pid) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("case", ["spread", "near ties", "copies", "large", "not finite"])
def test_maxsim_kernel_is_exact(case):
    """Single precision picks candidates only: near ties, copies and vectors that it can't hold have exact scores and order."""
    r = np.random.default_rng(5)
    lens, q_lens = r.integers(0, 40, 200), r.integers(1, 20, 23)
    lens[[3, 90]] = 700, 513  # beyond a part of a passage
    Q = _ragged(6, q_lens, 8)
    D = _ragged(7, lens, 8, near=Q[0] if case == "near ties" else None)
    if case == "copies":
        lens = np.full(200, 3)
        D = np.tile(_ragged(7, lens[:1], 8), (200, 1))
    if case == "large":
        Q, D = Q * 1e9, D * 1e9
    if case == "not finite":
        D[:5] = 1e200
        D[40] = np.nan
    qids, pids = np.arange(len(q_lens)) * 7, r.permutation(200)
    got = _kernel_best(Q, q_lens, D, lens, qids, pids, 4, exclude_self=True)
    if case == "not finite":  # a passage has no place with such a score
        assert len(got) == 4 * len(q_lens) and all(np.isfinite(g[3]) for g in got)
        return
    want = _slow_best(Q, q_lens, D, lens, qids, pids, 4, exclude_self=True)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=2e-6)


def test_maxsim_kernel_scores_few_pairs_in_double_precision(monkeypatch):
    """All pairs are scored in strips of single precision that stay in the cache; before, all were in double precision."""
    from vicinity.operators import similarity
    kinds, best = set(), similarity._best_of_passages

    def spy(columns, D, lens):
        kinds.update((columns.dtype, D.dtype))
        return best(columns, D, lens)

    monkeypatch.setattr(similarity, "_best_of_passages", spy)
    r = np.random.default_rng(8)
    lens, q_lens = r.integers(1, 200, 600), r.integers(1, 60, 40)
    Q, D = _ragged(9, q_lens, 8), _ragged(10, lens, 8)
    got = _kernel_best(Q, q_lens, D, lens, np.arange(40), np.arange(600), 5)
    assert kinds == {np.dtype(np.float32)}
    assert [g[:3] for g in got] == [w[:3] for w in _slow_best(Q, q_lens, D, lens, np.arange(40), np.arange(600), 5)]
