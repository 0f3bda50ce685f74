"""ML-kNN sparse implementation against a dense numpy evaluation of the formulas."""

import numpy as np
import pytest

from vicinity.operators import mlknn


def _dense(train_labels, nn, test_nn, k, s):
    N = len(train_labels)
    L = max(max(l) for l in train_labels) + 1
    n_l = np.zeros(L)
    for ls in train_labels:
        for l in set(ls):
            n_l[l] += 1
    p1 = (s + n_l) / (2 * s + N)
    c = np.zeros((L, k + 1, 2))
    for i, ls in enumerate(train_labels):
        cnt = np.zeros(L, int)
        for j in nn[i][:k]:
            for l in set(train_labels[j]):
                cnt[l] += 1
        for l in range(L):
            c[l, cnt[l], int(l in ls)] += 1
    post1 = (s + c[..., 1]) / (s * (k + 1) + c[..., 1].sum(1, keepdims=True))
    post0 = (s + c[..., 0]) / (s * (k + 1) + c[..., 0].sum(1, keepdims=True))
    preds = {}
    for t, nbrs in test_nn.items():
        cnt = np.zeros(L, int)
        for j in nbrs[:k]:
            for l in set(train_labels[j]):
                cnt[l] += 1
        y1 = p1 * post1[np.arange(L), cnt]
        y0 = (1 - p1) * post0[np.arange(L), cnt]
        preds[t] = {l: y1[l] / (y0[l] + y1[l]) for l in range(L) if y1[l] >= y0[l]}
    return p1, post1, post0, preds


def test_mlknn_matches_dense(spark):
    rng = np.random.default_rng(3)
    N, k, s = 40, 4, 1.0
    train_labels = [sorted(set(rng.integers(0, 6, size=rng.integers(1, 3)).tolist())) for _ in range(N)]
    train_labels[0] = [0, 1, 2, 3, 4, 5, 7]          # label 6 absent from train
    nn = {i: [i] + rng.choice([j for j in range(N) if j != i], size=k - 1, replace=False).tolist() for i in range(N)}
    test_nn = {100 + t: rng.choice(N, size=rng.integers(0, k + 1), replace=False).tolist() for t in range(15)}
    train = spark.createDataFrame([(i, l) for i, l in enumerate(train_labels)], "pid long, labels array<int>")
    m_tr = spark.createDataFrame([(i, r + 1, j) for i, js in nn.items() for r, j in enumerate(js)],
                                 "qid long, rank int, pid long")
    m_te = spark.createDataFrame([(t, r + 1, j) for t, js in test_nn.items() for r, j in enumerate(js)],
                                 "qid long, rank int, pid long")
    test_ids = spark.createDataFrame([(t,) for t in test_nn], "qid long")
    model = mlknn.fit(train, m_tr, k, s)
    p1, post1, post0, preds = _dense(train_labels, nn, test_nn, k, s)
    prior = {r.label: r.p1 for r in model.prior.collect()}
    assert len(prior) == len(p1)
    for l, v in prior.items():
        assert v == pytest.approx(p1[l])
    for r in model.posterior.collect():
        assert r.post1 == pytest.approx(post1[r.label, r.j])
        assert r.post0 == pytest.approx(post0[r.label, r.j])
    got = {}
    for r in mlknn.predict_long(model, test_ids, m_te, train).collect():
        got.setdefault(r.qid, {})[r.label] = r.r
    for t, exp in preds.items():
        assert set(got.get(t, {})) == set(exp), t
        for l, v in exp.items():
            assert got[t][l] == pytest.approx(v)
    packed = {r.qid: r.preds for r in mlknn.pack_predictions(
        mlknn.predict_long(model, test_ids, m_te, train), test_ids, order="asc").collect()}
    for t, exp in preds.items():
        assert packed[t] == [l for l, _ in sorted(exp.items(), key=lambda x: (x[1], x[0]))]
