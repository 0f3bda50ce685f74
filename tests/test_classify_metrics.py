"""Vote, multi-class / multi-label metrics, ARI and losses on hand-computed tables."""

import math

import numpy as np
import pytest

from vicinity.operators import classify, metrics


def _m(spark, rows):
    return spark.createDataFrame(rows, "qid long, rank int, pid long")


def test_vote_ties_missing_and_empty(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 2)], "pid long, label int")
    matches = _m(spark, [
        (10, 1, 1), (10, 2, 2), (10, 3, 3), (10, 4, 4),     # 0:2, 1:2 -> tie -> 0
        (11, 1, 5),                                         # 2:1, missing -1: 3 -> -1 wins (D7)
        (12, 1, 2), (12, 2, 99),                            # pid 99 has no label -> votes -1
    ])
    queries = spark.createDataFrame([(10,), (11,), (12,), (13,)], "qid long")   # 13: no matches
    got = {(r.k, r.qid): r.pred for r in classify.knn_vote(matches, labels, queries, [1, 4]).collect()}
    assert got[(4, 10)] == 0
    assert got[(1, 10)] == 0
    assert got[(4, 11)] == -1 and got[(1, 11)] == 2
    assert got[(1, 12)] == 1 and got[(4, 12)] == -1
    assert got[(1, 13)] == -1 and got[(4, 13)] == -1
    ign = {(r.k, r.qid): r.pred for r in
           classify.knn_vote(matches, labels, queries, [4], ignore_missing=True).collect()}
    assert ign[(4, 11)] == 2 and (4, 13) not in ign


def test_multiclass_metrics_hand_table(spark):
    y = [(0, 0), (0, 0), (1, 0), (1, 1), (2, 1), (2, -1)]   # (true, pred)
    df = spark.createDataFrame([(1, t, p) for t, p in y], "k int, y_true int, y_pred int")
    got = {r.metric: r.value for r in metrics.multiclass_metrics(df).collect()}
    # classes = {-1, 0, 1, 2}; precision: -1:0, 0:2/3, 1:1/2, 2:0 ; recall: -1:0, 0:1, 1:1/2, 2:0
    assert got["accuracy"] == pytest.approx(3 / 6)
    assert got["precision/micro"] == pytest.approx(0.5)
    assert got["precision/macro"] == pytest.approx((2 / 3 + 1 / 2) / 4)
    assert got["recall/macro"] == pytest.approx((1 + 0.5) / 4)
    f0, f1 = 2 * 2 / (2 * 2 + 1 + 0), 2 * 1 / (2 + 1 + 1)
    assert got["f1/macro"] == pytest.approx((f0 + f1) / 4)


def test_multilabel_metrics_hand_table(spark):
    preds = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 2, 2)], "k int, id long, label int")
    truth = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 3)], "id long, label int")
    conf = metrics.multilabel_confusion(preds, truth, [0])
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    exact = metrics.subset_exact(preds, truth, [0], ids)
    more = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")  # 4 has no label on either side
    assert metrics.subset_exact(preds, truth, [0, 5], more).filter("k = 0").first().n_exact == 2
    got = {r.metric: r.value for r in metrics.multilabel_metrics(conf, 3, 4, exact).collect()}
    tp, fp, fn, N, L, e = 2, 1, 2, 3, 4, 1e-5
    assert got["confusion/tp"] == tp and got["confusion/fp"] == fp and got["confusion/fn"] == fn
    assert got["confusion/tn"] == N * L - tp - fp - fn
    assert got["accuracy"] == pytest.approx(1 / 3)
    assert got["hamming"] == pytest.approx((fp + fn) / (N * L))
    ap, ar = tp / (tp + fp + e), tp / (tp + fn + e)
    assert got["precision/micro"] == pytest.approx(ap)
    assert got["f1/micro"] == pytest.approx(2 * ap * ar / (ap + ar + e))
    # per class: 0 (tp1), 1 (tp1 fn1), 2 (fp1), 3 (fn1): macro over all 4 labels
    p = [1 / (1 + e), 1 / (1 + e), 0, 0]
    r = [1 / (1 + e), 1 / (2 + e), 0, 0]
    assert got["precision/macro"] == pytest.approx(sum(p) / 4, rel=1e-6)
    assert got["recall/macro"] == pytest.approx(sum(r) / 4, rel=1e-6)


def _ari(a, b):
    from collections import Counter
    comb = lambda n: n * (n - 1) / 2
    n = len(a)
    sij = sum(comb(v) for v in Counter(zip(a, b)).values())
    sa = sum(comb(v) for v in Counter(a).values())
    sb = sum(comb(v) for v in Counter(b).values())
    exp = sa * sb / comb(n)
    return (sij - exp) / ((sa + sb) / 2 - exp)


def test_adjusted_rand(spark):
    a = [0, 0, 1, 1, 2, 2, 2, 0]
    b = [1, 1, 0, 0, 0, 2, 2, 1]
    df = spark.createDataFrame(list(zip(a, b)), "cluster int, label int")
    assert metrics.adjusted_rand_index(df).first().ari == pytest.approx(_ari(a, b))


def test_contrastive_and_kl(spark):
    rows = [(1, 0, 2.0, 1.0), (1, 1, 1.0, 0.5), (1, 2, 0.5, 0.0), (2, 0, 0.1, 0.3), (2, 1, 0.2, 0.2), (2, 2, 0.3, 0.1)]
    df = spark.createDataFrame(rows, "anchor long, slot int, score double, teacher double")
    loss = metrics.contrastive_loss(df.select("anchor", "slot", "score")).first().loss
    exp = []
    kl = 0.0
    for a in (1, 2):
        s = np.array([r[2] for r in rows if r[0] == a])
        t = np.array([r[3] for r in rows if r[0] == a])
        exp.append(math.log(np.exp(s).sum()) - s[0])
        lt, ls = t - math.log(np.exp(t).sum()), s - math.log(np.exp(s).sum())
        kl += float((np.exp(lt) * (lt - ls)).sum())
    assert loss == pytest.approx(np.mean(exp), abs=1e-8)
    assert metrics.distillation_kl(df).first().kl == pytest.approx(kl / 2, abs=1e-8)
