"""Edge cases listed for hand-built tables: equal and zero weights, zero vectors,
duplicate tokens around a skip list, passages without any negative."""

import numpy as np

from vicinity.functions.vectors import l2_normalize
from vicinity.operators import sampling


def test_equal_scores_give_uniform_weights_and_zero_weights_come_last(spark):
    rows = [(1, "neg", 10, 0.5, 1), (1, "neg", 11, 0.5, 2), (1, "neg", 12, 0.5, 3),       # all equal
            (2, "neg", 20, 0.9, 1), (2, "neg", 21, 0.1, 2), (2, "neg", 22, 0.5, 3),       # 21 -> weight 0
            (2, "pos", 23, 0.7, 1)]
    c = spark.createDataFrame(rows, "anchor long, role string, pid long, score double, ord long")
    w = {(r.anchor, r.pid): r.weight for r in sampling.candidate_weights(c, "scores").collect()}
    assert w[(1, 10)] == w[(1, 11)] == w[(1, 12)] == 1.0
    assert w[(2, 21)] == 0.0 and w[(2, 23)] == 1.0
    for seed in range(5):
        t = {(r.anchor, r.slot): r.pid for r in sampling.draw_tuples(
            sampling.candidate_weights(c, "scores"), 4, seed).collect()}
        assert 21 not in (t[(2, 2)], t[(2, 3)])         # zero weight only after all others
        assert t[(1, 1)] == 1                           # no positive: the anchor itself


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([3.0, 0.0, 4.0],)], "v array<double>")
    got = [r.n for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert got[0] == [0.0, 0.0, 0.0] and np.allclose(got[1], [0.6, 0.0, 0.8])


def test_skip_list_keeps_duplicates_of_other_tokens(spark):
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, "b")],
                                 "pid long, pos int, token string")
    skip = spark.createDataFrame([("b",)], "token string")
    kept = sorted((r.pos, r.token) for r in toks.join(skip, "token", "left_anti").collect())
    assert kept == [(0, "a"), (2, "a"), (3, "c")]     # duplicates survive, unlike array_except


def test_multilabel_passage_without_negative(spark):
    rows = [(1, [0, 1, 2]), (2, [0]), (3, [1]), (4, [2]), (5, [0, 2])]   # pid 1 shares with everyone
    p = spark.createDataFrame(rows, "pid long, labels array<int>")
    t = {}
    for r in sampling.random_tuples_ml(p, 4, seed=3).collect():
        t.setdefault(r.anchor, {})[r.slot] = r.pid
    assert sorted(t[1]) == [0, 1]                       # anchor + positive, no negative exists
    assert t[1][1] != 1
    assert all(not (set(dict(rows)[x]) & set(dict(rows)[2])) for s, x in t[2].items() if s >= 2)
