"""MaxSim of words of a vocabulary against the join of their vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import encode, word_join
from vicinity.operators.similarity import maxsim_join


def _rows(df):
    return sorted((r.qid, r.rank, r.pid, round(r.score, 5)) for r in df.collect())


def _tables(spark, passages=60, longest=40):
    rng = np.random.default_rng(5)
    vocab = spark.createDataFrame([(f"w{i}", [float(x) for x in rng.normal(size=12)]) for i in range(50)], "token string, vec array<double>")
    rows = [(p, i, f"w{int(55 * rng.random() ** 2)}") for p in range(passages) for i in range(rng.integers(0, longest))]  # some have no vector
    return vocab, spark.createDataFrame(rows + [(7, 90 + i, "w1") for i in range(3)] + [(passages, 0, None), (passages + 1, 0, "w54")],
                                        "pid long, pos int, token string")


@pytest.mark.parametrize("exclude_self,size", [(False, 64), (True, 1 << 18)])
def test_words_match_their_vectors(spark, monkeypatch, exclude_self, size):
    monkeypatch.setattr(word_join, "LONG", 7)
    vocab, tokens = _tables(spark)
    v = encode.lookup_token_vectors(tokens, vocab)
    queries = tokens.filter("pid % 5 = 0").withColumnRenamed("pid", "qid")
    qv = v.filter("pid % 5 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec")
    want = _rows(maxsim_join(qv, v.select("pid", "pos", "vec"), 6, exclude_self))
    got = _rows(word_join.maxsim_words(queries, tokens, vocab, 6, exclude_self, query_words=size, passage_words=size))
    assert got == want and len(want) > 60


def test_no_vector_per_token(spark):
    """The stored blocks hold a word's vector once: ten times the occurrences take no more than their numbers."""
    vocab, tokens = _tables(spark, 20)
    sizes = []
    for times in (1, 10):
        more = tokens.crossJoin(spark.range(times)).select(F.col("pid").alias("id"), "token").groupBy("id", "token").agg(F.count("*").alias("n"))
        blocks, n = word_join._blocks(more, vocab, 1 << 18, 12, 50, 1)
        sizes.append(blocks.select(F.length("vecs") + F.length("words") + F.length("counts")).first()[0])
        assert n == 1 and blocks.count() == 1
    assert sizes[0] == sizes[1] < tokens.count() * 12 * 8


def test_sums_over_few_words_each_are_rows_added():
    """Scores of queries with a few words in a strip: exact, and no slower than some passes over the rows (before, 4.8 times one)."""
    import time
    rng = np.random.default_rng(3)
    n, passages, rows, dim = 3000, 800, 3000, 4
    Q, D = rng.normal(size=(200, dim)), rng.normal(size=(50, dim))
    word = np.sort(rng.integers(0, 200, rows))
    query, count = rng.integers(0, n, rows), rng.integers(1, 5, rows)
    lens = np.full(passages, 2)
    words = rng.integers(0, 50, lens.sum())
    best = np.maximum.reduceat((Q @ D.T)[:, words], np.arange(0, len(words), 2), axis=1)
    want, times = np.zeros((n, passages)), {"kernel": [], "rows": []}
    for q, w, c in zip(query, word, count):
        want[q] += best[w] * c
    for _ in range(5):
        at = time.perf_counter()
        got = word_join.word_scores(query, word, count, n, Q, words, lens, D)
        times["kernel"].append(time.perf_counter() - at)
        scores, at = np.zeros((n, passages)), time.perf_counter()
        for e in range(0, rows, 1000):
            scores[query[e:e + 1000]] += best[word[e:e + 1000]] * count[e:e + 1000, None]
        times["rows"].append(time.perf_counter() - at)
    assert np.allclose(got, want)
    assert min(times["kernel"]) < 3 * min(times["rows"]), times
