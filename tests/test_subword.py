"""Sub-word vectors against plain Python, and the token lookup beyond the broadcast limit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import encode, subword

WORDS = {"apple": (5, [1.0, 2.0]), "apply": (3, [3.0, -1.0]), "été": (2, [0.5, 0.5]), "a": (7, [9.0, 9.0])}


def _buckets(token, shortest=3, longest=6, buckets=97):
    w = f"<{token}>"
    grams = {w[i:i + n] for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)}
    return {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % buckets for g in grams}


def _trained():
    sums = {}
    for token, (n, vec) in WORDS.items():
        for b in _buckets(token):
            s = sums.setdefault(b, [0, np.zeros(2)])
            s[0] += n
            s[1] += n * np.array(vec)
    return {b: v / n for b, (n, v) in sums.items()}


@pytest.fixture
def vocab(spark):
    rows = [(t, n, v) for t, (n, v) in WORDS.items()] + [(None, 4, [1.0, 1.0]), ("zz", 4, None), ("yy", 0, [1.0, 1.0])]
    return spark.createDataFrame(rows, "token string, n long, vec array<double>")


def test_buckets_and_composition(spark, vocab):
    table = subword.train_buckets(vocab, buckets=97)
    got = {r["bucket"]: r["vec"] for r in table.collect()}
    want = _trained()
    assert set(got) == set(want) and all(np.allclose(got[b], want[b]) for b in want)
    tokens = spark.createDataFrame([(t,) for t in ("apples", "apple", "applied", "ét", "", "qqqqqqqq", "apples", None)], "token string")
    rows = {r["token"]: r for r in subword.subword_vocabulary(tokens, vocab.filter("vec is not null"), table, buckets=97).collect()}
    assert set(rows) == {"apples", "apple", "applied", "ét", "", "qqqqqqqq"} and rows["apple"]["known"] and rows["apple"]["vec"] == [1.0, 2.0]
    for t, r in rows.items():
        if t != "apple":
            found = [want[b] for b in _buckets(t) if b in want]
            assert not r["known"] and np.allclose(r["vec"], np.mean(found, 0) if found else [0.0, 0.0])


def test_no_token_is_lost(spark, vocab):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["apple", "unseen", "", "apple", "été"])], "pid long, pos int, token string")
    got = subword.lookup_with_subwords(tokens, vocab.filter("vec is not null"), subword.train_buckets(vocab, buckets=97), buckets=97).collect()
    assert sorted((r["pos"], r["token"]) for r in got) == [(i, t) for i, t in enumerate(["apple", "unseen", "", "apple", "été"])]
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-12 or not any(r["vec"]) for r in got)


def test_heavy_tokens_beyond_the_limit(spark):
    tokens = spark.range(3000).select(F.col("id").alias("pid"), F.lit(0).alias("pos"),
                                      F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 200)).alias("token"))
    vocab = encode.vocabulary_vectors(tokens.filter("token <> 'w7'"))
    want = sorted(map(str, encode.lookup_token_vectors(tokens, vocab).collect()))
    spark.conf.set("vicinity.broadcast.maxBytes", "1")
    try:
        assert sorted(map(str, encode.lookup_token_vectors(tokens, vocab).collect())) == want
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")
