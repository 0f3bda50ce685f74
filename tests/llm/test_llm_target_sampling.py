"""Resampling towards a target against its definition in plain Python."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from vicinity.llm import target_sampling as ts
from vicinity.llm.queries import QUERIES, table


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _features(text, longest=2):
    w = _words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _bucket(feature, buckets):
    return crc32(feature.encode()) % buckets


def _brute(docs, target, longest=2, buckets=10_000, seed=7, min_words=20, percent=25):
    corpus = Counter(_bucket(f, buckets) for _, t in docs for f in _features(t, longest))
    wanted = Counter(_bucket(f, buckets) for t in target for f in _features(t, longest))
    all_s, all_t = sum(corpus.values()) + buckets, sum(wanted.values()) + buckets
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * all_s / ((corpus[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        f = _features(t, longest)
        weight = sum(gain[_bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(_words(t)), len(f), weight, weight + noise])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for at, r in enumerate(able[:percent * len(able) // 100]):
        ranks.setdefault(tuple(r), []).append(at + 1)
    out = []
    for r in rows:
        left = ranks.get(tuple(r), [])
        out.append((*r, left.pop(0) if left else None))
    return sorted(out, key=str)


def _rows(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=str)


def test_equals_definition(spark, docs_of, small_texts):
    target = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect()] + [None, ""]
    texts = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    hot = [(i % 3 if i % 2 else None, "one two three " * 9) for i in range(200)]  # repeated ids and texts, no ids
    docs = small_texts + hot
    assert _rows(ts.resample(docs_of(docs).repartition(5), texts)) == _brute(docs, target)


@pytest.mark.parametrize("longest,buckets", [(1, 7), (3, 100_000)])
def test_other_parameters(spark, docs_of, small_texts, longest, buckets):
    texts = spark.createDataFrame([("the of and",)], "text string")
    got = ts.resample(docs_of(small_texts), texts, longest, buckets, seed=1, min_words=3, percent=60)
    assert _rows(got) == _brute(small_texts, ["the of and"], longest, buckets, 1, 3, 60)


def test_runs_of_a_long_text():
    text = ("Über-flow x2 " * 150_000 + "\x00end").encode()
    words, found = ts.run_buckets(text, ts.run_pattern(2), 1000)
    w = _words(text.decode())
    assert words == len(w) == 450_001 and len(found) == 2 * words - 1
    assert Counter(found.tolist()) == Counter(_bucket(f, 1000) for f in _features(text.decode()))
    assert ts.run_buckets(b"w" * 3_000_000, ts.run_pattern(2), 1000)[0] == 1


@pytest.mark.parametrize("docs,target", [([], ["a"]), ([(1, "a b " * 20)], []), ([(1, None), (None, "")], [None])])
def test_empty_tables(spark, docs_of, docs, target):
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    assert _rows(ts.resample(docs_of(docs), texts)) == _brute(docs, target)


def test_rank_spreads_equal_rows(spark):
    rows = spark.range(20_000).selectExpr("1L as score", "id % 2 as doc_id").repartition(4)
    got = ts.with_rank(rows, rows["score"].desc(), rows["doc_id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 20_001))
    assert {r["doc_id"] for r in got if r["rank"] <= 10_000} == {0}


def test_query_equals_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = _brute(docs, [r[0] for r in table(spark, sf, "benchmark").select("text").collect()])
    got = QUERIES["op12_target_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], *r[2:]) for r in want), key=str)
