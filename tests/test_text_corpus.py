"""Tokenizer, sentence splitter edge cases, label preparation and seeded selections."""

import pytest
from pyspark.sql import functions as F

from vicinity.functions import text as tx
from vicinity.operators import corpus as cp


def _one(spark, col_expr, value):
    return spark.createDataFrame([(value,)], "text string").select(col_expr.alias("x")).first().x


@pytest.mark.parametrize("value,expected", [
    ("Mr. Smith paid 3.5 at example.com... Ok?", ["Mr. Smith paid 3.5 at example.com...", "Ok?"]),
    ("Hello world", ["Hello world"]),
    ("a... b. c..", ["a...", "b. c.."]),
    ('He said "stop." Then left!', ['He said "stop".', "Then left!"]),
    ("The U.S. He went home.", ["The U.S.", "He went home."]),
    ("", []),
])
def test_sentence_splitter(spark, value, expected):
    assert _one(spark, tx.split_sentences("text"), value) == expected


def test_sentence_splitter_max(spark):
    assert len(_one(spark, tx.split_sentences("text", 2), "One. Two. Three. Four.")) == 2


def test_tokenizer(spark):
    got = _one(spark, tx.simple_tokens("text"), "Hello World_x 123abc _under a é2é Straße ÉCOLE")
    assert got == ["hello", "world_x", "abc", "straße", "école"]
    long = " ".join(["tok"] * 600)
    assert len(_one(spark, tx.simple_tokens("text"), long)) == 600          # whole text by default
    assert len(_one(spark, tx.simple_tokens("text", max_tokens=512), long)) == 512


def test_sequence_markers(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    seq = df.select(tx.encode_sequence("t", tx.QUERY_MARKER, max_length=4).alias("s")).first().s
    assert seq == ["[CLS]", "[Q]", "a", "[SEP]"]
    full = df.select(tx.encode_sequence("t", tx.DOC_MARKER).alias("s"))
    assert full.select(tx.inner_tokens("s").alias("i")).first().i == ["a", "b", "c"]
    nomark = df.select(tx.encode_sequence("t", "").alias("s"))
    assert nomark.select(tx.inner_tokens("s", has_marker=False).alias("i")).first().i == ["a", "b", "c"]


def test_prune_reindex_single_label(spark):
    rows = [(1, "train", ["x", "y", "x"]), (2, "train", ["y", "z"]), (3, "train", ["y"]), (4, "train", ["x"]),
            (5, "test", ["z", "w"]), (6, "test", ["x"]), (7, "train", ["q"])]
    df = spark.createDataFrame(rows, "pid long, split string, topics array<string>")
    out, d = cp.prune_and_reindex(df, 2)
    names = {r.name: r.label_id for r in d.collect()}
    assert names == {"x": 0, "y": 1}                      # first-seen order; z, q, w pruned
    got = {r.pid: r.labels for r in out.collect()}
    assert got == {1: [0, 1], 2: [1], 3: [1], 4: [0], 6: [0]}   # duplicates collapse, empty rows dropped
    single, d1 = cp.single_label_reduction(out, 2)
    assert {r.pid: r.label for r in single.collect()} == {2: 0, 3: 0}  # label 0 (x) has one train row only


def test_exact_cut_and_splits(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("pid"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    s = cp.random_split(df, 0.1, seed=5)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"validation": 100, "train": 900}
    st = cp.stratified_split(df, 0.1, seed=5)
    by = {(r.label, r.split): r["count"] for r in st.groupBy("label", "split").count().collect()}
    assert by[(1, "validation")] + by[(0, "validation")] == 100
    assert by[(1, "validation")] in (14, 15)
    cap = cp.cap_per_class(df, 50, seed=3)
    assert {r.label: r["count"] for r in cap.groupBy("label").count().collect()} == {0: 50, 1: 50}
    # same result whatever the partitioning
    a = {r.pid for r in cp.subsample(df.repartition(1), 0.3, seed=9).collect()}
    b = {r.pid for r in cp.subsample(df.repartition(7), 0.3, seed=9).collect()}
    assert a == b and len(a) == 300


def test_decode_unknown(spark):
    d = spark.createDataFrame([(0, "a")], "label_id int, name string")
    df = spark.createDataFrame([(1, 0), (2, 5)], "pid long, label int")
    assert {r.pid: r.name for r in cp.decode_labels(df, d).collect()} == {1: "a", 2: "?"}
