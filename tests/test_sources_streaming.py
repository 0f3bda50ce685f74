"""Connectors (JSON lines, label names, split datasets) and the streaming counters."""

import gzip
import uuid

import pytest
from pyspark.sql import functions as F

from vicinity.operators import metrics
from vicinity.sources import jsonl
from vicinity.sources.tables import inline_texts, load_split, save_splits
from vicinity.streaming.metric_counters import run_counters


def test_jsonl_latin1_gzip(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    lines = ['{"uid": 1, "title": "Caf\xe9", "content": "cr\xe8me br\xfbl\xe9e", "target_ind": [3, 1], "other": 5}',
             '{"uid": 2, "title": "x", "content": "", "target_ind": []}']
    with gzip.open(d / "part-0.json.gz", "wb") as f:
        f.write(("\n".join(lines) + "\n").encode("latin-1"))
    rows = {r.uid: r for r in jsonl.read_jsonl_corpus(spark, str(d)).collect()}
    assert rows["1"].title == "Café" and rows["1"].text == "crème brûlée" and rows["1"].labels == [3, 1]
    assert rows["2"].labels == [] and rows["2"].text == "" and [rows["1"].pid, rows["2"].pid] == [0, 1]


def test_jsonl_ids_are_line_numbers(spark, tmp_path):
    for part, uids in (("a.json", [None, "B000A1"]), ("b.json", ["7"] * 3)):
        lines = ["{" + (f'"uid": "{u}", ' if u else "") + f'"title": "{part}{i}", "content": "x", "target_ind": [0]' + "}"
                 for i, u in enumerate(uids)]
        (tmp_path / part).write_bytes("\n".join(lines).encode("latin-1"))
    rows = sorted(jsonl.read_jsonl_corpus(spark, str(tmp_path)).collect(), key=lambda r: r.pid)
    assert [(r.pid, r.uid, r.title) for r in rows] == [
        (0, None, "a.json0"), (1, "B000A1", "a.json1"), (2, "7", "b.json0"), (3, "7", "b.json1"), (4, "7", "b.json2")]


def test_jsonl_round_trip_and_label_names(spark, tmp_path):
    df = spark.createDataFrame([("5", "t", "été", [1]), ("6", "u", "say “hi” – € 🙂\n", [])],
                               "uid string, title string, text string, labels array<int>")
    jsonl.write_jsonl_corpus(df, str(tmp_path / "c"))
    back = {r.uid: (r.title, r.text, r.labels) for r in jsonl.read_jsonl_corpus(spark, str(tmp_path / "c")).collect()}
    assert back == {"5": ("t", "été", [1]), "6": ("u", "say “hi” – € 🙂\n", [])}
    names = spark.createDataFrame([(1, ' b "q", \\x '), (0, "Café"), (2, "c:d")], "label_id int, name string")
    jsonl.write_label_names(names, str(tmp_path / "n"))
    got = {r.label_id: r.name for r in jsonl.read_label_names(spark, str(tmp_path / "n")).collect()}
    assert got == {0: "Café", 1: ' b "q", \\x ', 2: "c:d"}
    (tmp_path / "crlf").write_bytes("\n Café\r\nb\rc d\r\n\r\n".encode("latin-1"))
    assert [r.name for r in jsonl.read_label_names(spark, str(tmp_path / "crlf")).collect()] == ["Café", "b", "c d"]
    with pytest.raises(Exception, match="not a latin-1|MALFORMED_CHARACTER_CODING"):
        jsonl.write_label_names(spark.createDataFrame([(0, "日本")], "label_id int, name string"), str(tmp_path / "bad"))


def test_split_dataset_sink(spark, tmp_path):
    df = inline_texts(spark, ["a", "b", "c"]).withColumn(
        "split", F.when(F.col("pid") == 1, F.lit("test")).otherwise(F.lit("train")))
    save_splits(df, str(tmp_path / "ds"))
    assert sorted(r.pid for r in load_split(spark, str(tmp_path / "ds"), "train").collect()) == [0, 2]
    assert {r.pid: r.text for r in inline_texts(spark, {7: "x"}).collect()} == {7: "x"}


def test_streaming_counters_equal_batch(spark, tmp_path):
    rows = [(1, [0, 1], [1, 2]), (2, [2], [2]), (3, [], [0]), (4, [3, 0], [0]), (5, [1], [1, 3])]
    df = spark.createDataFrame(rows, "id long, preds array<int>, labels array<int>")
    src = str(tmp_path / "in")
    df.repartition(3, "id").write.parquet(src)
    name = f"t_{uuid.uuid4().hex[:8]}"
    got = {r.label: (r.tp, r.fp, r.fn) for r in run_counters(spark, src, str(tmp_path / "state"), name).collect()}
    preds = df.select(F.lit(0).alias("k"), "id", F.explode("preds").alias("label"))
    truth = df.select("id", F.explode("labels").alias("label"))
    exp = {r.label: (r.tp, r.fp, r.fn) for r in metrics.multilabel_confusion(preds, truth, [0]).collect()}
    assert got == exp
