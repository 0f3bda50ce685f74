"""Evaluation runs: what is reused, what is built again, configurations, samplers; linear head and its pipeline."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.evaluation import EvaluationRun, EvaluatorConfig, EvaluatorMLCConfig, SamplingConfig, SamplingMethod
from vicinity.operators import classify
from vicinity.operators.linear_head import LinearHead
from vicinity.operators.similarity import knn_join
from vicinity.pipeline import ClassificationPipeline, IndexConfig, SearchConfig, build_index, search
from vicinity.session import checkpoint_dir, cut_lineage, ship_package


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    centre = np.eye(4, 6) * 4
    data = [(i, [float(x) for x in centre[i % 4] + rng.normal(size=6)], i % 4, [i % 4, 4 + i % 2]) for i in range(80)]
    return cut_lineage(spark.createDataFrame(data, "pid long, vec array<double>, label int, labels array<int>"))


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"


def _sides(rows, label="label"):
    return (rows.filter("pid < 60").select("pid", "vec", label), rows.filter("pid >= 60").select("pid", "vec", label))


def _values(run):
    return {r["key"]: r["value"] for r in run.run().collect()}


def test_reuse_and_rebuild(spark, rows, folder):
    train, test = _sides(rows)
    config = EvaluatorConfig(output_dir=folder, eval_ks=(1, 5), prefix="dev")
    first = EvaluationRun(train, test, config)
    values = _values(first)
    assert set(first.built) == {"index", "matches"}
    assert {"dev/accuracy/1", "dev/accuracy/5", "dev/accuracy", "dev/f1/macro/5"} <= set(values) and values["dev/accuracy"] > 0.9
    again = EvaluationRun(train.repartition(5), test, config)
    assert _values(again) == values and again.built == [] and again.reused == ["matches"]
    relabelled = EvaluationRun(train.withColumn("label", F.lit(0)), test, config)
    assert _values(relabelled)["dev/accuracy"] == 0.25 and relabelled.built == []  # labels are no part of an index
    changed = EvaluationRun(train.filter("pid > 0"), test, config)
    assert _values(changed) and set(changed.built) == {"index", "matches"}
    renamed = EvaluationRun(train, test, config, name="another model")
    assert _values(renamed) == values and set(renamed.built) == {"index", "matches"}
    anew = EvaluationRun(train, test, EvaluatorConfig(output_dir=folder, eval_ks=(1, 5), prefix="dev", reuse_index=False))
    assert _values(anew) == values and anew.reused == []


def test_broken_run_is_not_reused(spark, rows, folder):
    train, test = _sides(rows)
    run = EvaluationRun(train, test, EvaluatorConfig(output_dir=folder))
    path = f"{folder}/index-{run.index_key}"
    train.limit(3).select("pid", "vec").write.parquet(f"{path}/vectors")  # cut off before its done row
    assert run.index().vectors.count() == 60 and run.built == ["index"]


@pytest.mark.parametrize("layout", ["Flat", "IVF4,Flat", "IVF4,R8"])
def test_layouts(rows, folder, layout):
    train, test = _sides(rows)
    search_config = SearchConfig(ncells=4, threshold=-99.0, ndocs=400)
    values = [_values(EvaluationRun(train, test, EvaluatorConfig(output_dir=folder, eval_ks=(3,)), IndexConfig(layout=layout), search_config))
              for _ in range(2)]
    assert values[0] == values[1] and values[0]["test/accuracy/3"] > 0.9


def test_multi_label_run_and_subsamples(rows, folder):
    train, test = _sides(rows, "labels")
    config = EvaluatorMLCConfig(output_dir=folder, eval_ks=(1, 2), mlknn_k=5, subsample_train=0.5, subsample_eval=10)
    run = EvaluationRun(train, test, config)
    assert (run.train.count(), run.evaluation.count()) == (30, 10)
    values = _values(run)
    assert values["test/precision/micro/1"] > 0.8 and set(run.built) == {"index", "matches", "mlknn"}
    again = EvaluationRun(train, test, config)
    assert _values(again) == values and again.built == []


def test_own_functions(rows, folder):
    train, test = _sides(rows)
    run = EvaluationRun(train, test, EvaluatorConfig(output_dir=folder),
                        evaluate=lambda r: r.matches(k=2).agg(F.lit("matches").alias("metric"), F.lit(2).alias("k"), F.count("*").alias("value")),
                        sampler=lambda r, c: r.labels("train").limit(c.nway))
    assert _values(run) == {"test/matches/2": 40} and run.sample(SamplingConfig(nway=7)).count() == 7


@pytest.mark.parametrize("method,probability", [("random", "uniform"), ("class_wise_random", "uniform"), ("searched", "ranks"), ("searched", "scores")])
def test_samplers(rows, folder, method, probability):
    train, _ = _sides(rows)
    run = EvaluationRun(train, train.limit(0), EvaluatorConfig(output_dir=folder))
    label = {r["pid"]: r["label"] for r in train.collect()}
    got = run.sample(SamplingConfig(method, probability, searcher_sampling_k=9, nway=5)).collect()
    assert len(got) == 60 * 5 and all((label[r["pid"]] == label[r["anchor"]]) == (r["slot"] < 2) for r in got)
    half = run.sample(SamplingConfig(method, probability, searcher_sampling_k=9, nway=5, subsample=0.5)).collect()
    assert len({r["anchor"] for r in half}) == 30 and {r["pid"] for r in half} <= {r["anchor"] for r in half}


def test_multi_label_samplers(rows, folder):
    train, _ = _sides(rows, "labels")
    run = EvaluationRun(train, train.limit(0), EvaluatorMLCConfig(output_dir=folder))
    labels = {r["pid"]: set(r["labels"]) for r in train.collect()}
    for method in ("random", "searched"):
        got = run.sample(SamplingConfig(method, "scores", searcher_sampling_k=6, nway=4)).collect()
        assert len(got) == 60 * 4 and all(bool(labels[r["pid"]] & labels[r["anchor"]]) == (r["slot"] < 2) for r in got)
    with pytest.raises(ValueError):
        run.sample(SamplingConfig("class_wise_random"))


def test_wrong_configurations():
    for kind, wrong in ((SamplingConfig, dict(sampling_method="best")), (SamplingConfig, dict(probability_type="x")), (SamplingConfig, dict(nway=2)),
                        (SamplingConfig, dict(n_positives=-1)), (SamplingConfig, dict(subsample=1.5)), (EvaluatorConfig, dict(eval_ks=())),
                        (EvaluatorConfig, dict(eval_ks=(0,))), (EvaluatorConfig, dict(subsample_eval=0)), (EvaluatorMLCConfig, dict(mlknn_k=0)),
                        (EvaluatorMLCConfig, dict(stratify_splits=True))):
        with pytest.raises(ValueError):
            kind(**wrong)
    assert SamplingConfig("searched").sampling_method is SamplingMethod.searched and SamplingConfig(nway=6).negatives == 4


def test_search_without_self_in_cells(rows):
    index = build_index(rows.select("pid", "vec"), IndexConfig(layout="IVF4,Flat"))
    queries = rows.select(F.col("pid").alias("qid"), "vec")
    got = search(index, queries, SearchConfig(k=3, ncells=4, exclude_self=True))
    want = knn_join(queries, rows, 3, exclude_self=True)
    order = ["qid", "rank", "pid", "score"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))


def test_linear_head(spark, rows, folder):
    head = LinearHead.train(rows.withColumn("label", F.col("label") * 7 - 5))
    head.save(folder)
    got = LinearHead.load(spark, folder).predict(rows.withColumnRenamed("pid", "qid"))
    assert sum(r["pred"] == r["qid"] % 4 * 7 - 5 for r in got.collect()) > 75
    ties = LinearHead(spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], "label int, weight array<double>"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "qid long, vec array<double>")
    want = [(1, 2, 1.0), (2, 9, 2.0)]
    assert sorted(map(tuple, ties.predict(vectors).collect())) == want
    spark.conf.set("vicinity.broadcast.maxBytes", "1")
    try:
        assert sorted(map(tuple, ties.predict(vectors).collect())) == want
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")
    assert LinearHead.train(rows.filter("label = 2")).predict(vectors.limit(0)).collect() == []
    with pytest.raises(ValueError):
        LinearHead.train(rows.limit(0))


def test_head_pipeline(spark, folder):
    docs = spark.createDataFrame([(i, f"red apple tree {i}" if i % 2 else f"blue whale sea {i}", i % 2) for i in range(30)],
                                 "pid long, text string, label int")
    ClassificationPipeline("bert").train_head(docs).save_head(folder)
    model = ClassificationPipeline("bert").load_head(spark, folder)
    assert all(r["pred"] == r["qid"] % 2 and r["k"] == 0 for r in model.predict(docs).collect())
    with pytest.raises(ValueError):
        model.train_index(docs)
    with pytest.raises(RuntimeError):
        ClassificationPipeline("bert").predict(docs)


def test_vote_rejects_labels_that_are_no_class_ids(spark):
    matches = spark.createDataFrame([(1, 1, 2, 0.5)], "qid long, rank int, pid long, score double")
    queries = matches.select("qid")
    for label, kind in (("x", "string"), (1 << 40, "long"), (-7, "int")):
        labels = spark.createDataFrame([(2, label)], f"pid long, label {kind}")
        with pytest.raises(Exception, match="labels are integers|no class id"):
            classify.knn_vote(matches, labels, queries, 1).collect()
    labels = spark.createDataFrame([(2, 3)], "pid long, label long")
    assert classify.knn_vote(matches, labels, queries, 1).first()["pred"] == 3
