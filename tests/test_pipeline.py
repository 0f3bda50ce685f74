"""Index, search and classification entry points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import ivf
from vicinity.pipeline import ClassificationPipeline, IndexConfig, SearchConfig, build_index, search


def _table(spark, x, start=0, name="pid"):
    return spark.createDataFrame([(start + i, [float(a) for a in v]) for i, v in enumerate(x)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("metric", ["inner_product", "l2_distance"])
def test_every_query_gets_k_matches(spark, metric):
    r = np.random.default_rng(2)
    c, q = _table(spark, r.normal(size=(300, 5))), _table(spark, r.normal(size=(15, 5)), 1000, "qid")
    index = build_index(c, IndexConfig(layout="IVF32,Flat", metric=metric, train_size=200))
    got = search(index, q, SearchConfig(k=40, ncells=1)).groupBy("qid").count().collect()
    assert len(got) == 15 and all(x["count"] == 40 for x in got)
    flat = search(build_index(c, IndexConfig(metric=metric)), q, SearchConfig(k=7))
    every = search(index, q, SearchConfig(k=7, ncells=32))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, every.collect()))


def test_codec_rounds_to_the_mean_of_its_bucket(spark):
    r = np.random.default_rng(3)
    v = _table(spark, r.normal(size=(200, 4)))
    cents = spark.createDataFrame([(0, [0.0] * 4), (1, [1.0] * 4)], "cell int, centroid array<double>")
    asg = ivf.assign_cells(v, cents)
    cuts, means = ivf.train_codec(v, asg, cents, nbits=2, rel_err=0.0)
    res = {x.pid: (x.cell, x.residual) for x in ivf.residuals(v, asg, cents, ["pid"]).collect()}
    flat = np.concatenate([x[1] for x in res.values()])
    code = (flat[:, None] > np.array(cuts)).sum(1)
    assert np.allclose(means, [flat[code == i].mean() for i in range(4)]) and np.bincount(code).min() > 150
    out = ivf.residual_decode(ivf.residual_codes(v, asg, cents, cuts), cents, means).collect()
    for x in out:
        cell, rest = res[x.pid]
        raw = cell + np.array(means)[(np.array(rest)[:, None] > np.array(cuts)).sum(1)]
        assert np.allclose(x.vec, raw / np.linalg.norm(raw))


@pytest.mark.parametrize("architecture", ["sbert", "colbert", "scolbert", "wordvec"])
def test_classification_pipeline(spark, architecture):
    topics = {0: "rain snow wind storm cloud. sun and sky", 1: "bread milk cheese. butter and cake"}
    rows = [(i, topics[i % 2] + (" today" if i % 3 else " again"), i % 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "pid long, text string, label int")
    vocabulary = None
    if architecture == "wordvec":
        from vicinity.operators import encode
        vocabulary = encode.vocabulary_vectors(encode.token_table(docs))
    p = ClassificationPipeline(architecture, search=SearchConfig(k=3), vocabulary=vocabulary).train_index(docs.filter("pid < 16"))
    test = docs.filter("pid >= 16")
    got = p.predict(test, [1, 3]).join(docs.select(F.col("pid").alias("qid"), "label"), "qid").collect()
    assert len(got) == 8 and all(x.pred == x.label for x in got)
    explained = p.explain_prediction(test).collect()
    assert {x.qid for x in explained} == {16, 17, 18, 19} and all(x.pid % 2 == x.qid % 2 for x in explained)


def test_configs_are_checked():
    with pytest.raises(ValueError):
        IndexConfig(layout="HNSW")
    with pytest.raises(ValueError):
        IndexConfig(metric="cosine")
    with pytest.raises(ValueError):
        ClassificationPipeline("elmo")
    assert ivf.parse_layout("IVF64,Flat") == 64 and ivf.parse_layout("IVF,Flat") == 0 and ivf.parse_layout("Flat") is None
