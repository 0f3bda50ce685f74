"""The pipeline: stage contract, effect of the stages, and a brute-force check of the deduplicating ones."""

import re

import numpy as np

import corpus_pipeline
from vicinity.llm import mixing, queries
from tests.conftest import SF_MID, SF_SMALL


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF_SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in docs.collect()]
            assert len(set(norm)) == len(norm)
            assert set(norm) == {re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in before.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_mixing_stage_reaches_its_targets(spark, tmp_path):
    docs = queries.table(spark, SF_MID, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, SF_MID).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    d = mixing.mix(docs, queries.table(spark, SF_MID, "labels")).toPandas()
    totals = np.array([(d.rate * d.n_tokens * d[f"p_{x}"]).sum() for x in mixing.WEIGHTS])
    want = np.array([w if d[f"p_{x}"].any() else 0 for x, w in mixing.WEIGHTS.items()])
    targets = want / want[0] * mixing.FILL * (d.n_tokens * d.p_clean).sum()
    assert (np.abs(totals - targets) <= 1.01e-3 * targets).all()
    assert corpus_pipeline.mixture(spark, docs, SF_MID).count() == d.copies.sum()


def test_pipeline_on_empty_and_odd_documents(spark, docs_of, tmp_path):
    for i, rows in enumerate(([], [(1, None), (1, None), (None, "a b"), (2, ""), (3, "w " * 5000)])):
        docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / f"{i}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{i}-{name}"))
        assert docs.columns[:2] == ["doc_id", "n_tokens"]
