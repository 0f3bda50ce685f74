"""Two-level centroid search against the map with all centroids broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import ivf
from vicinity.session import cut_lineage, ship_package


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 8)) * 3
    cents = [(int(i * 3 - 7), [float(x) for x in middle[i % 12] + rng.normal(size=8) * 0.3]) for i in range(300)]
    cents += [(5000, cents[4][1]), (-100, cents[9][1])]  # ties go to the smaller cell
    vecs = [(i, i % 2, [float(x) for x in middle[i % 12] * rng.uniform(0.2, 2) + rng.normal(size=8)]) for i in range(200)] + [(999, 0, None), (1000, 0, [0.0] * 8)]
    return (cut_lineage(spark.createDataFrame(vecs, "pid long, pos int, vec array<double>")),
            cut_lineage(spark.createDataFrame(cents, "cell int, centroid array<double>")))


def _rows(frame):
    return sorted((r["pid"], r["pos"], r["cell"], r["cell_score"], tuple(r["vec"])) for r in frame.collect())


@pytest.mark.parametrize("metric", ["inner_product", "l2_distance"])
@pytest.mark.parametrize("ncells", [1, 5, 400])
def test_tree_equals_broadcast(spark, tables, metric, ncells):
    vecs, cents = tables
    want = _rows(ivf.cell_map(vecs, cents, ncells, ["pid", "pos"], metric))
    for limit in (1, 10 * 64):  # one head, ten heads
        spark.conf.set("vicinity.broadcast.maxBytes", str(limit))
        try:
            got = _rows(ivf.cell_map(vecs, cents, ncells, ["pid", "pos"], metric))
        finally:
            spark.conf.unset("vicinity.broadcast.maxBytes")
        assert got == want


def test_tree_meets_few_groups(spark, tables, monkeypatch):
    vecs, cents = tables
    seen = []
    scored = ivf._scored_blocks
    monkeypatch.setattr(ivf, "_scored_blocks", lambda probes, *a: (seen.append(probes.count()), scored(probes, *a))[1])
    spark.conf.set("vicinity.broadcast.maxBytes", str(17 * 64))
    try:
        ivf.cell_map(vecs.filter("vec is not null"), cents, 1, ["pid", "pos"], "l2_distance").collect()
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")
    assert seen[0] == 201 and sum(seen) < 201 * 17 / 2  # of 17 groups for each vector


def test_empty_sides(spark, tables):
    vecs, cents = tables
    spark.conf.set("vicinity.broadcast.maxBytes", "1")
    try:
        assert ivf.cell_map(vecs.limit(0), cents, 2, ["pid", "pos"]).collect() == []
    finally:
        spark.conf.unset("vicinity.broadcast.maxBytes")
