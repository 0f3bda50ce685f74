"""Generic row map: chosen inputs, added and removed columns, options, index, batched or by row."""

import pytest

from vicinity.operators.corpus import map_rows
from vicinity.session import ship_package


@pytest.fixture
def rows(spark):
    ship_package(spark)
    return spark.createDataFrame([(7, "a", None, [1, 2]), (3, "bb", 0.5, None), (5, None, 1.5, [])],
                                 "id long, text string, x double, tags array<int>").repartition(3)


def test_by_row_and_batched(rows):
    one = map_rows(rows, lambda text, tags, at, by: {"n": len(text or "") * by, "tags": (tags or []) + [at]}, "n int, tags array<int>",
                   ["text", "tags"], ["x"], index_by="id", by=10)
    assert one.dtypes == [("id", "bigint"), ("text", "string"), ("n", "int"), ("tags", "array<int>")]
    want = [(3, "bb", 20, [0]), (5, None, 0, [1]), (7, "a", 10, [1, 2, 2])]
    assert sorted(map(tuple, one.collect())) == want
    many = map_rows(rows, lambda texts, tags, at, by: {"n": [len(t or "") * by for t in texts], "tags": [(g or []) + [i] for g, i in zip(tags, at)]},
                    "n int, tags array<int>", ["text", "tags"], ["x"], batched=True, index_by="id", by=10)
    assert sorted(map(tuple, many.collect())) == want


def test_all_columns_no_index_and_errors(rows):
    got = map_rows(rows, lambda i, text, x, tags: {"x": (x or 0) + i}, "x double")
    assert sorted(map(tuple, got.select("id", "x").collect())) == [(3, 3.5), (5, 6.5), (7, 7.0)] and got.columns == ["id", "text", "tags", "x"]
    assert map_rows(rows.limit(0), lambda *a: {"y": 1}, "y int", index_by="id").collect() == []
    with pytest.raises(ValueError):
        map_rows(rows, print, "y int", ["nothing"])
