import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    from vicinity.session import ship_package
    ship_package(spark)


@pytest.fixture
def docs_of(spark):
    """Table of documents from (doc_id, text) or (doc_id, text, lang) rows, with columns whose names clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, "x", 1) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", _row string, _id long")
    return make


@pytest.fixture(scope="session")
def small_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    odd = [None, "", " ", "\n\n\t", "a", "A b", "x y z x y z\nx y z x y z\n\nq", "é" * 10 + " ▁ ▁▁b  c ", " lead", "trail ",
           "<s> </s> <0x0A> \t\x0b\x0c\r\x85 x", "日本語 テスト 🙂" * 5, "a\x00b � <unk>", "w" * 3000 + " " + "q " * 4000,
           "123 456", "!!! ???"]
    return [tuple(r) for r in rows] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(10_000, None), (10_004, "a"), (None, "a b c")]
