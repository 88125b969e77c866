import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and a column whose name clashes with inner ones."""
    rows = [
        (1, "The same words of a text that is long enough to have a print.", "en", "src1", 61, 1),
        (1, "The same words of a text that is long enough to have a print.", "en", "src1", 61, 1),
        (2, "The same words of a text that is long enough to have a print.", "en", "src1", 61, 2),
        (None, "The same words of a text that is long enough to have a print.", None, None, None, None),
        (3, None, "en", "src1", 0, 3),
        (4, "", "en", None, 0, 4),
        (5, "  \n \n", None, "src2", 5, 5),
        (6, "lang " * 40_000, "de", "src2", None, 6),
        (7, "x", None, None, 1, 7),
        (8, "é▁ \t日本\U0001f600\r\n\x00 end", "fr", "src3", 12, 8),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __gone bigint")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
