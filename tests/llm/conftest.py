import pytest

LONG = "long words without any end " * 40_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty and very long texts, ties, repeated rows, null ids, and extra columns with clashing names."""
    rows = [(1, None, "en", None, 1, "x"), (2, "", None, "s", 2, "x"), (3, LONG, "en", "s", 3, "x"), (4, LONG, "en", "s", 3, "y"), (5, "a b c", "de", "s", 3, None), (5, "a b c", "de", "s", 3, None), (6, "a  b\tc", "de", "s", 3, None), (None, "a b c", "fr", "s", 3, None), (None, None, None, None, None, None), (7, "\x00🙂 é", "fr", "s", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string").selectExpr("*", "1 as k1", "2 as h1", "3 as score", "4 as class_id", "5 as id", "6 as starts", "7 as __hits")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf001(spark):
    return "/root/testdata/sf0.001"
