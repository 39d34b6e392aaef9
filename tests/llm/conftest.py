import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, score string, s string, row string"


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and sources, empty texts, a very long one, ties, repeated rows, columns that clash with ours."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    texts = [None, "", "  \t\n ", "one", "a b c d e f", "a b c d e f", "A b  c d\te f", long, long + " tail", "日本語 éé ß", "x" * 900, "!! $$ ##"]
    rows = [(i, t, "en", [None, "a", "b", ""][i % 4], len(t or ""), "k", "s", "x", "r") for i, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
