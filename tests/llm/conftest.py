import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp string, c string, mix string, spans string, share int, blob string"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(folder):
    return duckdb.execute(f"SELECT doc_id, text, lang, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, white and long texts, ties, repeated rows, and columns with names the operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [
        (1, words), (2, words), (2, words), (3, None), (4, ""), (5, " \n\t"), (None, words), (None, None), (6, words + "\n" + words),
        (7, ("lorem " * 9 + "\n") * 4000), (8, "é" * 300), (9, "<p>x</p>"), (-5, " alpha  beta\ngamma delta epsilon zeta eta theta iota kappa"),
    ]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "s", None, "r", "f", "c", "m", "s", n, "b") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, WIDE).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
