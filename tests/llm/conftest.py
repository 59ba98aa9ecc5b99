import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture()
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, null ids and columns whose names clash with the operators' own."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [(1, None, None), (2, "", "en"), (3, "   \n", "en"), (4, long, "la"), (5, "one two", "en"), (5, "one two", "en"), (None, "no id here at all", None), (7, "x" * 50_000, None), (8, "émigré\tÀ ça 'tis 12", "fr"), (9, "<|endoftext|> a", "en")]
    schema = "doc_id long, text string, lang string, handle string, n_tokens int, score string, component_id int, spans string, n_bytes string, id string, key int, cluster string, least int"
    return spark.createDataFrame([(*r, "h", 1, "s", 2, "p", "b", "i", 3, "c", 4) for r in rows], schema)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
