import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, blank and very long texts, repeated rows, and columns whose names clash with helper columns."""
    long = "password = 'abcdefghijkl0123' word " * 3000
    rows = [
        (1, None, "en", "src1", 0), (2, "", "de", "src2", 0), (3, " \t\n", None, None, 3), (4, "one", "en", "src3", 3),
        (5, long, "en", "src0", len(long)), (6, "Ünï cödé 🙂 token=abcdefghijkl tail", "de", "src0", 30),
        (7, "same words here and there again and more of them", "fr", "src0", 40), (7, "same words here and there again and more of them", "fr", "src0", 40),
        (None, "a row without an id but with some words in it", "es", "src4", 40), (9, "x" * 50_000, "en", "src5", 50_000),
    ]
    extra = [(*r, f"k{i}", i, [], {"a": i}) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, spans array<int>, _row map<string,int>")
