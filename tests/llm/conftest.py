import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_Words string, fp int"


@pytest.fixture(scope="session", autouse=True)
def _package(spark):
    from hydrospark.llm.shared import importable

    importable(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs, with nulls elsewhere and columns whose names clash."""
    def make(*rows):
        return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Distinct running words: words(3, 6) is 'w3 w4 w5'."""
    return lambda a, b: " ".join(f"w{i}" for i in range(a, b))
