import pytest
from llm_helpers import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """A table of odd rows with columns whose names clash with what operators use inside."""
    rows = [(d, t, lang, source, len(t or ""), 0, "x", 1.5) for d, t, lang, source in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, id double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
