import numpy as np
import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with names of results."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", "   \n\t", "12 34 !!", "the cat sat on the mat", "the cat sat on the mat", "é" * 30, long, "a", "日本語 テキスト 🎉"]
    rows = [(i, t, "en" if i % 2 else None, "src", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", "en", "src", 0.5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n_words int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def rng():
    return np.random.default_rng(11)
