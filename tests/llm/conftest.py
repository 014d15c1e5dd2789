import pytest

from .helpers import doc, frame


@pytest.fixture(scope="session")
def edge_texts():
    """NULL, empty, blank, very short, very long and repeated texts, non-ASCII and odd characters."""
    words = " ".join(f"w{i % 97} Déjà x{i}" for i in range(40_000))
    return [None, "", " \t\n", "one", "one", "Two words", "a b c d", "A B C D", words, words,
            "\x00\x0b é ü 😀", "same " * 300]


@pytest.fixture(scope="session")
def edge_rows(edge_texts):
    rows = [doc(i, t, [None, "a", "b"][i % 3]) for i, t in enumerate(edge_texts)]
    return rows + [rows[8], doc(None, None, None), doc(None, "null id", "c")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
