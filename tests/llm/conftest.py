import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, uid string, fp string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with the operators' own."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog of the house", "en", "a", 10, "s", "l", "u", "f"),
        (2, "the quick brown fox jumps over the lazy dog of the house", "en", "a", 10, "s", "l", "u", "f"),
        (2, "the quick brown fox jumps over the lazy dog of the house", "en", "a", 10, "s", "l", "u", "f"),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None, None, None),
        (5, " \n\t ", "fr", "b", 4, None, None, None, None),
        (6, long, "en", "c", len(long), None, None, None, None),
        (7, "12345 !!! ###", None, "c", 13, None, None, None, None),
        (8, "el perro de la casa y los gatos que por la noche", "es", "c", 50, None, None, None, None),
        (9, "le chien est dans la maison avec les chats et des oiseaux", "fr", "c", 50, None, None, None, None),
        (10, "ΑΒΓ δεζ 日本語 ́x İstanbul", None, "c", 20, None, None, None, None),
        (None, "a text without an id of its own", "en", None, 30, None, None, None, None),
        (11, "the quick brown fox jumps over the lazy dog of the housE", "en", "a", 10, None, None, None, None),
        (12, "short", "en", "a", 5, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
