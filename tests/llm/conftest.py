import pytest

#: Null and empty texts, repeated rows, ties, a null id, white space of all kinds, a text of one long word.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old mill by the river", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old mill by the river", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old mill by the river", "en", "a"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (6, "one two", "de", "b"),
    (7, "two one", "de", "b"),
    (None, "one two", None, None),
    (8, "x" * 5000, "fr", "c"),
    (9, " ".join(f"w{i}" for i in range(3000)), "fr", "c"),
    (10, " ".join(f"w{i}" for i in range(3000)) + " tail", "fr", None),
    (11, "line one is here\nline one is here\nother é ü 漢字 🎈 line\n\n  \nline one is here", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, doc string, size long, id long, bucket string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "clash", 2, 3, "clash") for r in ROWS], SCHEMA)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture
def rows():
    return ROWS
