import pytest

# columns that are called like the operators' own
CLASHES = ["id", "k1", "k2", "fp", "n", "n_words", "ids", "n_tokens", "words", "bucket", "pos", "h", "first", "spans", "kept", "class_id", "ln", "removed", "text_", "__t"]

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak near the river bank"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE, None), (3, None, "en"), (4, "", "de"), (None, PROSE + " once", "en"), (None, None, None),
        (5, long, "en"), (6, "a" * 50_000, "en"), (7, "\n\n \t\n", "fr"), (8, "one two three", "en"), (9, "one two three", "en"), (1, "another text of the same id", "en"),
        (10, "ça va 日本語 🙂   " + PROSE.upper(), "fr"), (11, "9" * 3000 + "@" * 50 + "+1" * 100, "en"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, g, None, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, g in rows], schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (5, None, 0), (99, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
