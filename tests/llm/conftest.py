import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, h int, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing columns."""
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed my jug"
    rows = [
        (1, base, "en", "a", 80),
        (2, base.upper(), "en", "a", 80),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, "  \n\t ", "en", "b", 5),
        (6, long_text, "en", "b", len(long_text)),
        (7, base, "en", "a", 80),
        (7, base, "en", "a", 80),
        (None, base, "en", "a", 80),
        (8, "É" + base + " ünïcødé    x", "fr", "b", 90),
        (9, "one two", "en", "b", 7),
        (10, "line one is here\nline one is here\n\nother", "en", "b", 40),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def brute_texts(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.collect()]
