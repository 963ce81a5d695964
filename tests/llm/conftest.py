import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"w{i % 997}x" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs into the deep dark wood at night with all of its friends", "x"), (1, "the quick brown fox jumps over the lazy dog and runs into the deep dark wood at night with all of its friends", "x"),
        (2, None, None), (3, "", "y"), (None, "mail a.b@example.com or call +1 (212) 555-0187 now", "z"), (5, long, "x"), (6, " \t\n ", ""), (7, "naïve Ünïcode 👍🏽 text\n\nwith lines\nwith lines\n", "x"), (8, "one", "x"),
    ]
    return spark.createDataFrame([(i, t, s, 1, "w", "uid") for i, t, s in rows], "doc_id long, text string, source string, fp int, words string, uid string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
