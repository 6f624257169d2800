import pytest

from touchline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[2]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, a repeated row, and a clashing column name."""
    base = " ".join(f"word{i * 7 % 101}" for i in range(120))
    near = base.replace("word14", "other")
    rows = [(1, base, "a"), (2, base, "b"), (3, near, "a"), (4, "", "a"), (5, None, None), (6, "one", "c"), (7, "  \t\n ", "c"),
            (8, "one two three four", "b"), (9, "x " * 30000, "a"), (None, base, "a"), (11, "ÄÖ ß İ Don't 12,5 日本", "b"),
            (12, "tail. " + base[:400], "d"), (12, "tail. " + base[:400], "d"), (14, "A\nB\nC\nD\nA\nB\nC\nD", None)]
    return spark.createDataFrame([(i, t, s, 0, -1) for i, t, s in rows],
                                 "doc_id long, text string, source string, n_words long, score int")
