import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, node string, _g string, part int, grp string, kept string, score string, _key long, _n string, _m int, _p string, _doc string, _text string, _i int, _at string, _head string, _starts string, row string, rest string, id long"
LONG = " ".join(f"w{k % 977} x{k % 13}." for k in range(30_000))


def rows(*pairs):
    """Documents of (doc_id, text, source), with extra columns whose names operators use themselves."""
    return [(i, t, "en", s, len(t or ""), 1, "h", "n", "g", 2, "p", "k", "s", 11, "n", 12, "p", "d", "t", 13, "at", "head", "starts", "row", "rest", 14) for i, t, s in pairs]


EDGE = rows(
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "a text without an id. It has two sentences.", "b"),
    (5, "one two three four five six. seven eight nine ten! eleven twelve\nthirteen", "b"), (6, "one two three four five six. seven eight nine ten! eleven twelve\nthirteen", "c"),
    (6, "one two three four five six. seven eight nine ten! eleven twelve\nthirteen", "c"), (7, "short", "c"), (8, "short", None), (9, LONG, "d"), (10, "Ünïcode \u2581 漢字 😀 </s> \\l [INST]", "d"),
)


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def frame(spark):
    return lambda *pairs: spark.createDataFrame(rows(*pairs), SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
