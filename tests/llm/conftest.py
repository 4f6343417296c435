import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, kept string, n_words string, _key string"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """The small table's texts by id."""
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def table(spark):
    """Makes a table from (doc_id, text) pairs; the other columns clash with the operators' results."""

    def make(pairs):
        rows = [(i, t, None if k % 3 else "en", None if k % 4 else "src", "x", "x", "x", "x") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


LONG = "lorem ipsum dolor sit amet " * 12_000
ODD_PAIRS = [
    (None, "A text without an id, of some words and more words than five"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One two three four five six seven eight nine ten eleven twelve"),
    (4, "One two three four five six seven eight nine ten eleven twelve"),
    (5, "one TWO three four five six seven eight nine ten eleven twelve"),
    (6, LONG),
    (7, "x" * 200_000),
    (8, "é" * 50_000),
    (9, "short"),
    (10, "7"),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD_PAIRS)


@pytest.fixture(scope="session")
def nothing(table):
    return table([]).limit(0)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
