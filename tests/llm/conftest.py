import random

import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, "no  letters 123 !!"), (7, "😀 ²"), (8, "one two three four five six seven eight nine ten"),
    (9, "one two three four five six seven eight nine ten"), (10, "\n\t x   y\n \nz"), (11, "<|endoftext|> <s> </s>"), (12, "word " * 40_000), (13, "x" * 150_000),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators might use themselves."""
    extra = "_id string, _text string, _hash string, fp string, rep string, key string, keep_id string, kept string, score string, lang string, ids string, _kept_id string, batch string"
    rows = [(i, t, *["?"] * 13) for i, t in AWKWARD]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture
def rng():
    return random.Random(7)
