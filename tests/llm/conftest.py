"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_tokens long, token_ids string, "
          "secrets string, kept string, key string, bands string, licenses string, file string, word string, n string, host string")
LONG = "palabra " * 3 + " ".join(f"w{i % 5000}" for i in range(60_000)) + " token = \"abcdef012345\" " + "f" * 300


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, len(text) if text is not None else None, 1, "t", "s", "k", "y", "b", "l", "f", "w", "n", "h")


EDGES = [
    row(1, None), row(2, ""), row(3, " \n\t"), row(4, "One two three"), row(5, "One two three"),
    row(5, "One two three"), row(None, "One two three"), row(None, None, None), row(6, "été Ünï 一二  x", None),
    row(7, LONG), row(8, LONG), row(9, "Released under the MIT License."), row(10, "<|endoftext|> a\x00b"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
