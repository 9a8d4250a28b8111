"""Small documents with the awkward cases every operator has to stand."""

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, row bigint, n int, component_id string"


def make(spark, rows, ddl=DDL):
    """Rows of (doc_id, text[, lang]) with columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 7, 1, "y") for r in rows]
    return spark.createDataFrame(full, ddl)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in any column, empty, blank and very long texts, repeated rows, an id with two texts."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    same = "the same text of some words that comes twice in this table as it is"
    return docs_of([
        (1, None), (2, ""), (3, " \t\n "), (4, long_text), (5, same), (5, same), (6, same), (7, "one"), (8, "two words"),
        (9, "first text of nine"), (9, "second text of nine"), (None, "a text without an id"), (None, None), (10, "x" * 50_000),
        (11, "ünïcode ßtrasse 中文 😀 end\nnext line\n\n"),
    ])


@pytest.fixture(scope="session")
def nothing(docs_of, spark):
    return docs_of([(1, "x")]).where("doc_id < 0")
