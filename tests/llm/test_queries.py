"""The registered queries next to their SQL, and the result columns of the contract."""

import duckdb
import pytest

from cohortlens.llm import queries

TABLES = ["documents", "pages", "benchmark", "labels", "embeddings"]


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, engine, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = [tuple(row[c] for c in columns) for row in frame.collect()]
    answer = engine.sql(queries.ORACLES[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    theirs = [tuple(row[i] for i in places) for row in answer.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(mine, key=key) == sorted(theirs, key=key)
    assert len(mine) > 0


def test_there_is_a_query_per_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_every_other_query_has_no_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {
        "op1_decontamination", "op3_toxicity", "op6_licenses", "op7_suffix_tree", "op8_language_id", "op9_sentencepiece",
        "op12_byte_bpe",
    }
