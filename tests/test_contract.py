"""The query catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

MIXED = {
    "fit_mixed_score", "fit_coef", "varcomp", "fit_stats", "compare_fits", "predict_grid", "figure_grid", "marginal_means",
    "year_contrasts", "year_or", "year_or_report", "subgroup_or", "season_or",
}


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for table in ("lineitem", "orders"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [name for name in contract.catalog.QUERIES if name not in MIXED])
def test_query_equals_sql(spark, sf_dir, engine, name):
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = [tuple(row[c] for c in columns) for row in frame.collect()]
    answer = engine.sql(contract.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    theirs = [tuple(row[i] for i in places) for row in answer.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine.sort(key=key)
    theirs.sort(key=key)
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs):
        assert all(x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y) for x, y in zip(a, b))


def test_every_sql_text_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.catalog.QUERIES) - set(contract.oracle.ORACLES) == MIXED - {"fit_mixed_score"}


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 36
