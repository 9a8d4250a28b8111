"""Places, running totals, quantiles and file positions without a single task or a collected table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.cohort import used_levels
from cohortlens.operators.ranking import numbered, numbered_with_total, running_totals
from cohortlens.operators.residuals import weighted_quantiles
from cohortlens.sources.positions import bind_file_position, read_with_position


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_total_order(spark):
    rows = spark.range(5000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(5000))).withColumn("idx", F.lit("old"))
    found, total = numbered_with_total(rows, [F.col("k").desc()])
    assert total == 5000 and found.columns == ["id", "k", "idx"]
    assert [r["idx"] for r in found.orderBy(F.col("k").desc()).collect()] == list(range(1, 5001))


def test_places_with_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None,), (3,), (1,), (3,), (None,)], "k int")
    assert sorted((r["k"] or 0, r["idx"]) for r in numbered(rows, ["k"]).collect()) == [(0, 1), (0, 2), (1, 3), (3, 4), (3, 5)]
    assert numbered(rows.where("k > 9"), ["k"]).count() == 0
    with pytest.raises(Exception, match="table: k is not unique"):
        numbered(rows, ["k"], unique="table")
    assert numbered(rows.distinct(), ["k"], unique="table").count() == 3


def test_uniqueness_needs_no_exchange_of_its_own(spark, monkeypatch):
    seen = []
    import cohortlens.operators.ranking as ranking

    whole = ranking._sorted_rows
    monkeypatch.setattr(ranking, "_sorted_rows", lambda df, order, check=None: seen.append(
        plan(df.orderBy(*order).where(check))) or whole(df, order, check))
    numbered(spark.range(100).withColumn("k", -F.col("id")), ["k"], unique="table")
    assert seen[0].count("Exchange") == 1


def test_levels_are_numbered_by_many_tasks(spark):
    levels = used_levels(spark.range(3000).withColumn("unit", F.col("id") % 700), "unit")
    assert "SinglePartition" not in plan(levels) and "Window" not in plan(levels)
    rows = levels.orderBy("idx").collect()
    assert [r["level"] for r in rows] == sorted(str(i) for i in range(700))
    assert [r["idx"] for r in rows] == list(range(1, 701)) and levels.schema["idx"].dataType.simpleString() == "int"


def test_running_totals(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("w"))
    found, total = running_totals(rows, ["id"], "w")
    want = np.cumsum(np.arange(3000) % 7)
    assert total == want[-1] and [r["upto"] for r in found.orderBy("id").collect()] == want.tolist()


@pytest.mark.parametrize("probabilities", [(0.0, 0.25, 0.5, 0.75, 1.0), (0.1, 0.333, 0.999)])
def test_quantiles_are_those_of_the_repeated_values(spark, probabilities):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 2 else "xy"[i % 3], float(rng.integers(-40, 40)) / 8, int(rng.integers(0, 60))) for i in range(900)]
    rows += [("x", None, 5), ("x", 2.5, 0), ("z", None, 3), ("one", 1.5, 1)]
    df = spark.createDataFrame(rows, "model string, value double, n int")
    got = {(r["model"], r["probability"]): r["quantile"] for r in weighted_quantiles(df, "value", "n", probabilities).collect()}
    for name in (None, "x", "y", "one"):
        values = np.repeat(*zip(*[(v, n) for m, v, n in rows if m == name and v is not None]))
        for p in probabilities:
            assert got.pop((name, p)) == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert not got
    assert weighted_quantiles(df.where("n > 100"), "value", "n").count() == 0


@pytest.fixture
def saved(spark, tmp_path):
    left, right = str(tmp_path / "left"), str(tmp_path / "right")
    spark.range(1000).withColumn("pos", F.lit("x")).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(left)
    spark.range(1000).select((F.col("id") * 3).alias("d")).repartitionByRange(4, "d").sortWithinPartitions("d").write.parquet(right)
    return left, right


def test_positions_of_files(spark, saved):
    rows, total = read_with_position(spark, saved[0], ["id"])
    assert total == 1000 and all(r["id"] == r["pos"] for r in rows.collect())
    replaced, _ = read_with_position(spark, saved[0])
    assert replaced.columns == ["id", "pos"] and replaced.agg(F.sum("pos")).first()[0] == 499_500


def test_bind_by_file_position(spark, saved, tmp_path):
    bound = bind_file_position(spark, *saved, "d", "date")
    assert bound.columns == ["id", "pos", "date"] and bound.where("date = 3 * id").count() == 1000
    bound.collect()
    # one exchange per side beside the broadcast list of files
    assert plan(bound).split("== Initial Plan ==")[0].count("Exchange hashpartitioning(_position") in (0, 2)
    shorter = str(tmp_path / "shorter")
    spark.range(10).withColumn("d", F.col("id")).write.parquet(shorter)
    with pytest.raises(ValueError, match="differ in length"):
        bind_file_position(spark, saved[0], shorter, "d", "date")


def test_bind_of_empty_tables(spark, tmp_path):
    empty = str(tmp_path / "empty")
    spark.range(0).withColumn("d", F.col("id")).write.parquet(empty)
    assert bind_file_position(spark, empty, empty, "d", "date").count() == 0
