import datetime
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.dates import week_of_year_blocks
from cohortlens.functions.stats import chi_square_upper, normal_lower, normal_upper, tukey_upper, two_sided_p
from cohortlens.functions.text import number_text, percent_text, ratio_text, round_columns
from cohortlens.operators.season import period_label


def test_normal_tails_against_erfc(spark):
    xs = [i / 7 for i in range(-60, 61)] + [2.9999999, 3.0, 3.0000001, 15.0, 30.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", normal_upper(F.col("x")).alias("up"), normal_lower(F.col("x")).alias("low"), two_sided_p(F.col("x")).alias("p")
    ).collect()
    for row in rows:
        exact = math.erfc(row.x / math.sqrt(2)) / 2
        assert row.up == pytest.approx(exact, rel=1e-12)
        assert row.low == pytest.approx(math.erfc(-row.x / math.sqrt(2)) / 2, rel=1e-12)
        assert row.p == pytest.approx(math.erfc(abs(row.x) / math.sqrt(2)), rel=1e-12)


def test_tukey_published_points(spark):
    points = [(3.314, 3), (3.858, 5), (4.474, 10)]
    rows = spark.createDataFrame(points, "q double, k int").select(tukey_upper(F.col("q"), F.col("k")).alias("p")).collect()
    assert [round(row.p, 4) for row in rows] == [0.05, 0.05, 0.05]


def test_tukey_with_two_groups_is_the_plain_test(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.0, 5.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(
        tukey_upper(F.col("z") * math.sqrt(2), F.lit(2)).alias("tukey"), two_sided_p(F.col("z")).alias("plain")
    ).collect()
    for row in rows:
        assert row.tukey == pytest.approx(row.plain, abs=1e-12)


def test_chi_square_tail(spark):
    def exact(x, df):   # trapezoid rule on the density in sqrt(x)
        steps = 200_000
        top = math.sqrt(x) + 40
        low = math.sqrt(x)
        total = 0.0
        for i in range(steps + 1):
            t = low + (top - low) * i / steps
            value = math.exp((df - 1) * math.log(t) - t * t / 2 - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2)) if t else 0
            total += value * (0.5 if i in (0, steps) else 1)
        return total * (top - low) / steps

    cases = [(0.5, 1), (3.84, 1), (2.0, 2), (7.8, 3), (1.0, 4), (60.0, 54), (80.0, 55)]
    rows = spark.createDataFrame(cases, "x double, df int").select(
        "x", "df", chi_square_upper(F.col("x"), F.col("df")).alias("p")
    ).collect()
    for row in rows:
        assert row.p == pytest.approx(exact(row.x, row.df), rel=1e-7)


# date, week, period with 2020 as the last year
EDGES = [
    ("2019-12-31", 53, "2019"), ("2020-01-01", 1, "before"), ("2020-01-07", 1, "before"), ("2020-01-08", 2, "before"),
    ("2020-03-10", 10, "before"), ("2020-03-11", 11, "peak1"), ("2020-06-16", 24, "peak1"), ("2020-06-17", 25, "peak2"),
    ("2020-06-23", 25, "peak2"), ("2020-06-24", 26, "plateau"), ("2020-10-13", 41, "plateau"), ("2020-10-14", 42, "peak2"),
    ("2020-12-30", 53, "peak2"), ("2020-12-31", 53, "peak2"),
]


def test_week_and_period_edges(spark):
    rows = [(datetime.date.fromisoformat(d), d[:4], w, p) for d, w, p in EDGES]
    df = spark.createDataFrame(rows, "d date, year string, week int, period string").withColumn(
        "found_week", week_of_year_blocks("d")
    ).withColumn("found", period_label(F.col("year"), F.col("found_week"), "2020")).withColumn(
        "closed", period_label(F.col("year"), F.col("found_week"), "2020", gap_week="plateau")
    )
    for row in df.collect():
        assert row.found_week == row.week
        assert row.found == row.period
        assert row.closed == ("plateau" if row.week == 25 else row.period)


def test_missing_week_only_blanks_the_last_year(spark):
    df = spark.createDataFrame([("2020", None), ("2019", None), (None, 3)], "year string, week int")
    found = [row.p for row in df.select(period_label(F.col("year"), F.col("week"), "2020").alias("p")).collect()]
    assert found == [None, "2019", None]


def test_number_text(spark):
    values = [1.0, 10.0, 0.25, 100.0, 0.0, -0.0001, 1.5, float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(number_text(F.col("x")).alias("t")).collect()
    assert [row.t for row in rows] == ["1", "10", "0.25", "100", "0", "0", "1.5", "Inf", "NA"]


def test_round_half_even_and_texts(spark):
    df = spark.createDataFrame([(0.0625, "0.1875")], "a double, b string")
    assert round_columns(df).collect()[0] == (0.062, 0.188)
    row = spark.createDataFrame([(1.0, 0.5, 2.125, 0.256)], "r double, l double, u double, p double").select(
        ratio_text(F.col("r"), F.col("l"), F.col("u")).alias("t"), percent_text(F.col("p")).alias("p")
    ).collect()[0]
    assert row.t == "1 [0.5-2.125]" and row.p == "26%"
