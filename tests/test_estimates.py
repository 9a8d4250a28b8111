import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import estimates as est
from cohortlens.operators.report import or_report


@pytest.fixture(scope="module")
def two_levels(spark):
    counts = spark.createDataFrame(
        [("m", 50, "A", 1, 100, 40), ("m", 50, "B", 2, 100, 20)],
        "model string, saps int, level string, idx int, n bigint, k bigint",
    )
    return est.closed_form_means(counts)


def test_closed_contrast(two_levels):
    row = est.contrasts(two_levels).collect()[0]
    assert row.contrast == "A / B"
    assert row.log_or == pytest.approx(math.log(8 / 3))
    assert row.se_log == pytest.approx(math.sqrt(1 / 40 + 1 / 60 + 1 / 20 + 1 / 80))
    assert row.se == pytest.approx(0.860663, abs=1e-6)
    back = est.contrasts(two_levels, reverse=True).collect()[0]
    assert back.contrast == "B / A" and back.odds_ratio == pytest.approx(0.375)


def test_or_table_both_interval_modes(two_levels):
    compared = est.adjust(est.contrasts(two_levels), "none")
    right = est.or_table(compared).collect()[0]
    assert right.or_direction == "B / A" and right.contrast == "A / B"
    assert right.odds_ratio == pytest.approx(0.375)
    assert (round(right.lower, 4), round(right.upper, 4)) == (0.1992, 0.7059)
    old = est.or_table(compared, se_scale="ratio").collect()[0]
    assert (round(old.lower, 4), round(old.upper, 4)) == (0.0694, 2.0260)
    straight = est.or_table(compared, invert=False).collect()[0]
    assert straight.or_direction == "A / B" and straight.odds_ratio == pytest.approx(8 / 3)
    with pytest.raises(ValueError):
        est.or_table(compared, se_scale="both")


def test_filter_after_adjustment_keeps_the_family(spark):
    rows = [("m", s, f"L{i}", i, 200, 40 + 7 * i + s) for s in (1, 2) for i in range(1, 6)]
    means = est.closed_form_means(
        spark.createDataFrame(rows, "model string, saps int, level string, idx int, n bigint, k bigint")
    )
    compared = est.contrasts(means)
    assert compared.count() == 20
    kept = est.vs_reference(est.adjust(compared, "bonferroni"), "L5").collect()
    plain = {(r.saps, r.contrast): r.p_value for r in est.adjust(compared, "none").collect()}
    assert len(kept) == 8 and all(row.family == 5 for row in kept)
    for row in kept:
        assert row.p_value == pytest.approx(min(1.0, 10 * plain[row.saps, row.contrast]))
    middle = est.vs_reference(compared, "L3", side="either").collect()
    assert {r.contrast for r in middle} == {"L1 / L3", "L2 / L3", "L3 / L4", "L3 / L5"}


def test_level_without_deaths_has_no_estimate_but_counts_in_the_family(spark):
    counts = spark.createDataFrame(
        [("m", 1, "A", 1, 10, 0), ("m", 1, "B", 2, 10, 5), ("m", 1, "C", 3, 10, 10)],
        "model string, saps int, level string, idx int, n bigint, k bigint",
    )
    means = est.closed_form_means(counts)
    assert {row.level: row.eta for row in means.collect()} == {"A": None, "B": 0.0, "C": None}
    for method in ("none", "bonferroni", "tukey"):
        pairs = est.adjust(est.contrasts(means), method).collect()
        assert len(pairs) == 3 and all(row.family == 3 and row.odds_ratio is None and row.p_value is None for row in pairs)
    known = counts.unionByName(counts.where("level = 'B'").selectExpr("model", "saps", "'D' AS level", "4 AS idx", "n", "k - 2 AS k"))
    row = est.adjust(est.contrasts(est.closed_form_means(known)), "bonferroni").where("contrast = 'B / D'").first()
    plain = est.adjust(est.contrasts(est.closed_form_means(known)), "none").where("contrast = 'B / D'").first()
    assert row.p_value == pytest.approx(min(1, 6 * plain.p_value))


def test_covariances_enter_predictions_and_contrasts(spark):
    coef = spark.createDataFrame([("m", "A", 1, -3.0, 0.04), ("m", "B", 2, -2.5, 0.03)],
                                 "model string, level string, idx int, a double, c double")
    v = {(1, 1): (0.04, -0.0005, -0.0005, 0.00001), (2, 2): (0.05, -0.0006, -0.0006, 0.00002),
         (1, 2): (0.01, -0.0001, -0.0002, 0.000003), (2, 1): (0.01, -0.0002, -0.0001, 0.000003)}
    cov = spark.createDataFrame([("m", i, j, *x) for (i, j), x in v.items()],
                                "model string, idx_a int, idx_b int, v_aa double, v_ac double, v_ca double, v_cc double")
    s = 40
    var = {key: x[0] + (x[1] + x[2]) * s + x[3] * s * s for key, x in v.items()}
    means = est.linear_predictor(coef, cov, [s])
    row = est.contrasts(means, cov).collect()[0]
    assert row.log_or == pytest.approx(-0.5 + 0.01 * s)
    assert row.se_log == pytest.approx(math.sqrt(var[1, 1] + var[2, 2] - 2 * var[1, 2]))
    a = est.predict_grid(coef, cov, [s], z=1.96).where(F.col("group") == "A").collect()[0]
    eta, se = -3.0 + 0.04 * s, math.sqrt(var[1, 1])
    p = 1 / (1 + math.exp(-eta))
    assert a.predicted == pytest.approx(p) and a.std_error == pytest.approx(se)
    assert a.conf_low == pytest.approx(1 / (1 + math.exp(-(eta - 1.96 * se))))
    assert a.conf_high == pytest.approx(1 / (1 + math.exp(-(eta + 1.96 * se))))
    m = est.marginal_means(means).where(F.col("level") == "A").collect()[0]
    assert m.se == pytest.approx(p * (1 - p) * se)
    full = est.predict_grid(coef, cov)
    assert full.count() == 71 * 2
    assert est.figure_grid(full, ["B"]).count() == 71


def test_report(spark):
    ors = spark.createDataFrame(
        [("m", 30, 1, 3, 1.0, 0.5004, 2.12561, 0.04996), ("m", 20, 2, 3, 0.98765, 0.9, 1.1, 1.0)],
        "model string, saps int, idx_a int, idx_b int, odds_ratio double, lower double, upper double, p_value double",
    )
    rows = [tuple(row) for row in or_report(ors).collect()]
    assert rows == [(20.0, "0.988 [0.9-1.1]", 1.0), (30.0, "1 [0.5-2.126]", 0.05)]


def test_pairs_join_is_an_equality_join(spark, two_levels):
    plan = est.level_pairs(two_levels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
