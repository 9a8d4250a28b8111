"""Given covariances, variances per model and the profile of the criterion, against the search and dense solutions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import dense
from cohortlens.functions.stats import chi_square_upper, mixture_upper
from cohortlens.operators import fit_tables, mixed
from cohortlens.operators.cells import cells
from cohortlens.operators.profile import fit_candidates, search_profile, variance_profile
from cohortlens.operators.residuals import residual_quantiles
from test_mixed import records


@pytest.fixture(scope="module")
def data():
    return dense.simulate(units=14, levels=3, rows=3000, seed=5)


@pytest.fixture(scope="module")
def counted(spark, data):
    return cells(records(spark, *data)).cache()


def test_search_and_profile_agree(counted):
    found = mixed.fit_mixed_logit(counted, random="intercept", tol=1e-13).models["model"]
    profile = search_profile(counted, random="intercept")
    assert profile.enclosed
    assert profile.variance == pytest.approx(found.covariance[0, 0], rel=1e-5)
    assert profile.best.log_lik == pytest.approx(found.log_lik, abs=1e-8)
    assert profile.best.level_coef == pytest.approx(found.level_coef, rel=1e-5, abs=1e-6)
    heights = [r["log_lik"] for r in profile.table.orderBy("variance").collect()]
    top = int(np.argmax(heights))
    assert all(np.diff(heights[: top + 1]) > -1e-9) and all(np.diff(heights[top:]) < 1e-9)


def test_slope_is_the_derivative_of_the_profile(counted):
    v, step = 0.3, 1e-3
    rows = variance_profile(counted, [v * math.exp(-step), v, v * math.exp(step)], random="level").orderBy("variance").collect()
    assert rows[1]["slope"] == pytest.approx((rows[2]["log_lik"] - rows[0]["log_lik"]) / (2 * step), rel=1e-4)


def test_a_profile_without_unit_effects_ends_at_zero(spark):
    rng = np.random.default_rng(1)
    unit, saps = rng.integers(0, 30, 4000), rng.integers(20, 100, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(saps - 60) / 20))).astype(int)
    counted = cells(records(spark, unit, np.zeros(4000, int), saps, y))
    profile = search_profile(counted)
    searched = mixed.fit_mixed_logit(counted, random="intercept").models["model"]
    assert profile.variance == pytest.approx(searched.covariance[0, 0], abs=1e-4)
    assert profile.best.log_lik >= searched.log_lik - 1e-6


def test_candidates_carry_their_own_solutions(counted):
    together = fit_candidates(counted, [0.05, 0.5]).models
    for name, v in (("v000", 0.05), ("v001", 0.5)):
        alone = mixed.fit_mixed_logit(counted, random="intercept", variance=v).models["model"]
        assert together[name].log_lik == pytest.approx(alone.log_lik, abs=1e-9)
        assert together[name].level_cov == pytest.approx(alone.level_cov, rel=1e-8)


@pytest.mark.parametrize("fixed, random", [("interaction", "intercept"), ("additive", "level"), ("interaction", "level")])
def test_given_covariance_against_a_dense_solution(counted, data, fixed, random):
    unit, level, saps, y = data
    x, z, q = dense.design(unit, level, (saps - 60) / 20, 14, 3, fixed, random)
    sigma = np.array([[0.5, 0.2, 0.1], [0.2, 0.4, 0.0], [0.1, 0.0, 0.3]]) if q > 1 else np.array([[0.4]])
    value, beta, vcov, _ = dense.solve(x, z, np.ones(len(y)), y, np.linalg.cholesky(sigma), 14)
    model = mixed.fit_mixed_logit(counted, fixed=fixed, random=random, covariance=sigma).models["model"]
    assert model.converged and model.given and model.covariance == pytest.approx(sigma)
    assert -2 * model.log_lik == pytest.approx(value, abs=1e-7)


def test_variances_by_model(counted):
    designs = {"a": ("interaction", "level"), "b": ("interaction", "level"), "c": ("interaction", "intercept")}
    fit = mixed.fit_mixed_logit(counted, designs=designs, variance={"a": 0.1, "b": 0.7})
    assert [fit.models[m].given for m in "abc"] == [True, True, False]
    for name, v in (("a", 0.1), ("b", 0.7)):
        alone = mixed.fit_mixed_logit(counted, variance=v).models["model"]
        assert fit.models[name].log_lik == pytest.approx(alone.log_lik, abs=1e-9)
    searched = mixed.fit_mixed_logit(counted, random="intercept").models["model"]
    assert fit.models["c"].log_lik == pytest.approx(searched.log_lik, abs=1e-6)


def test_given_covariances_are_checked(counted):
    for bad in (np.eye(2), np.array([[1, 2, 0], [0, 1, 0], [0, 0, 1.0]]), np.diag([1.0, -1.0, 1.0])):
        with pytest.raises(ValueError):
            mixed.fit_mixed_logit(counted, covariance=bad)
    with pytest.raises(ValueError, match="variance cannot"):
        mixed.fit_mixed_logit(counted, variance=-1.0)
    with pytest.raises(ValueError, match="not both"):
        mixed.fit_mixed_logit(counted, variance=1.0, covariance=np.eye(3))
    with pytest.raises(ValueError, match="two positive"):
        search_profile(counted, grid=[0.0, 1.0])


def test_zero_and_singular_covariances(counted):
    plain = mixed.fit_mixed_logit(counted, random="none").models["model"]
    assert mixed.fit_mixed_logit(counted, variance=0.0).models["model"].log_lik == pytest.approx(plain.log_lik, abs=1e-8)
    shared = mixed.fit_mixed_logit(counted, covariance=np.full((3, 3), 0.4))
    one = mixed.fit_mixed_logit(counted, random="intercept", variance=0.4).models["model"]
    assert shared.models["model"].log_lik == pytest.approx(one.log_lik, abs=1e-8)
    # on the edge of the space of covariances there are no errors
    assert {r["std_error"] for r in fit_tables.varcomp_table(shared).collect()} == {None}


def test_errors_of_variances_follow_the_change_of_basis(counted):
    sigma = np.array([[0.5, 0.2, 0.1], [0.2, 0.4, 0.0], [0.1, 0.0, 0.3]])
    fit = mixed.fit_mixed_logit(counted, covariance=sigma)
    spread = np.linalg.inv(fit.models["model"].fisher)
    rows = {(r["var1"], r["var2"]): (r["vcov"], r["std_error"]) for r in fit_tables.varcomp_table(fit).collect()}
    names = ["(Intercept)", "adm_yearL1", "adm_yearL2"]
    assert rows[names[0], None] == pytest.approx((0.5, math.sqrt(spread[0, 0])))
    # variance of the difference of the second and the first effect: s11 - 2 s10 + s00; triangle order 00, 10, 11
    weights = np.array([1.0, -2.0, 1.0, 0, 0, 0])
    assert rows[names[1], None] == pytest.approx((0.5, math.sqrt(weights @ spread @ weights)))
    weights = np.array([-1.0, 1.0, 0, 0, 0, 0])
    assert rows[names[0], names[1]] == pytest.approx((-0.3, math.sqrt(weights @ spread @ weights)))


def test_unfinished_fits_are_refused_by_every_table(spark, data):
    """A level without deaths is no excuse for the others."""
    unit, level, saps, y = data
    counted = cells(records(spark, unit, level, saps, np.where(level == 1, 0, y)))
    fit = mixed.fit_mixed_logit(counted, max_passes=2)
    assert fit.models["model"].runaway and not fit.models["model"].converged
    tables = [fit_tables.level_estimates, fit_tables.coef_table, fit_tables.varcomp_table, fit_tables.effect_correlations,
              mixed.fitted_totals, residual_quantiles]
    for table in tables:
        with pytest.raises(ValueError, match="not converged"):
            table(fit)
        table(fit, allow_unfinished=True)


def test_runaway_levels_have_no_coefficients(spark, data):
    unit, level, saps, y = data
    fit = mixed.fit_mixed_logit(cells(records(spark, unit, level, saps, np.where(level == 1, 0, y))), random="none")
    rows = {r["term"]: (r["estimate"], r["std_error"], r["p_value"]) for r in fit_tables.coef_table(fit).collect()}
    lost = {t for t, values in rows.items() if values == (None, None, None)}
    assert lost == {"adm_yearL1", "saps:adm_yearL1"}
    assert all(r["correlation"] is None for r in fit_tables.effect_correlations(fit).where("term like '%L1'").collect())


def test_mixture_of_chi_squares(spark):
    """One more variance beside r free covariances: half and half; binomial weights for more; a point at zero for no degrees."""
    rows = spark.createDataFrame([(0.0, 0, 1), (2.706, 0, 1), (3.3, 1, 1), (5.0, 3, 2), (4.0, 2, 0)], "x double, free int, edges int")
    tails = rows.select(
        "x", "free", "edges", mixture_upper(F.col("x"), F.col("free"), F.col("edges"), 2).alias("mixed"),
        *[chi_square_upper(F.col("x"), F.lit(d)).alias(f"t{d}") for d in range(1, 6)],
    ).collect()
    assert tails[0]["mixed"] == pytest.approx(1.0)
    assert tails[1]["mixed"] == pytest.approx(0.05, abs=2e-5)
    assert tails[2]["mixed"] == pytest.approx((tails[2]["t1"] + tails[2]["t2"]) / 2)
    assert tails[3]["mixed"] == pytest.approx((tails[3]["t3"] + 2 * tails[3]["t4"] + tails[3]["t5"]) / 4)
    assert tails[4]["mixed"] == pytest.approx(tails[4]["t2"])


def test_scaled_residuals_of_a_mixed_fit(spark, counted, data):
    fit = mixed.fit_mixed_logit(counted, random="intercept", variance=0.4)
    eta = {(r["unit"], r["lev"], r["saps"]): r["eta"] for r in mixed.with_linear_predictor(fit).collect()}
    unit, level, saps, y = data
    place = {name: i for i, name in enumerate(fit.level_names)}
    mu = np.array([1 / (1 + math.exp(-eta[str(u), place[f"L{g}"], s])) for u, g, s in zip(unit, level, saps)])
    residuals = (y - mu) / np.sqrt(mu * (1 - mu))
    for row in residual_quantiles(fit).collect():
        assert row["quantile"] == pytest.approx(np.quantile(residuals, row["probability"]), abs=1e-9)
