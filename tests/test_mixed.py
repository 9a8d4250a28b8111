import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import dense
from cohortlens.operators import estimates as est
from cohortlens.operators import fit_tables, mixed
from cohortlens.operators.cells import cells
from cohortlens.operators.unit_algebra import Design, Search, unit_contributions, unpack, updated_effects


def records(spark, unit, level, saps, y):
    frame = pd.DataFrame({"unit_code": unit.astype(str), "adm_year": [f"L{i}" for i in level], "saps": saps, "death": y})
    return spark.createDataFrame(frame)


def array_sums(unit, level, s, n, k, offset, slope, units, levels):
    eta = offset[unit, level] + slope[level] * s
    mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    w, r = n * mu * (1 - mu), k - n * mu
    t = w * (1 - 2 * mu)
    add = lambda x: np.bincount(unit * levels + level, weights=x, minlength=units * levels).reshape(units, levels)
    ll = k * eta - n * np.logaddexp(0, eta)
    return {"w0": add(w), "w1": add(w * s), "w2": add(w * s * s), "r0": add(r), "r1": add(r * s), "t0": add(t),
            "t1": add(t * s), "ll": add(ll)}


def in_memory_search(data, units, levels, design, beta, tol=1e-9, fixed_factor=None, limit=100):
    """The same steps as the Spark loop, on arrays."""
    unit, level, s, n, k = data
    search = Search(design, beta, tol)
    v = previous = np.zeros((units, design.n_random))
    m = design.fixed_map
    trace = []
    while search.passes < limit:
        ac = m @ search.beta
        offset = ac[:levels] + v @ search.factor.T @ design.random_map.T
        sums = array_sums(unit, level, s, n, k, offset, ac[levels:], units, levels)
        factor = search.factor
        step = search.advance(unit_contributions(sums, v, factor, design))
        trace.append(search.halvings)
        if step is None:
            break
        new = updated_effects(sums, v, previous, factor, step, design)
        previous = v if step.backtrack is None else previous
        v = new
    return search, v, trace


@pytest.fixture(scope="module")
def small():
    unit, level, saps, y = dense.simulate(units=14, levels=3, rows=3000, seed=5)
    return unit, level, saps, y


DESIGNS = [("interaction", "intercept"), ("additive", "level"), ("interaction", "level")]


@pytest.mark.parametrize("fixed,random", DESIGNS)
def test_fit_matches_dense_minimum(spark, small, fixed, random):
    """Criterion, coefficients, errors and covariance against a row-level dense fit with another optimizer."""
    unit, level, saps, y = small
    score = (saps - 60) / 20
    x, z, q = dense.design(unit, level, score, 14, 3, fixed, random)
    ones = np.ones(len(y))
    start = np.eye(q)[np.tril_indices(q)] * 0.5
    best, value = dense.minimize(lambda th: dense.solve(x, z, ones, y, dense.lower(th, q), 14)[0], start)
    _, beta, vcov, _ = dense.solve(x, z, ones, y, dense.lower(best, q), 14)
    sigma = dense.lower(best, q) @ dense.lower(best, q).T

    fit = mixed.fit_mixed_logit(cells(records(spark, *small)), fixed=fixed, random=random)
    model = fit.models["model"]
    assert model.converged and model.n_obs == len(y) and model.n_units == 14
    assert -2 * model.log_lik == pytest.approx(value, abs=2e-6)
    table = {r.term: r for r in fit_tables.coef_table(fit).collect()}
    terms = ["(Intercept)", "adm_yearL1", "adm_yearL2"]
    terms += ["saps", "saps:adm_yearL1", "saps:adm_yearL2"] if fixed == "interaction" else ["saps"]
    # from the score scaled here back to the original one
    g = 3
    back = np.eye(len(beta))
    for i in range(g if fixed == "interaction" else 1):
        back[i, g + i] = -3.0
        back[g + i, g + i] = 1 / 20
    expected, errors = back @ beta, np.sqrt(np.diag(back @ vcov @ back.T))
    for term, value, error in zip(terms, expected, errors):
        assert table[term].estimate == pytest.approx(value, abs=2e-4 * error + 1e-9)
        assert table[term].std_error == pytest.approx(error, rel=2e-4)
    names = ["(Intercept)", "adm_yearL1", "adm_yearL2"][:q]
    for row in fit_tables.varcomp_table(fit).collect():
        i, j = names.index(row.var1), names.index(row.var2 or row.var1)
        assert row.vcov == pytest.approx(sigma[i, j], abs=2e-4)


def test_criterion_derivative(small):
    """Derivative in the covariance factor, with fixed and unit effects following, against central differences."""
    unit, level, saps, y = small
    s, ones = (saps - 60) / 20, np.ones(len(y))
    design = Design("interaction", "level", (0, 1, 2))
    rng = np.random.default_rng(0)
    factor = rng.normal(size=(3, 3)) * 0.3 + 0.5 * np.eye(3)
    x = np.concatenate([np.eye(3)[level], np.eye(3)[level] * s[:, None]], axis=1)
    z = np.zeros((len(y), 14 * 3))
    z[np.arange(len(y)), unit * 3 + level] = 1
    deviance = lambda f: dense.solve(x, z, ones, y, f, 14)
    value, beta, vcov, u = deviance(factor)
    v = np.linalg.solve(factor, u.reshape(14, 3).T).T
    sums = array_sums(unit, level, s, ones, y, beta[:3] + u.reshape(14, 3), beta[3:], 14, 3)
    parts = unpack(unit_contributions(sums, v, factor, design), design)
    assert -2 * parts["ll"] + parts["penalty"] + parts["logdet"] == pytest.approx(value)
    assert np.linalg.inv(parts["info"]) == pytest.approx(vcov, rel=1e-6)
    search = Search(design, beta, 1e-9)
    search.factor = factor
    gradient, _ = search._covariance_model(parts, parts["info"])
    for found, (i, j) in zip(gradient, [(a, b) for a in range(3) for b in range(3)]):
        h = np.zeros((3, 3))
        h[i, j] = 1e-4
        assert found == pytest.approx((deviance(factor + h)[0] - deviance(factor - h)[0]) / 2e-4, abs=1e-4)


def test_search_recovers_from_a_bad_start(small):
    unit, level, saps, y = small
    data = (unit, level, (saps - 60) / 20, np.ones(len(y)), y)
    design = Design("interaction", "level", (0, 1, 2))
    good, _, _ = in_memory_search(data, 14, 3, design, np.zeros(6))
    bad, _, halvings = in_memory_search(data, 14, 3, design, np.array([4.0, -4, 4, -3, 3, -3]))
    assert good.converged and bad.converged and max(halvings) > 0
    assert bad.best["value"] == pytest.approx(good.best["value"], abs=1e-6)


@pytest.fixture(scope="module")
def simulated(spark):
    data = dense.simulate()
    fit = mixed.fit_mixed_logit(cells(records(spark, *data)))
    return data, fit


def test_statistics_table(simulated):
    (_, _, _, y), fit = simulated
    row = fit_tables.fit_stats(fit).collect()[0]
    assert row.converged and row.npar == 8 + 10 and row.n_obs == len(y) and row.n_units == 60
    assert row.deviance == pytest.approx(-2 * row.log_lik)
    assert row.aic == pytest.approx(row.deviance + 2 * 18)
    assert row.bic == pytest.approx(row.deviance + 18 * np.log(len(y)))


def test_recovery(simulated):
    (_, level, _, _), fit = simulated
    model = fit.models["model"]
    assert model.converged
    errors = np.sqrt(np.diag(model.level_cov))
    for g in range(4):
        slope = (1 + 0.1 * g) / 20
        assert abs(model.level_coef[4 + g] - slope) < 3 * errors[4 + g]
        assert abs(model.level_coef[g] - (-1 + 0.2 * g - slope * 60)) < 3 * errors[g]
    assert np.abs(model.covariance - (0.25 + 0.15 * np.eye(4))).max() < 0.2


def test_score_equations(simulated):
    """At the optimum fitted totals equal observed ones, and every unit's residual sum is inverse covariance times effect."""
    (unit, level, saps, y), fit = simulated
    for row in mixed.fitted_totals(fit).collect():
        assert row.fitted == pytest.approx(row.observed, abs=1e-6)
        assert row.fitted_saps == pytest.approx(row.observed_saps, abs=1e-4)
    model = fit.models["model"]
    inverse = np.linalg.inv(model.covariance)
    by_unit = {int(row.unit): row for row in fit.unit_effects.collect()}
    base = model.level_coef[:4] + model.level_coef[4:] * fit.center
    for j, row in by_unit.items():
        effect = np.array(row.off) - base
        mine = unit == j
        eta = np.array(row.off)[level[mine]] + np.array(row.slope)[level[mine]] * (saps[mine] - fit.center) / fit.spread
        residual = np.bincount(level[mine], weights=y[mine] - 1 / (1 + np.exp(-eta)), minlength=4)
        assert residual == pytest.approx(inverse @ effect, abs=1e-6)


def test_no_unit_variation_gives_the_plain_fit(spark):
    """Without unit effects in the data the variance of a single unit effect may end at zero: same fit as without."""
    rng = np.random.default_rng(3)
    unit, level = np.repeat(np.arange(20), 100), np.tile(np.repeat([0, 1], 50), 20)
    saps = np.tile(np.arange(20, 70), 40)
    # the same number of deaths in every unit and level: less variation between units than chance alone gives
    y = np.tile(np.concatenate([rng.permutation([1] * 20 + [0] * 30), rng.permutation([1] * 30 + [0] * 20)]), 20)
    data = cells(records(spark, unit, level, saps, y))
    plain = mixed.fit_mixed_logit(data, random="none").models["model"]
    fit = mixed.fit_mixed_logit(data, random="intercept")
    zero = fit.models["model"]
    assert zero.converged and zero.covariance[0, 0] < 1e-8
    assert zero.log_lik == pytest.approx(plain.log_lik, abs=1e-6)
    assert zero.level_coef == pytest.approx(plain.level_coef, abs=1e-6)
    rows = fit_tables.varcomp_table(mixed.fit_mixed_logit(data, random="level")).collect()
    assert all(row.vcov < 1e-8 for row in rows if row.var2 is None)


def test_batched_models_equal_single_fits_with_missing_levels(spark, small):
    """Models fitted together, one of them without a level and one with units that lack a level."""
    unit, level, saps, y = small
    base = cells(records(spark, unit, level, saps, y))
    without = base.where("level <> 'L1'")
    patchy = base.where("not (level = 'L2' and unit in ('1', '2', '3'))")
    both = without.withColumn("model", F.lit("without")).unionByName(patchy.withColumn("model", F.lit("patchy")))
    together = mixed.fit_mixed_logit(both).models
    assert together["without"].levels == ["L0", "L2"] and together["patchy"].levels == ["L0", "L1", "L2"]
    for name, alone in (("without", without), ("patchy", patchy)):
        single = mixed.fit_mixed_logit(alone).models["model"]
        assert together[name].log_lik == pytest.approx(single.log_lik, abs=1e-6)
        se = np.sqrt(np.diag(single.level_cov))
        assert np.abs((together[name].level_coef - single.level_coef) / se).max() < 1e-3


def test_split_units_and_many_tasks_give_the_same_fit(spark, small, monkeypatch):
    """A unit that holds most cells is split by salt, and the sums over units come from several tasks."""
    unit, level, saps, y = small
    rng = np.random.default_rng(1)
    score = saps + rng.random(len(y))             # continuous: cells are rows
    unit = np.where(rng.random(len(y)) < 0.4, 0, unit)
    data = cells(records(spark, unit, level, score, y))
    whole = mixed.fit_mixed_logit(data).models["model"]
    monkeypatch.setattr(mixed, "CELLS_PER_TASK", 150)
    monkeypatch.setattr(mixed, "UNITS_PER_TASK", 5)
    monkeypatch.setattr(mixed, "UNITS_PER_JOIN", 5)
    monkeypatch.setattr(mixed, "BATCH_VALUES", 40)
    split = mixed.fit_mixed_logit(data)
    assert split.models["model"].log_lik == pytest.approx(whole.log_lik, abs=1e-7)
    assert split.models["model"].level_coef == pytest.approx(whole.level_coef, abs=1e-6)
    assert split.unit_effects.count() == 14
    for row in mixed.fitted_totals(split).collect():
        assert row.fitted == pytest.approx(row.observed, abs=1e-6)


def test_level_order_and_foreign_levels(spark, small):
    data = cells(records(spark, *small))
    fit = mixed.fit_mixed_logit(data, random="none", levels=["L2", "L0", "absent"])
    assert fit.models["model"].levels == ["L2", "L0"]
    terms = [row.term for row in fit_tables.coef_table(fit).orderBy("idx").collect()]
    assert terms == ["(Intercept)", "saps", "adm_yearL0", "saps:adm_yearL0"]
    with pytest.raises(ValueError, match="no cells"):
        mixed.fit_mixed_logit(data, levels=["absent"])


def test_level_with_one_score_borrows_its_slope(spark, small):
    unit, level, saps, y = small
    fit = mixed.fit_mixed_logit(cells(records(spark, unit, level, np.where(level == 2, 60, saps), y)), random="intercept")
    model = fit.models["model"]
    assert model.converged and model.n_par == 5 + 1
    assert model.level_coef[5] == model.level_coef[3]
    terms = [row.term for row in fit_tables.coef_table(fit).orderBy("idx").collect()]
    assert terms == ["(Intercept)", "saps", "adm_yearL1", "adm_yearL2", "saps:adm_yearL1"]
    for row in mixed.fitted_totals(fit).collect():
        assert row.fitted == pytest.approx(row.observed, abs=1e-6)
    for fixed in ("interaction", "additive"):
        constant = mixed.fit_mixed_logit(cells(records(spark, unit, level, 0 * saps + 50, y)), fixed=fixed, random="none")
        deaths, rows = np.bincount(level, weights=y), np.bincount(level)
        assert constant.models["model"].level_coef == pytest.approx([*np.log(deaths / (rows - deaths)), 0, 0, 0])
        assert fit_tables.coef_table(constant).count() == 3


def test_level_without_deaths_is_reported_as_not_converged(spark, small):
    """Its log odds run off to minus infinity, as in any logistic fit."""
    unit, level, saps, y = small
    fit = mixed.fit_mixed_logit(cells(records(spark, unit, level, saps, np.where(level == 1, 0, y))), random="none")
    assert fit.models["model"].level_coef[1] < -8 and fit.models["model"].runaway == (fit.models["model"].levels[1],)
    assert fit_tables.fit_stats(fit).first().runaway == [fit.models["model"].levels[1]]
    # the level stays in the tables, without an estimate
    coef, cov = fit_tables.level_estimates(fit)
    assert [row.a is None for row in coef.orderBy("idx").collect()] == [False, True, False]
    pairs = est.adjust(est.contrasts(est.linear_predictor(coef, cov, [50]), cov)).collect()
    assert len(pairs) == 3 and {row.family for row in pairs} == {3}
    assert sum(row.p_value is None for row in pairs) == 2


def test_pass_limit_is_reported(spark, small):
    fit = mixed.fit_mixed_logit(cells(records(spark, *small)), max_passes=2)
    assert not fit.models["model"].converged and fit.models["model"].passes == 2
    assert not fit_tables.fit_stats(fit).collect()[0].converged
    with pytest.raises(ValueError, match="not converged"):
        fit_tables.level_estimates(fit)
    assert fit_tables.level_estimates(fit, allow_unfinished=True)[0].count() == len(fit.models["model"].levels)


def test_models_are_fitted_in_groups_within_the_bound(spark, small):
    """Seven copies of a model under a bound that holds two of them: the same results."""
    counted = cells(records(spark, *small))
    whole = mixed.fit_mixed_logit(counted, random="none").models["model"]
    size = mixed.algebra_size(whole.design)
    many = mixed.fit_mixed_logit(mixed.stack_models(counted, list("abcdefg")), random="none", max_algebra=max(2 * size, 2200))
    assert set(many.models) == set("abcdefg")
    for model in many.models.values():
        assert model.level_coef == pytest.approx(whole.level_coef)
    assert many.unit_effects.select("model").distinct().count() == 7
    with pytest.raises(ValueError, match="max_algebra"):
        mixed.fit_mixed_logit(counted, random="level", max_algebra=mixed.algebra_size(
            mixed.Design("interaction", "level", whole.design.levels)) - 1)


def test_comparison_of_fits(spark):
    stats = spark.createDataFrame(
        [("m1", 21, 500, True, 1000.0, 1100.0, -480.0, 960.0), ("m3", 75, 500, True, 950.0, 1200.0, -440.0, 880.0)],
        "model string, npar int, n_obs bigint, converged boolean, aic double, bic double, log_lik double, deviance double",
    )
    with pytest.raises(ValueError, match="different rows"):
        fit_tables.compare_fits(stats.withColumn("n_obs", F.col("npar")))
    with pytest.raises(ValueError, match="not converged: m3"):
        fit_tables.compare_fits(stats.withColumn("converged", F.col("npar") < 50))
    first, second = fit_tables.compare_fits(stats).orderBy("npar").collect()
    assert first.chisq is None and first.p_value is None
    assert second.chisq == 80.0 and second.df == 54
    assert second.p_value == pytest.approx(0.01233, abs=2e-4)


def test_cells_are_not_moved_between_passes(spark, small, monkeypatch):
    """Neither the join with unit effects nor the sums shuffle the cached cells; only the effects are exchanged."""
    plans = []
    original = mixed.unit_sums

    def spy(packed, effects, slopes, keys, partitions):
        found = original(packed, effects, slopes, keys, partitions)
        if len(plans) < 2:
            found.count()
            found.collect()
            plans.append(found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return found

    monkeypatch.setattr(mixed, "unit_sums", spy)
    # three models on one set of cells
    designs = dict(zip("abc", DESIGNS))
    mixed.fit_mixed_logit(cells(records(spark, *small)), max_passes=2, designs=designs)
    for plan in plans:
        own = plan.split("InMemoryRelation")[0]      # everything above the cached cells
        assert "ShuffledHashJoin" in own and "Exchange" not in own and "Broadcast" not in own


def test_cells_are_kept_in_columns_and_counted_once(spark, small):
    fit = mixed.fit_mixed_logit(cells(records(spark, *small)), variance=0.2)
    # cells, counts over all units and the units are read back from files; the unit effects hold no count of their own
    assert any("cells-" in f for f in fit.cells.inputFiles())
    assert any("units-" in f for f in fit.unit_effects.inputFiles())
    assert "Aggregate" not in fit.unit_effects._jdf.queryExecution().optimizedPlan().toString()
