"""Tables of fitted models. Their size is set by the number of models and levels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.stats import chi_square_upper, mixture_upper, two_sided_p
from cohortlens.operators.mixed import FitSet, ModelFit, require_finished
from cohortlens.operators.unit_algebra import lower_pairs, symmetric_basis
from cohortlens.session import small_table


def level_estimates(fit: FitSet, allow_unfinished: bool = False) -> tuple[DataFrame, DataFrame]:
    """``coef`` and ``cov`` tables that predictions, marginal means and contrasts are computed from.

    A model whose fit didn't converge is refused unless allowed. Levels without deaths or survivors have no finite estimate:
    they are nulls here and in what follows from it, and still count in the family of the adjustments.
    """
    require_finished(fit, allow_unfinished)
    coef, cov = [], []
    for name, model in fit.models.items():
        g = len(model.levels)
        lost = [level in model.runaway for level in model.levels]
        for i, level in enumerate(model.levels):
            own = (None, None) if lost[i] else (float(model.level_coef[i]), float(model.level_coef[g + i]))
            coef.append((name, level, i + 1, *own))
            for j in range(g):
                v = model.level_cov
                values = [float(x) for x in (v[i, j], v[i, g + j], v[g + i, j], v[g + i, g + j])]
                cov.append((name, i + 1, j + 1, *([None] * 4 if lost[i] or lost[j] else values)))
    return (
        small_table(fit.spark, coef, "model string, level string, idx int, a double, c double"),
        small_table(
        fit.spark, cov, "model string, idx_a int, idx_b int, v_aa double, v_ac double, v_ca double, v_cc double"
        ),
    )


def _report_coding(model: ModelFit, score: str, factor: str) -> tuple[list[str], np.ndarray]:
    """Terms of the usual table, first level as baseline, and the map from level parameters to them. Slopes that cannot
    be estimated have no term."""
    g, slopes = len(model.levels), model.design.slope_columns
    rows, terms = [], []

    def term(name, **weights):
        row = np.zeros(2 * g)
        for at, value in weights.values():
            row[at] += value
        terms.append(name)
        rows.append(row)

    term("(Intercept)", one=(0, 1.0))
    if slopes[0] is not None:
        term(score, one=(g, 1.0))
    for i in range(1, g):
        term(f"{factor}{model.levels[i]}", one=(i, 1.0), base=(0, -1.0))
    for i in range(1, g):
        if slopes[i] != slopes[0]:
            term(f"{score}:{factor}{model.levels[i]}", one=(g + i, 1.0), base=(g, -1.0))
    return terms, np.array(rows)


def _report_estimates(model: ModelFit, score: str, factor: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, estimates and covariance in baseline coding, and which of them have finite estimates."""
    terms, coding = _report_coding(model, score, factor)
    g = len(model.levels)
    lost = np.array([level in model.runaway for level in model.levels])
    slopes = model.design.slope_columns
    # a slope shared with a level that has an estimate is estimated
    shared = {slopes[i] for i in range(g) if not lost[i]}
    gone = np.concatenate([lost, [lost[i] and slopes[i] not in shared for i in range(g)]])
    finite = ~(np.abs(coding) @ gone.astype(float) > 0)
    return terms, coding @ model.level_coef, coding @ model.level_cov @ coding.T, finite


def coef_table(
    fit: FitSet, score: str = "saps", factor: str = "adm_year", allow_unfinished: bool = False
) -> DataFrame:
    """Fixed effects per model in baseline coding: estimate, standard error, z and two-sided p. Terms of levels without deaths
    or survivors, or against such a baseline, are nulls."""
    require_finished(fit, allow_unfinished)
    out = []
    for name, model in fit.models.items():
        terms, estimates, covariance, finite = _report_estimates(model, score, factor)
        errors = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        out += [
            (name, i + 1, t, *((float(e), float(s)) if ok else (None, None)))
            for i, (t, e, s, ok) in enumerate(zip(terms, estimates, errors, finite))
        ]
    table = small_table(fit.spark, out, "model string, idx int, term string, estimate double, std_error double")
    with_z = table.withColumn("z_value", F.col("estimate") / F.col("std_error"))
    return with_z.withColumn("p_value", F.when(F.col("z_value").isNotNull(), two_sided_p(F.col("z_value"))))


def effect_correlations(
    fit: FitSet, score: str = "saps", factor: str = "adm_year", allow_unfinished: bool = False
) -> DataFrame:
    """``model, idx, term, with_idx, with_term, correlation`` of every two fixed effects in baseline coding, the later one
    first; null where either has no finite estimate."""
    require_finished(fit, allow_unfinished)
    out = []
    for name, model in fit.models.items():
        terms, _, covariance, finite = _report_estimates(model, score, factor)
        errors = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        for i in range(len(terms)):
            for j in range(i):
                size = errors[i] * errors[j]
                value = float(covariance[i, j] / size) if finite[i] and finite[j] and size else None
                out.append((name, i + 1, terms[i], j + 1, terms[j], value))
    return small_table(
        fit.spark, out, "model string, idx int, term string, with_idx int, with_term string, correlation double"
    )


def _covariance_errors(model: ModelFit, change: np.ndarray) -> np.ndarray | None:
    """Standard errors of the entries of the changed covariance, or None where the covariance is singular: on the edge of
    the space of covariances the estimates are not normal."""
    q = model.design.n_random
    values = np.linalg.eigvalsh(model.covariance)
    if values.min() <= 1e-8 * max(values.max(), 1e-8):
        return None
    pairs = lower_pairs(q)
    rows = [i * q + j for i, j in pairs]
    moved = (np.kron(change, change) @ symmetric_basis(q))[rows]
    spread = moved @ np.linalg.pinv(model.fisher) @ moved.T
    errors = np.zeros((q, q))
    for (i, j), variance in zip(pairs, np.diag(spread)):
        errors[i, j] = errors[j, i] = math.sqrt(max(variance, 0.0))
    return errors


def varcomp_table(
    fit: FitSet, factor: str = "adm_year", group: str = "unit_code", allow_unfinished: bool = False
) -> DataFrame:
    """Variances and covariances of the random effects with standard errors, and standard deviations and correlations.

    Baseline coding: the intercept is the effect at the first level, the other terms are differences from it. ``var2`` is
    null for a variance. ``std_error`` belongs to ``vcov`` and comes from the information of the criterion; it is null if
    the covariance is singular.
    """
    require_finished(fit, allow_unfinished)
    out = []
    for name, model in fit.models.items():
        q = model.design.n_random
        if q == 0:
            continue
        terms = ["(Intercept)"] + [f"{factor}{level}" for level in model.levels[1:]] if q > 1 else ["(Intercept)"]
        change = np.eye(q)
        change[1:, 0] = -1.0
        cov = change @ model.covariance @ change.T
        errors = _covariance_errors(model, change)
        error = lambda i, j: None if errors is None else float(errors[i, j])
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        out += [(name, group, terms[i], None, float(cov[i, i]), float(sd[i]), error(i, i)) for i in range(q)]
        for i in range(q):
            for j in range(i):
                size = sd[i] * sd[j]
                out.append((
                    name, group, terms[j], terms[i], float(cov[i, j]), float(cov[i, j] / size) if size else None, error(i, j)
                ))
    return small_table(
        fit.spark, out,
        "model string, grp string, var1 string, var2 string, vcov double, sdcor double, std_error double",
    )


def fit_stats(fit: FitSet) -> DataFrame:
    """One row per model: parameters, rows, units, log-likelihood, deviance, AIC, BIC and how the fit ended."""
    out = []
    for name, model in fit.models.items():
        deviance = -2 * model.log_lik
        out.append((
            name, model.n_par, model.n_obs, model.n_units, model.log_lik, deviance, deviance + 2 * model.n_par,
            deviance + math.log(model.n_obs) * model.n_par, model.passes, model.converged, list(model.runaway),
            model.design.n_random,
        ))
    return small_table(
        fit.spark, out,
        "model string, npar int, n_obs bigint, n_units bigint, log_lik double, deviance double, aic double, bic double, "
        "passes int, converged boolean, runaway array<string>, n_random int",
    )


def compare_fits(stats: DataFrame) -> DataFrame:
    """Likelihood-ratio test of each model against the next smaller one. One row per model, so one window is enough.

    The models have to be finished fits of the same rows. A statistic below zero (models that aren't nested) is kept and has
    no p. ``p_value`` takes all parameters as free. ``p_boundary`` heeds that the variances of random effects which the
    smaller model lacks are zero in it and cannot be negative: each of them counts with probability one half, their
    covariances stay free. For one more effect that is the exact large-sample law; for more it is an upper bound where the
    information is diagonal, since covariances are bounded by the variances too.
    """
    fits = stats.select("model", "n_obs", "converged", "n_random").collect()
    if len({row["n_obs"] for row in fits}) > 1:
        raise ValueError("models of different rows can't be compared")
    if not all(row["converged"] for row in fits):
        raise ValueError(f"not converged: {', '.join(row['model'] for row in fits if not row['converged'])}")
    most = max((row["n_random"] for row in fits), default=0)
    order = Window.partitionBy(F.lit(0)).orderBy("npar", "model")
    smaller = lambda column: F.lag(column).over(order)
    compared = stats.select(
        "model", "npar", "aic", "bic", "log_lik", "deviance",
        (2 * (F.col("log_lik") - smaller("log_lik"))).alias("chisq"),
        (F.col("npar") - smaller("npar")).alias("df"),
        F.greatest(F.col("n_random") - smaller("n_random"), F.lit(0)).alias("edges"),
    )
    chisq = F.when(F.col("df").isNotNull(), F.col("chisq"))
    tested = (F.col("df") > 0) & (F.col("chisq") >= 0)
    free = F.greatest(F.col("df") - F.col("edges"), F.lit(0))
    return compared.withColumn("chisq", chisq).withColumn(
        "p_value", F.when(tested, chi_square_upper(F.col("chisq"), F.col("df")))
    ).withColumn(
        "p_boundary", F.when(tested, mixture_upper(F.col("chisq"), free, F.col("edges"), most))
    ).drop("edges")
