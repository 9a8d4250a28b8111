"""Outcome by admission year: three models, predictions and odds ratios of the last year against the others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortlens.operators import estimates as est
from cohortlens.operators.cells import cells
from cohortlens.operators.fit_tables import coef_table, compare_fits, fit_stats, level_estimates, varcomp_table
from cohortlens.operators.mixed import FitSet, fit_mixed_logit
from cohortlens.operators.report import or_report

# Model name -> (fixed part, random part).
YEAR_MODELS = {
    "m1": ("interaction", "intercept"),
    "m2": ("additive", "level"),
    "m3": ("interaction", "level"),
}


@dataclass
class YearEffect:
    fit: FitSet
    coefficients: DataFrame
    variances: DataFrame
    statistics: DataFrame
    comparison: DataFrame
    predictions: DataFrame
    figure: DataFrame
    means: DataFrame
    compared: DataFrame
    compared_bonferroni: DataFrame
    odds_ratios: DataFrame
    report: DataFrame


def fit_year_models(admissions: DataFrame, models: Sequence[str] = tuple(YEAR_MODELS), **options) -> FitSet:
    """The chosen models fitted together on one set of cells."""
    return fit_mixed_logit(cells(admissions), designs={m: YEAR_MODELS[m] for m in models}, **options)


def compare_with_last(
    coef: DataFrame, cov: DataFrame, reference: str, method: str = "tukey", se_scale: str = "log",
    scores: Sequence[float] = tuple(est.CONTRAST_SCORES),
) -> DataFrame:
    """Pairwise contrasts within each score, adjusted over all pairs, then those that end in the reference level, turned
    into reference / other."""
    means = est.linear_predictor(coef, cov, scores)
    adjusted = est.adjust(est.contrasts(means, cov), method)
    return est.or_table(est.vs_reference(adjusted, reference), invert=True, se_scale=se_scale)


def year_effect(
    admissions: DataFrame, reference: str, figure_years: Sequence[str], se_scale: str = "log", model: str = "m3", **options
) -> YearEffect:
    """Everything of the year analysis; estimates are taken from ``model``."""
    fit = fit_year_models(admissions, **options)
    coef, cov = (table.where(f"model = '{model}'") for table in level_estimates(fit))
    stats = fit_stats(fit)
    means = est.linear_predictor(coef, cov, est.CONTRAST_SCORES)
    pairs = est.contrasts(means, cov)
    predictions = est.predict_grid(coef, cov)
    ors = compare_with_last(coef, cov, reference, se_scale=se_scale)
    return YearEffect(
        fit=fit,
        coefficients=coef_table(fit),
        variances=varcomp_table(fit),
        statistics=stats,
        comparison=compare_fits(stats.where("model in ('m1', 'm3')")),
        predictions=predictions,
        figure=est.figure_grid(predictions, figure_years),
        means=est.marginal_means(means),
        compared=est.adjust(pairs, "tukey"),
        compared_bonferroni=est.adjust(pairs, "bonferroni"),
        odds_ratios=ors,
        report=or_report(ors),
    )
