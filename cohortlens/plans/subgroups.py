"""Odds ratios of the last year in every subgroup, from one scan and one batched fit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from cohortlens.operators.cells import subgroup_cells
from cohortlens.operators.cohort import SUBGROUPS
from cohortlens.operators.fit_tables import level_estimates
from cohortlens.operators.mixed import FitSet, fit_mixed_logit
from cohortlens.plans.year_effect import compare_with_last


def fit_subgroups(
    admissions: DataFrame, subgroups: Mapping[str, tuple[str, str]] = SUBGROUPS, **options
) -> FitSet:
    """One model per subgroup: score x year with a vector of year effects per unit."""
    counted = subgroup_cells(admissions, subgroups, name="model")
    return fit_mixed_logit(counted, **options)


def subgroup_or(
    admissions: DataFrame,
    reference: str,
    subgroups: Mapping[str, tuple[str, str]] = SUBGROUPS,
    se_scale: str = "log",
    **options,
) -> DataFrame:
    """Contrasts, Tukey adjustment, reference filter and odds-ratio table of all subgroups; ``model`` is the subgroup."""
    coef, cov = level_estimates(fit_subgroups(admissions, subgroups, **options))
    return compare_with_last(coef, cov, reference, se_scale=se_scale)
