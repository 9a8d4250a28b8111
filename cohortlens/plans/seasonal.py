"""Odds ratios of the phases of the last year against the whole year before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import estimates as est
from cohortlens.operators.cells import cells
from cohortlens.operators.cohort import attach_dates, relabel
from cohortlens.operators.fit_tables import level_estimates
from cohortlens.operators.mixed import FitSet, fit_mixed_logit
from cohortlens.operators.season import period_levels, season_cohort
from cohortlens.sources.admissions import EXTRACT_COLUMNS, write_extract

# Axis name per phase; fixed values.
PHASE_NAMES = {
    "before": "Baseline",
    "peak1": "First Peak",
    "plateau": "Plateau",
    "peak2": "Second Peak",
}


def season_extract(
    admissions: DataFrame, dates: DataFrame, key: str = "admission_id", path: str | None = None,
    date: str = "unit_admission_date", one_to_one: bool = True,
) -> DataFrame:
    """The columns of the seasonal analysis with the admission date bound by key; saved for all years if a path is given."""
    narrow = admissions.select(key, "saps", "death", "unit_code", "adm_year")
    extract = attach_dates(narrow, dates, key, date, one_to_one=one_to_one).select(EXTRACT_COLUMNS)
    if path:
        write_extract(extract, path)
    return extract


def fit_season(
    extract: DataFrame, last_year: str, previous_year: str, gap_week: str = "peak2", random: str = "level", **options
) -> FitSet:
    """score x period with a vector of period effects per unit."""
    cohort = season_cohort(extract, last_year, previous_year, gap_week=gap_week)
    return fit_mixed_logit(
        cells(cohort, level="period"), random=random, levels=period_levels(previous_year), **options
    )


def season_or(
    fit: FitSet, previous_year: str, compat: bool = False, scores: Sequence[float] = tuple(est.CONTRAST_SCORES),
    allow_unfinished: bool = False,
) -> DataFrame:
    """Odds ratio of every phase against the year before, with its axis label.

    The contrasts already read phase / year. By default they stay that way. ``compat`` inverts them once more and uses the
    odds-ratio-scale error in the interval, as the original table did. The label reads as ``or_direction`` does.
    """
    coef, cov = level_estimates(fit, allow_unfinished)
    means = est.linear_predictor(coef, cov, scores)
    adjusted = est.adjust(est.contrasts(means, cov, reverse=True), "tukey")
    kept = est.vs_reference(adjusted, previous_year, side="either")
    table = est.or_table(kept, invert=compat, se_scale="ratio" if compat else "log")
    named = relabel(relabel(table, "level_a", PHASE_NAMES, "name_a"), "level_b", PHASE_NAMES, "name_b")
    sides = [F.coalesce("name_a", "level_a"), F.coalesce("name_b", "level_b")]
    return named.withColumn("label", F.concat_ws("/", *(reversed(sides) if compat else sides))).drop("name_a", "name_b")
