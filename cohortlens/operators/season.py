"""Phases of the last year against the whole year before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dates import week_of_year_blocks
from cohortlens.operators.cohort import member_of

# Last week of each phase, and the week that the rules leave out.
BEFORE_LAST_WEEK = 10
PEAK1_LAST_WEEK = 24
PLATEAU_LAST_WEEK = 41
GAP_WEEK = 25
PHASES = ["before", "peak1", "plateau", "peak2"]


def period_levels(previous_year: str) -> list[str]:
    """Levels of the period factor: the year before first, then the phases in time order."""
    return [previous_year, *PHASES]


def period_label(year: Column, week: Column, last_year: str, gap_week: str = "peak2") -> Column:
    """Phase for rows of the last year, the year itself for others.

    Week 25 lies between the first peak (up to 24) and the plateau (above 25), so by the original rules it falls through
    to ``peak2``; ``gap_week="plateau"`` closes the gap instead. A last-year row without a week has no period.
    """
    if gap_week not in ("peak2", "plateau"):
        raise ValueError("gap_week must be 'peak2' or 'plateau'")
    plateau_from = GAP_WEEK if gap_week == "plateau" else GAP_WEEK + 1
    return (
        F.when(year != last_year, year)
        .when(year.isNull() | week.isNull(), F.lit(None).cast("string"))
        .when(week <= BEFORE_LAST_WEEK, F.lit("before"))
        .when(week <= PEAK1_LAST_WEEK, F.lit("peak1"))
        .when((week >= plateau_from) & (week <= PLATEAU_LAST_WEEK), F.lit("plateau"))
        .otherwise(F.lit("peak2"))
    )


def season_cohort(
    admissions: DataFrame,
    last_year: str,
    previous_year: str,
    date: str = "adm_date",
    year: str = "adm_year",
    gap_week: str = "peak2",
) -> DataFrame:
    """Rows of the two years with ``pweek`` and ``period`` added."""
    kept = member_of(admissions, year, [previous_year, last_year])
    return kept.withColumn("pweek", week_of_year_blocks(date)).withColumn(
        "period", period_label(F.col(year), F.col("pweek"), last_year, gap_week)
    )
