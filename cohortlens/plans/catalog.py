"""Every operator and analysis as a query over the order tables, by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.dates import week_of_year_blocks
from cohortlens.operators import estimates as est
from cohortlens.operators import fit_tables
from cohortlens.operators.cells import cells as count_cells
from cohortlens.operators.cells import subgroup_cells as count_subgroup_cells
from cohortlens.operators.cohort import (
    as_factor, attach_dates as bind_dates, bind_by_position, freq, level_table, relabel as add_labels,
    used_levels as find_levels,
)
from cohortlens.operators.mixed import FitSet, fit_mixed_logit, fitted_totals, require_finished
from cohortlens.operators.profile import search_profile
from cohortlens.operators.report import or_report as make_report
from cohortlens.operators.report import percent_curve
from cohortlens.operators.residuals import residual_quantiles
from cohortlens.operators.season import period_levels, season_cohort
from cohortlens.plans.closed_form import closed_form
from cohortlens.plans.seasonal import fit_season, season_extract, season_or as make_season_or
from cohortlens.plans.subgroups import subgroup_or as make_subgroup_or
from cohortlens.plans.year_effect import compare_with_last, fit_year_models
from cohortlens.session import checkpoint_dir, scratch_path, small_table
from cohortlens.sources.admissions import read_admissions as read_table
from cohortlens.sources.admissions import read_extract, write_extract, write_report
from cohortlens.sources.lineitem_cohort import LAST_YEAR, PREVIOUS_YEAR, lineitem_admissions, varied_admissions
from cohortlens.sources.positions import bind_file_position as bind_files

QUERIES = {}
TIE_BREAK = 1 + 1e-12

FIGURE_YEARS = ["1995", "1999", PREVIOUS_YEAR, LAST_YEAR]


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded: sums differ in the last bits between runs and engines.

    The tiny factor moves exact ties (odds ratios of small counts have them) to one side, so that the last bit does not
    decide; adding zero turns a negative zero into zero.
    """
    return df.select([
        (F.round(F.col(f.name) * TIE_BREAK, digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def season_records(spark: SparkSession, sf_dir: str, gap_week: str = "peak2") -> DataFrame:
    return season_cohort(lineitem_admissions(spark, sf_dir), LAST_YEAR, PREVIOUS_YEAR, gap_week=gap_week)


# Cohort -------------------------------------------------------------------------------------------------------------


@query
def read_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_admissions(spark, sf_dir)


@query
def csv_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions written as text and read back with a declared schema."""
    path = scratch_path(spark, "admissions")
    records = lineitem_admissions(spark, sf_dir).drop("l_orderkey", "adm_date")
    records.write.option("header", True).csv(path)
    return read_table(spark, path, fmt="csv", schema=records.schema)


@query
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_cells(lineitem_admissions(spark, sf_dir))


@query
def subgroup_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_subgroup_cells(lineitem_admissions(spark, sf_dir))


@query
def freq_adm_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = level_table(spark, ["eSurgery", "Medical", "uSurgery"])
    return freq(lineitem_admissions(spark, sf_dir), "adm_type", levels)


@query
def used_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_levels(lineitem_admissions(spark, sf_dir), "adm_year")


@query
def used_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units as a factor: as many levels as there are units."""
    return find_levels(lineitem_admissions(spark, sf_dir), "unit_code")


@query
def dropped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels left after the two-year filter, in period order."""
    return find_levels(season_records(spark, sf_dir), "period", period_levels(PREVIOUS_YEAR))


@query
def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor with given levels: other values become missing."""
    records = as_factor(lineitem_admissions(spark, sf_dir), "adm_year", level_table(spark, [PREVIOUS_YEAR, LAST_YEAR]))
    return records.groupBy("adm_year").agg(F.count(F.lit(1)).alias("n"))


@query
def attach_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    bound = bind_dates(
        lineitem_admissions(spark, sf_dir).drop("adm_date"), orders.withColumnRenamed("o_orderkey", "l_orderkey"),
        key="l_orderkey", date="o_orderdate", one_to_one=False,
    )
    return bound.groupBy(F.year("adm_date").alias("order_year"), "adm_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("death").cast("bigint")).alias("k")
    )


@query
def bind_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th date, by date and key, bound to the n-th order by key; the two sides only share their positions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bind_by_position(
        orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")),
        ["o_orderkey"], ["d", "o_orderkey"], "d", "adm_date",
    )


@query
def bind_file_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same binding of tables that were saved in order, by the places of their rows in the files."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left, right = scratch_path(spark, "orders"), scratch_path(spark, "dates")
    orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").write.parquet(left)
    dates = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    dates.orderBy("d", "o_orderkey").select("d").write.parquet(right)
    return bind_files(spark, left, right, "d", "adm_date")


@query
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal extract of all years, written by year, read back and counted."""
    path = scratch_path(spark, "extract")
    write_extract(lineitem_admissions(spark, sf_dir), path)
    return read_extract(spark, path).groupBy("adm_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("death").cast("bigint")).alias("k"),
        F.min("adm_date").alias("first_date"), F.max("adm_date").alias("last_date"),
        F.sum(F.col("saps").cast("bigint")).alias("saps_total"),
    )


# Season -------------------------------------------------------------------------------------------------------------


@query
def week_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lineitem_admissions(spark, sf_dir)
    return records.groupBy("adm_date", week_of_year_blocks("adm_date").alias("week")).agg(F.count(F.lit(1)).alias("n"))


def _period_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("death").cast("bigint")).alias("k")
    )


@query
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _period_counts(season_records(spark, sf_dir))


@query
def period_gap_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _period_counts(season_records(spark, sf_dir, gap_week="plateau"))


@query
def period_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_cells(season_records(spark, sf_dir), level="period").withColumnRenamed("level", "period")


@query
def season_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal analysis up to its counts: select, bind the dates of a second table, save, read back, week, filter."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = scratch_path(spark, "season")
    season_extract(
        lineitem_admissions(spark, sf_dir).drop("adm_date"), orders.withColumnRenamed("o_orderkey", "l_orderkey"),
        key="l_orderkey", path=path, date="o_orderdate", one_to_one=False,
    )
    return _period_counts(season_cohort(read_extract(spark, path), LAST_YEAR, PREVIOUS_YEAR))


# Contrasts from counts ----------------------------------------------------------------------------------------------


def _year_contrasts(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    return est.contrasts(closed_form(lineitem_admissions(spark, sf_dir)), reverse=reverse)


@query
def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = find_levels(lineitem_admissions(spark, sf_dir), "adm_year")
    return est.reference_grid(levels, est.CONTRAST_SCORES).select("level", "idx", "saps")


@query
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return est.level_pairs(closed_form(lineitem_admissions(spark, sf_dir))).select("saps", "level_a", "level_b")


@query
def closed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = est.marginal_means(closed_form(lineitem_admissions(spark, sf_dir)))
    return rounded(means.select("saps", "level", "prob", "se", "lower", "upper"))


@query
def closed_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_year_contrasts(spark, sf_dir).select(
        "saps", "contrast", "log_or", "se_log", "odds_ratio", "se", "z_ratio"
    ))


@query
def closed_contrasts_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_year_contrasts(spark, sf_dir, reverse=True).select("saps", "contrast", "log_or", "odds_ratio", "se"))


@query
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = est.adjust(_year_contrasts(spark, sf_dir), "bonferroni")
    return rounded(adjusted.select("saps", "contrast", "z_ratio", "p_value"))


@query
def tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = est.adjust(_year_contrasts(spark, sf_dir), "tukey")
    return rounded(adjusted.select("saps", "contrast", "z_ratio", "p_value"))


@query
def vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = est.vs_reference(_year_contrasts(spark, sf_dir), LAST_YEAR)
    return rounded(kept.select("saps", "contrast", "odds_ratio"))


@query
def vs_reference_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons with a level in the middle of the order, whichever side it is on."""
    kept = est.vs_reference(_year_contrasts(spark, sf_dir), PREVIOUS_YEAR, side="either")
    return rounded(kept.select("saps", "contrast", "odds_ratio"))


def _closed_or(spark: SparkSession, sf_dir: str, se_scale: str) -> DataFrame:
    adjusted = est.adjust(_year_contrasts(spark, sf_dir), "tukey")
    return est.or_table(est.vs_reference(adjusted, LAST_YEAR), invert=True, se_scale=se_scale)


@query
def or_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_closed_or(spark, sf_dir, "log").select(
        "saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"
    ))


@query
def or_table_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_closed_or(spark, sf_dir, "ratio").select(
        "saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"
    ))


@query
def or_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_report(_closed_or(spark, sf_dir, "log"))


@query
def or_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as a file and read back."""
    path = scratch_path(spark, "report")
    write_report(make_report(_closed_or(spark, sf_dir, "log")), path)
    return spark.read.schema("saps double, odds_ratio2 string, p_value double").csv(path, header=True)


@query
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = est.vs_reference(_year_contrasts(spark, sf_dir), LAST_YEAR)
    years = find_levels(lineitem_admissions(spark, sf_dir), "adm_year")
    labels = years.select(F.col("level").alias("level_a"), F.concat(F.lit("Year "), "level").alias("label"))
    return rounded(add_labels(kept, "level_a", labels).select("saps", "label", "odds_ratio"))


# Fits without unit effects ------------------------------------------------------------------------------------------


def _fixed_fit(spark: SparkSession, sf_dir: str, fixed: str = "interaction") -> FitSet:
    return fit_mixed_logit(count_cells(lineitem_admissions(spark, sf_dir)), fixed=fixed, random="none")


@query
def fit_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fitted_totals(_fixed_fit(spark, sf_dir)).drop("model"), 4)


@query
def fixed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, cov = fit_tables.level_estimates(_fixed_fit(spark, sf_dir))
    own = cov.where("idx_a = idx_b").withColumnRenamed("idx_a", "idx")
    return rounded(coef.join(own, ["model", "idx"]).select("level", "a", "c", "v_aa", "v_ac", "v_cc"))


@query
def fixed_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_tables.coef_table(_fixed_fit(spark, sf_dir)).drop("model"), 5)


@query
def fixed_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, _ = fit_tables.level_estimates(_fixed_fit(spark, sf_dir, "additive"))
    return rounded(coef.select("level", "a", "c"))


@query
def fixed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fit_tables.fit_stats(_fixed_fit(spark, sf_dir))
    return rounded(stats.select("npar", "n_obs", "n_units", "log_lik", "deviance", "aic", "bic"), 3)


@query
def fixed_predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = est.predict_grid(*fit_tables.level_estimates(_fixed_fit(spark, sf_dir)))
    return rounded(percent_curve(predictions).drop("model"))


@query
def fixed_figure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = est.predict_grid(*fit_tables.level_estimates(_fixed_fit(spark, sf_dir)))
    return rounded(est.figure_grid(predictions, FIGURE_YEARS).drop("model"))


@query
def fixed_marginal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, cov = fit_tables.level_estimates(_fixed_fit(spark, sf_dir))
    means = est.marginal_means(est.linear_predictor(coef, cov, est.CONTRAST_SCORES))
    return rounded(means.select("saps", "level", "prob", "se", "lower", "upper"))


@query
def fixed_year_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, cov = fit_tables.level_estimates(_fixed_fit(spark, sf_dir))
    ors = compare_with_last(coef, cov, LAST_YEAR)
    return rounded(ors.select("saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"))


@query
def fixed_season_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_season(lineitem_admissions(spark, sf_dir), LAST_YEAR, PREVIOUS_YEAR, random="none")
    ors = make_season_or(fit, PREVIOUS_YEAR)
    return rounded(ors.select("saps", "contrast", "or_direction", "label", "odds_ratio", "lower", "upper", "p_value"))


@query
def fixed_season_or_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_season(lineitem_admissions(spark, sf_dir), LAST_YEAR, PREVIOUS_YEAR, random="none")
    ors = make_season_or(fit, PREVIOUS_YEAR, compat=True)
    return rounded(ors.select("saps", "contrast", "or_direction", "label", "odds_ratio", "lower", "upper", "p_value"))


@query
def fixed_subgroup_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgroup tables without unit effects."""
    ors = make_subgroup_or(lineitem_admissions(spark, sf_dir), LAST_YEAR, random="none")
    return rounded(ors.select("model", "saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"))


@query
def fixed_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive model against the interaction, without unit effects."""
    fit = fit_mixed_logit(
        count_cells(lineitem_admissions(spark, sf_dir)),
        designs={"additive": ("additive", "none"), "interaction": ("interaction", "none")},
    )
    compared = fit_tables.compare_fits(fit_tables.fit_stats(fit))
    return rounded(compared.select("model", "npar", "deviance", "chisq", "df", "p_value"), 4)


@query
def fixed_additive_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ratios of the additive model, whose levels are correlated by the common slope."""
    coef, cov = fit_tables.level_estimates(_fixed_fit(spark, sf_dir, "additive"))
    ors = compare_with_last(coef, cov, LAST_YEAR, method="none")
    return rounded(ors.select("saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"))


@query
def fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum, quartiles and maximum of the scaled residuals of all records, without unit effects."""
    return rounded(residual_quantiles(_fixed_fit(spark, sf_dir)).drop("model"))


@query
def fixed_effect_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the fixed effects in baseline coding, without unit effects."""
    return rounded(fit_tables.effect_correlations(_fixed_fit(spark, sf_dir)).drop("model"))


# Mixed fits ---------------------------------------------------------------------------------------------------------


@query
def fit_mixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted totals per year, unit effects included, equal the observed ones at the optimum."""
    fit = fit_year_models(lineitem_admissions(spark, sf_dir), ["m3"])
    return rounded(fitted_totals(fit).drop("model"), 4)


GIVEN_VARIANCE = 0.25


def _given_fit(spark: SparkSession, sf_dir: str) -> FitSet:
    return fit_mixed_logit(count_cells(lineitem_admissions(spark, sf_dir)), variance=GIVEN_VARIANCE)


@query
def given_cov_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients and errors of the mixed model at a given variance of independent unit effects."""
    coef, cov = fit_tables.level_estimates(_given_fit(spark, sf_dir))
    own = cov.where("idx_a = idx_b").withColumnRenamed("idx_a", "idx")
    return rounded(coef.join(own, ["model", "idx"]).select("level", "a", "c", "v_aa", "v_ac", "v_cc"))


@query
def given_cov_unit_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log odds of every unit and level at a score of 60, its unit effect included."""
    fit = _given_fit(spark, sf_dir)
    names = level_table(spark, fit.level_names).select("level", (F.col("idx") - 1).alias("lev"))
    effects = fit.unit_effects.select("model", "node", "off", "slope")
    seen = fit.cells.select("model", "node", "unit", "lev").distinct().join(effects, ["model", "node"])
    eta = F.get("off", F.col("lev")) + F.get("slope", F.col("lev")) * ((60 - fit.center) / fit.spread)
    return rounded(seen.join(names, "lev").select("unit", "level", eta.alias("log_odds")))


@query
def given_cov_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Laplace log-likelihood at the given variance."""
    return rounded(fit_tables.fit_stats(_given_fit(spark, sf_dir)).select("n_obs", "n_units", "log_lik"), 4)


def _joint_levels(fit: FitSet) -> DataFrame:
    """Estimates of every level with their covariances with those of every level."""
    coef, cov = fit_tables.level_estimates(fit)
    names = coef.select("model", F.col("idx").alias("idx_b"), F.col("level").alias("other"))
    pairs = cov.withColumnRenamed("idx_a", "idx").join(names, ["model", "idx_b"])
    return rounded(coef.join(pairs, ["model", "idx"]).select("level", "other", "a", "c", "v_aa", "v_ac", "v_ca", "v_cc"), 9)


@query
def given_intercept_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients and all covariances of the model with one effect per unit, shared by its levels, at a given variance."""
    counted = count_cells(lineitem_admissions(spark, sf_dir))
    return _joint_levels(fit_mixed_logit(counted, random="intercept", variance=GIVEN_VARIANCE))


@query
def given_additive_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients and errors of the model with one slope for all levels, at a given variance of unit effects."""
    fit = fit_mixed_logit(count_cells(lineitem_admissions(spark, sf_dir)), fixed="additive", variance=GIVEN_VARIANCE)
    return _joint_levels(fit)


# variance of the unit effects per subgroup
SUBGROUP_VARIANCES = {"surg": 0.1, "med": 0.25, "ecog0": 0.5, "ecog1": 0.05, "ecog2": 0.2, "infection": 0.4, "mv": 0.8}


@query
def given_cov_subgroup_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgroup tables with unit effects of a variance of their own per subgroup, from one fit."""
    ors = make_subgroup_or(lineitem_admissions(spark, sf_dir), LAST_YEAR, variance=SUBGROUP_VARIANCES)
    return rounded(ors.select("model", "saps", "contrast", "or_direction", "odds_ratio", "lower", "upper", "p_value"))


@query
def given_cov_season_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal table with unit effects of a given variance."""
    fit = fit_season(lineitem_admissions(spark, sf_dir), LAST_YEAR, PREVIOUS_YEAR, variance=GIVEN_VARIANCE)
    ors = make_season_or(fit, PREVIOUS_YEAR)
    return rounded(ors.select("saps", "contrast", "or_direction", "label", "odds_ratio", "lower", "upper", "p_value"))


VARCOMP_YEARS = ["1999", PREVIOUS_YEAR, LAST_YEAR]
# covariance of the unit effects of three years
GIVEN_COVARIANCE = ((0.30, 0.12, 0.05), (0.12, 0.40, 0.10), (0.05, 0.10, 0.25))


@query
def given_varcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance components of three years in baseline coding, with their errors, at a given covariance that is not diagonal."""
    fit = fit_mixed_logit(
        count_cells(varied_admissions(spark, sf_dir)), levels=VARCOMP_YEARS, covariance=np.array(GIVEN_COVARIANCE)
    )
    return rounded(fit_tables.varcomp_table(fit).drop("model", "grp"))


@query
def given_covariance_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients and all covariances of that fit, whose levels are coupled by the covariance of the unit effects."""
    fit = fit_mixed_logit(
        count_cells(varied_admissions(spark, sf_dir)), levels=VARCOMP_YEARS, covariance=np.array(GIVEN_COVARIANCE)
    )
    return _joint_levels(fit)


@query
def given_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One effect per unit against a vector of them, both at given variances, with the plain and the boundary test."""
    fit = fit_mixed_logit(
        count_cells(varied_admissions(spark, sf_dir)),
        designs={"m1": ("interaction", "intercept"), "m3": ("interaction", "level")}, variance=COMPARED_VARIANCES,
    )
    compared = fit_tables.compare_fits(fit_tables.fit_stats(fit))
    return rounded(compared.select("model", "npar", "deviance", "chisq", "df", "p_value", "p_boundary"), 4)


# an intercept held near zero leaves the vector something to explain
COMPARED_VARIANCES = {"m1": 1e-4, "m3": 1e-3}


@query
def one_level_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level, one effect per unit: the variance found by the search and by the profile of the criterion, with the
    estimates there."""
    records = varied_admissions(spark, sf_dir).withColumn("adm_year", F.lit("all"))
    checkpoint_dir(spark)
    counted = count_cells(records).checkpoint()
    searched = fit_mixed_logit(counted, random="intercept", tol=1e-13)
    require_finished(searched)
    profiled = search_profile(counted)
    if not profiled.enclosed:
        raise ValueError("the profile did not enclose the optimum")
    found = searched.models["model"]
    rows = [
        (how, float(v), float(m.level_coef[0]), float(m.level_coef[1]), float(m.log_lik), m.n_obs, m.n_units)
        for how, v, m in (("search", found.covariance[0, 0], found), ("profile", profiled.variance, profiled.best))
    ]
    table = small_table(
        spark, rows, "method string, variance double, a double, c double, log_lik double, n_obs bigint, n_units bigint"
    )
    return table.select("method", "n_obs", "n_units", *(
        (F.round(F.col(name) * TIE_BREAK, digits) + 0.0).alias(name)
        for name, digits in (("variance", 4), ("a", 5), ("c", 6), ("log_lik", 4))
    ))


@query
def fit_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_tables.coef_table(fit_year_models(lineitem_admissions(spark, sf_dir))), 5)


@query
def varcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_tables.varcomp_table(fit_year_models(lineitem_admissions(spark, sf_dir), ["m1", "m3"])), 5)


@query
def fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_tables.fit_stats(fit_year_models(lineitem_admissions(spark, sf_dir))).drop("passes"), 4)


@query
def compare_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fit_tables.fit_stats(fit_year_models(lineitem_admissions(spark, sf_dir), ["m1", "m3"]))
    return rounded(fit_tables.compare_fits(stats), 4)


def _year_estimates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fit_tables.level_estimates(fit_year_models(lineitem_admissions(spark, sf_dir), ["m3"]))


@query
def predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(est.predict_grid(*_year_estimates(spark, sf_dir)), 5)


@query
def figure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(est.figure_grid(est.predict_grid(*_year_estimates(spark, sf_dir)), FIGURE_YEARS), 5)


@query
def marginal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = est.linear_predictor(*_year_estimates(spark, sf_dir), est.CONTRAST_SCORES)
    return rounded(est.marginal_means(means), 5)


@query
def year_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of years at each score with both adjustments."""
    coef, cov = _year_estimates(spark, sf_dir)
    compared = est.contrasts(est.linear_predictor(coef, cov, est.CONTRAST_SCORES), cov)
    both = est.adjust(compared, "bonferroni").withColumnRenamed("p_value", "p_bonferroni")
    return rounded(est.adjust(both, "tukey"), 5)


@query
def year_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare_with_last(*_year_estimates(spark, sf_dir), LAST_YEAR), 5)


@query
def year_or_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_report(compare_with_last(*_year_estimates(spark, sf_dir), LAST_YEAR))


@query
def subgroup_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(make_subgroup_or(lineitem_admissions(spark, sf_dir), LAST_YEAR), 5)


@query
def season_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_season(lineitem_admissions(spark, sf_dir), LAST_YEAR, PREVIOUS_YEAR)
    return rounded(make_season_or(fit, PREVIOUS_YEAR), 5)
