import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import fit_tables
from cohortlens.operators.cells import cells
from cohortlens.operators.mixed import fit_mixed_logit
from cohortlens.plans import seasonal, subgroups, year_effect
from cohortlens.sources.admissions import read_extract
from cohortlens.sources.lineitem_cohort import LAST_YEAR, PREVIOUS_YEAR, lineitem_admissions


@pytest.fixture(scope="module")
def admissions(spark, sf_dir):
    return lineitem_admissions(spark, sf_dir).where("adm_year >= '1999'").cache()


@pytest.fixture(scope="module")
def year(admissions):
    return year_effect.year_effect(admissions, LAST_YEAR, [PREVIOUS_YEAR, LAST_YEAR])


def test_year_effect(year):
    stats = {row.model: row for row in year.statistics.collect()}
    assert {name: row.npar for name, row in stats.items()} == {"m1": 6 + 1, "m2": 4 + 6, "m3": 6 + 6}
    assert all(row.converged for row in stats.values())
    assert stats["m3"].log_lik >= stats["m1"].log_lik - 1e-6 and stats["m3"].log_lik >= stats["m2"].log_lik - 1e-6
    small, large = year.comparison.orderBy("npar").collect()
    assert (small.model, large.model, large.df) == ("m1", "m3", 5)
    assert large.chisq == pytest.approx(2 * (stats["m3"].log_lik - stats["m1"].log_lik), abs=1e-9)
    assert year.predictions.count() == 71 * 3 and year.figure.count() == 71 * 2
    assert year.means.count() == 9 * 3 and year.compared.count() == 9 * 3
    assert year.coefficients.where("model = 'm2'").count() == 4
    assert year.variances.where("model = 'm1'").count() == 1 and year.variances.where("model = 'm3'").count() == 6


def test_year_report(year):
    ors = {(r.saps, r.level_a): r for r in year.odds_ratios.collect()}
    assert len(ors) == 9 * 2 and all(r.or_direction == f"{LAST_YEAR} / {r.level_a}" for r in ors.values())
    # the family of the adjustment is all pairs, not only those that are kept
    tukey = {(r.saps, r.level_a): r.p_value for r in year.compared.where(F.col("level_b") == LAST_YEAR).collect()}
    assert all(row.p_value == pytest.approx(tukey[key]) for key, row in ors.items())
    bonferroni = year.compared_bonferroni.collect()
    assert all(row.family == 3 for row in bonferroni)
    report = year.report.collect()
    assert [row.saps for row in report] == sorted(row.saps for row in report)
    assert all(row.odds_ratio2.count("[") == 1 for row in report)


def test_models_of_one_batch_equal_the_single_fit(admissions, year):
    alone = fit_mixed_logit(cells(admissions)).models["model"]
    assert year.fit.models["m3"].log_lik == pytest.approx(alone.log_lik, abs=1e-6)


def test_subgroups_equal_separate_fits(spark, admissions):
    chosen = {"med": ("adm_type", "Medical"), "mv": ("mv", "1")}
    table = subgroups.subgroup_or(admissions, LAST_YEAR, chosen)
    assert table.groupBy("model").count().collect() and table.count() == 2 * 9 * 2
    for name, (column, value) in chosen.items():
        fit = fit_mixed_logit(cells(admissions.where(F.col(column) == value)))
        alone = year_effect.compare_with_last(*fit_tables.level_estimates(fit), LAST_YEAR)
        expected = {(r.saps, r.level_a): r for r in alone.collect()}
        for row in table.where(F.col("model") == name).collect():
            other = expected[row.saps, row.level_a]
            assert row.odds_ratio == pytest.approx(other.odds_ratio, rel=1e-4)
            assert (row.lower, row.upper) == pytest.approx((other.lower, other.upper), rel=1e-3)


def test_season_from_two_tables(spark, sf_dir, tmp_path):
    """Dates from a second table, extract saved and read back, phases, fit, odds ratios in both directions."""
    records = lineitem_admissions(spark, sf_dir).withColumn("admission_id", F.monotonically_increasing_id().cast("string")).cache()
    dates = records.select("admission_id", F.col("adm_date").alias("unit_admission_date"))
    path = str(tmp_path / "season")
    extract = seasonal.season_extract(records.drop("adm_date"), dates, path=path)
    assert extract.columns == ["saps", "death", "unit_code", "adm_year", "adm_date"]
    stored = read_extract(spark, path)
    assert stored.count() == records.count() and stored.select("adm_year").distinct().count() == 7
    fit = seasonal.fit_season(stored, LAST_YEAR, PREVIOUS_YEAR)
    assert fit.models["model"].converged
    table = {(r.saps, r.level_a): r for r in seasonal.season_or(fit, PREVIOUS_YEAR).collect()}
    old = {(r.saps, r.level_a): r for r in seasonal.season_or(fit, PREVIOUS_YEAR, compat=True).collect()}
    assert len(table) == 36 and set(table) == set(old)
    for key, row in table.items():
        assert row.or_direction == f"{key[1]} / {PREVIOUS_YEAR}" and row.contrast == row.or_direction
        assert row.label == f"{seasonal.PHASE_NAMES[key[1]]}/{PREVIOUS_YEAR}"
        assert old[key].label == f"{PREVIOUS_YEAR}/{seasonal.PHASE_NAMES[key[1]]}"
        assert old[key].or_direction == f"{PREVIOUS_YEAR} / {key[1]}" and old[key].contrast == row.contrast
        assert old[key].odds_ratio == pytest.approx(1 / row.odds_ratio)
        # the ratio-scale error is that of the ratio before inversion
        width = np.log(row.upper / row.lower)
        assert np.log(old[key].upper / old[key].lower) == pytest.approx(width * row.odds_ratio)
        assert old[key].p_value == pytest.approx(row.p_value)
