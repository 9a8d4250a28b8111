"""Grids, predictions, marginal means, contrasts and odds-ratio tables, as DataFrames.

Inputs are level estimates, one row per model and level:

``coef``  model, level, idx, a, c                       log odds = a + c * saps
``cov``   model, idx_a, idx_b, v_aa, v_ac, v_ca, v_cc   covariances of (a, c) of level idx_a with (a, c) of level idx_b

Their size is set by the number of factor levels and scores, never by the number of records.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.stats import tukey_upper, two_sided_p

# Scores of the contrast tables, scores of the prediction curve, interval factor of the odds-ratio table.
CONTRAST_SCORES = [20, 30, 40, 50, 60, 70, 80, 90, 100]
CURVE_SCORES = list(range(30, 101))
OR_INTERVAL = 1.96
# Predictions and marginal means use the exact 97.5 % point of the normal distribution.
EXACT_INTERVAL = 1.959963984540054


def reference_grid(levels: DataFrame, scores: Sequence[float]) -> DataFrame:
    """Every level at every score."""
    return levels.withColumn("saps", F.explode(F.array(*[F.lit(s) for s in scores])))


def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def linear_predictor(coef: DataFrame, cov: DataFrame, scores: Sequence[float]) -> DataFrame:
    """``model, saps, level, idx, eta, var_eta`` over the grid, unit effects set to zero."""
    own = cov.where("idx_a = idx_b").select("model", F.col("idx_a").alias("idx"), "v_aa", "v_ac", "v_ca", "v_cc")
    grid = reference_grid(coef.join(own, ["model", "idx"]), scores)
    s = F.col("saps")
    return grid.select(
        "model", "saps", "level", "idx",
        (F.col("a") + F.col("c") * s).alias("eta"),
        _quadratic(s).alias("var_eta"),
    )


def _quadratic(s: Column) -> Column:
    return F.col("v_aa") + (F.col("v_ac") + F.col("v_ca")) * s + F.col("v_cc") * s * s


def predict_grid(
    coef: DataFrame, cov: DataFrame, scores: Sequence[float] = CURVE_SCORES, z: float = EXACT_INTERVAL
) -> DataFrame:
    """Predicted probability with its interval, built on the log-odds scale: ``model, x, group, predicted, ...``."""
    eta, se = F.col("eta"), F.sqrt("var_eta")
    return linear_predictor(coef, cov, scores).select(
        "model",
        F.col("saps").alias("x"),
        F.col("level").alias("group"),
        logistic(eta).alias("predicted"),
        se.alias("std_error"),
        logistic(eta - z * se).alias("conf_low"),
        logistic(eta + z * se).alias("conf_high"),
    )


def figure_grid(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The predictions drawn in a figure: chosen groups only."""
    return predictions.where(F.col("group").isin(list(groups)))


def marginal_means(means: DataFrame, z: float = EXACT_INTERVAL) -> DataFrame:
    """Probability per level and score, with delta-method error and an interval back-transformed from log odds."""
    eta, se = F.col("eta"), F.sqrt("var_eta")
    prob = logistic(eta)
    return means.select(
        "model", "saps", "level", "idx",
        prob.alias("prob"),
        (prob * (1 - prob) * se).alias("se"),
        F.lit(float("inf")).alias("df"),
        logistic(eta - z * se).alias("lower"),
        logistic(eta + z * se).alias("upper"),
    )


def closed_form_means(counts: DataFrame) -> DataFrame:
    """Log odds and variance straight from counts ``model, saps, level, idx, n, k``: the model with one free parameter
    per level and score. Levels are then independent, so contrasts of them need no ``cov``. A level without deaths or without
    survivors at a score has no estimate there: it stays with nulls, and counts in the family of the adjustments."""
    k, alive = F.col("k"), F.col("n") - F.col("k")
    known = (k > 0) & (alive > 0)
    return counts.select(
        "model", "saps", "level", "idx",
        F.when(known, F.log(k / alive)).alias("eta"),
        F.when(known, 1 / k + 1 / alive).alias("var_eta"),
    )


def level_pairs(means: DataFrame) -> DataFrame:
    """Every unordered pair of levels within a model and score, the earlier level first; ``family`` is the number of
    levels compared there. An equality join on model and score with the order of the levels as residual condition."""
    side = lambda tag: means.select(
        "model", "saps",
        *[F.col(c).alias(f"{c}_{tag}") for c in means.columns if c not in ("model", "saps", "family")],
        *(["family"] if tag == "a" else []),
    )
    means = means.withColumn("family", F.count(F.lit(1)).over(Window.partitionBy("model", "saps")))
    return side("a").join(side("b"), ["model", "saps"]).where("idx_a < idx_b")


def contrasts(means: DataFrame, cov: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Pairwise odds ratios of the levels within each score.

    ``odds_ratio`` is first level over second, ``se`` belongs to the odds-ratio scale and ``se_log`` to the log scale.
    ``reverse`` puts the later level first. ``family`` is kept for the adjustment of p-values.
    """
    pairs = level_pairs(means)
    if cov is None:
        shared = F.lit(0.0)
    else:
        pairs = pairs.join(cov, ["model", "idx_a", "idx_b"])
        shared = _quadratic(F.col("saps"))
    sign, first, second = (-1, "b", "a") if reverse else (1, "a", "b")
    out = pairs.select(
        "model", "saps", "family",
        F.col(f"level_{first}").alias("level_a"),
        F.col(f"level_{second}").alias("level_b"),
        F.col(f"idx_{first}").alias("idx_a"),
        F.col(f"idx_{second}").alias("idx_b"),
        (sign * (F.col("eta_a") - F.col("eta_b"))).alias("log_or"),
        F.sqrt(F.col("var_eta_a") + F.col("var_eta_b") - 2 * shared).alias("se_log"),
    )
    ratio = F.exp("log_or")
    return out.select(
        "model", "saps",
        F.concat_ws(" / ", "level_a", "level_b").alias("contrast"),
        "level_a", "level_b", "idx_a", "idx_b", "log_or", "se_log",
        ratio.alias("odds_ratio"),
        (ratio * F.col("se_log")).alias("se"),
        F.lit(float("inf")).alias("df"),
        F.lit(1.0).alias("null"),
        (F.col("log_or") / F.col("se_log")).alias("z_ratio"),
        "family",
    )


def adjust(compared: DataFrame, method: str = "tukey") -> DataFrame:
    """Add ``p_value``: ``none``, ``bonferroni`` (times the pairs in the score) or ``tukey`` (range of the levels).

    The family is all pairs within one model and score; filter to the comparisons of interest afterwards.
    """
    z = F.abs("z_ratio")
    if method == "none":
        p = two_sided_p(z)
    elif method == "bonferroni":
        p = F.least(F.lit(1.0), two_sided_p(z) * (F.col("family") * (F.col("family") - 1) / 2))
    elif method == "tukey":
        p = tukey_upper(z * math.sqrt(2), F.col("family"))
    else:
        raise ValueError("method must be 'none', 'bonferroni' or 'tukey'")
    # comparisons without an estimate count in the family but have no p
    return compared.withColumn("p_value", F.when(z.isNotNull(), p))


def vs_reference(compared: DataFrame, reference: str, side: str = "second") -> DataFrame:
    """Comparisons with one level, which stands second in the contrast or, with ``side="either"``, on any side."""
    if side == "second":
        return compared.where(F.col("level_b") == reference)
    if side == "either":
        return compared.where((F.col("level_a") == reference) | (F.col("level_b") == reference))
    raise ValueError("side must be 'second' or 'either'")


def or_table(
    compared: DataFrame, invert: bool = True, se_scale: str = "log", z: float = OR_INTERVAL
) -> DataFrame:
    """Odds ratios with interval, ready for a figure or report.

    ``invert`` turns "y / reference" into reference / y; ``or_direction`` states what is divided by what, whereas
    ``contrast`` keeps the label of the comparison as it came in. ``se_scale="log"`` builds the interval with the log-scale
    error. ``se_scale="ratio"`` reproduces the original tables, which took the error of the odds-ratio scale (of the ratio
    before inversion) for a log-scale one.
    """
    if se_scale not in ("log", "ratio"):
        raise ValueError("se_scale must be 'log' or 'ratio'")
    top, bottom = ("level_b", "level_a") if invert else ("level_a", "level_b")
    center = -F.log("odds_ratio") if invert else F.log("odds_ratio")
    error = F.col("se_log") if se_scale == "log" else F.col("se")
    return compared.select(
        "model", "saps", "contrast", "level_a", "level_b", "idx_a", "idx_b",
        F.concat_ws(" / ", top, bottom).alias("or_direction"),
        F.exp(center).alias("odds_ratio"),
        F.exp(center - z * error).alias("lower"),
        F.exp(center + z * error).alias("upper"),
        error.alias("se"),
        "p_value",
    )
