"""Report-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import percent_text, ratio_text, round_columns


def or_report(ors: DataFrame, ordered: bool = True) -> DataFrame:
    """``saps``, ``odds_ratio2`` as "ratio [lower-upper]" and ``p_value``, three decimals throughout."""
    if ordered:
        ors = ors.orderBy("saps", "idx_a", "idx_b")
    rounded = round_columns(ors.select("saps", "odds_ratio", "lower", "upper", "p_value"))
    text = ratio_text(F.col("odds_ratio"), F.col("lower"), F.col("upper"))
    return rounded.withColumn("odds_ratio2", text).select("saps", "odds_ratio2", "p_value")


def percent_curve(predictions: DataFrame) -> DataFrame:
    """Predictions with the percentage shown on the axis."""
    return predictions.withColumn("predicted_percent", percent_text(F.col("predicted")))
