"""Rounding and number-to-text expressions for report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_columns(df: DataFrame, digits: int = 3) -> DataFrame:
    """Every column as a number, rounded half to even."""
    return df.select([F.bround(F.col(name).cast("double"), digits).alias(name) for name in df.columns])


def number_text(x: Column, digits: int = 3) -> Column:
    """A rounded number without trailing zeros: 1.000 is shown as 1, 0.250 as 0.25; a missing one as NA."""
    fixed = F.format_string(f"%.{digits}f", x)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("NA"))
        .when(x == float("inf"), F.lit("Inf"))
        .when(x == float("-inf"), F.lit("-Inf"))
        .otherwise(F.regexp_replace(F.regexp_replace(fixed, r"\.?0+$", ""), r"^-0$", "0"))
    )


def ratio_text(ratio: Column, lower: Column, upper: Column) -> Column:
    """``ratio [lower-upper]`` with trimmed numbers."""
    return F.concat(
        number_text(ratio), F.lit(" ["), number_text(lower), F.lit("-"), number_text(upper), F.lit("]")
    )


def percent_text(probability: Column) -> Column:
    """A probability as a whole percentage."""
    return F.format_string("%.0f%%", probability * 100)
