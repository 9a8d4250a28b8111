"""Scaled residuals of a fit, and exact quantiles of counted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.mixed import FitSet, require_finished, with_linear_predictor
from cohortlens.operators.ranking import running_totals
from cohortlens.session import small_table

FIVE_NUMBERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def weighted_quantiles(
    df: DataFrame, value: str, weight: str, probabilities: Sequence[float] = FIVE_NUMBERS, by: str = "model"
) -> DataFrame:
    """``by, probability, quantile``: quantiles of ``value`` per group, every row standing for ``weight`` equal values.

    Exact: the values that n rows would have at the 0-based ranks around (n - 1) p, interpolated. Rows of one value are
    counted first, map-side. The distinct values are sorted by range partitions, counts are cumulated within a partition and
    moved by the totals of those before it, and the wanted ranks are looked up in the intervals they fall in; no group is
    ever in one task because it is large. The driver sees one total per partition and one per group.

    Rows without a value or with no positive weight do not count; a group without any others is left out. ``by`` may be
    null, which is a group of its own. The number of groups has to be small: they are models, not units.
    """
    spark = df.sparkSession
    counted = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(
        F.col(by).alias("grp"), F.col(value).cast("double").alias("v")
    ).agg(F.sum(F.col(weight).cast("bigint")).alias("w"))
    upto, _ = running_totals(counted, ["grp", "v"], "w", "high")
    cumulated = upto.withColumn("low", F.col("high") - F.col("w"))
    # groups lie one after another in the order of the sort; a null group comes first
    groups = {r["grp"]: r["w"] for r in cumulated.groupBy("grp").agg(F.sum("w").alias("w")).collect()}
    wanted, first = [], 0
    for name in sorted(groups, key=lambda x: (x is not None, x)):
        for p in probabilities:
            place = (groups[name] - 1) * p
            lower = int(place)
            upper = min(lower + 1, groups[name] - 1)
            wanted += [(float(p), first + lower, 1.0 - (place - lower)), (float(p), first + upper, place - lower)]
        first += groups[name]
    ranks = small_table(spark, wanted, "probability double, place bigint, share double")
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    found = cumulated.join(F.broadcast(ranks), inside)
    return found.groupBy("grp", "probability").agg(F.sum(F.col("v") * F.col("share")).alias("quantile")).select(
        F.col("grp").alias(by), "probability", "quantile"
    )


def scaled_residuals(fit: FitSet, allow_unfinished: bool = False) -> DataFrame:
    """``model, residual, n``: Pearson residuals of all records, as counts per cell and outcome."""
    require_finished(fit, allow_unfinished)
    half = F.exp(F.col("eta") / 2)     # square root of the odds
    sides = F.array(
        F.struct((1 / half).alias("residual"), F.col("k").cast("bigint").alias("n")),
        F.struct((-half).alias("residual"), (F.col("n") - F.col("k")).cast("bigint").alias("n")),
    )
    return with_linear_predictor(fit).select("model", F.inline(sides)).where("n > 0")


def residual_quantiles(
    fit: FitSet, probabilities: Sequence[float] = FIVE_NUMBERS, allow_unfinished: bool = False
) -> DataFrame:
    """``model, probability, quantile`` of the scaled residuals of all records."""
    return weighted_quantiles(scaled_residuals(fit, allow_unfinished), "residual", "n", probabilities)
