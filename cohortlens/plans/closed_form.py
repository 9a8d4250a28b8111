"""Contrasts of the model with one free parameter per level and score: estimates straight from counts, no iteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import estimates as est
from cohortlens.operators.cells import cells
from cohortlens.operators.cohort import used_levels
from cohortlens.session import checkpoint_dir


def closed_form(records: DataFrame, level: str = "adm_year", levels: Sequence[str] | None = None) -> DataFrame:
    """Log odds and variance per level and score over all records, which are read once: the counts are checkpointed."""
    checkpoint_dir(records.sparkSession)
    counted = cells(records, level=level, unit=level).checkpoint()
    names = used_levels(counted, "level", levels)
    return est.closed_form_means(counted.join(names, "level").withColumn("model", F.lit("counts")))
