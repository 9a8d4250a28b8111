"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_year_blocks(date: Column | str) -> Column:
    """Week as a seven-day block counted from 1 January, so 1..53; this is not the ISO week of ``weekofyear``."""
    return (F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("int")
