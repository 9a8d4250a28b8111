"""Lossless compression of records into counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.cohort import SUBGROUPS, complete_rows

TAGS_PER_SET = 62   # bits of a number


def cells(
    df: DataFrame,
    level: str = "adm_year",
    unit: str = "unit_code",
    score: str = "saps",
    outcome: str = "death",
    by: Sequence[str] = (),
) -> DataFrame:
    """``[by,] unit, level, saps, n, k``: rows and deaths per unit, level and score.

    A Bernoulli likelihood depends on the rows only through these counts, so every fit runs on them and nothing is lost.
    Rows with a null in a model column are left out, as a fit would do. Counts are combined map-side before the one
    shuffle; its key includes level and score, so a unit with a third of all rows is spread over many tasks.
    """
    complete = complete_rows(df, [unit, level, score, outcome])
    return complete.groupBy(
        *by,
        F.col(unit).cast("string").alias("unit"),
        F.col(level).cast("string").alias("level"),
        F.col(score).alias("saps"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("bigint")).alias("k"))


def merge_cells(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add up cells that differ only in columns that are no longer needed."""
    return df.groupBy(*by, "unit", "level", "saps").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def subgroup_cells(
    df: DataFrame,
    subgroups: Mapping[str, tuple[str, str]] = SUBGROUPS,
    level: str = "adm_year",
    name: str = "subgroup",
    **columns,
) -> DataFrame:
    """Cells of every subgroup from one scan.

    Records are first counted by the set of subgroups they belong to, one number in place of the subgroup columns. These counts
    are added up in columns of their own per subgroup, and only the finished sums are laid out as a row per subgroup: copies,
    of records or of counts, would multiply the rows of a shuffle and of the hash tables on both sides of it.
    """
    tags = list(subgroups)
    sets = [tags[at : at + TAGS_PER_SET] for at in range(0, len(tags), TAGS_PER_SET)]
    marks = [f"_tags{i}" for i in range(len(sets))]
    # a record in no subgroup takes no further part
    df = df.where(reduce(or_, [F.col(column) == value for column, value in subgroups.values()]))
    for mark, held in zip(marks, sets):
        bits = [F.when(F.col(subgroups[tag][0]) == subgroups[tag][1], F.lit(1 << i)).otherwise(0) for i, tag in enumerate(held)]
        df = df.withColumn(mark, reduce(add, [bit.cast("bigint") for bit in bits]))
    base = cells(df, level=level, by=marks, **columns)
    sums, rows = [], []
    for mark, held in zip(marks, sets):
        for i, tag in enumerate(held):
            inside = F.col(mark).bitwiseAND(F.lit(1 << i)) != 0
            sums += [F.sum(F.when(inside, F.col(c))).alias(f"{c}{mark}_{i}") for c in ("n", "k")]
            rows.append(F.struct(F.lit(tag).alias(name), *(F.col(f"{c}{mark}_{i}").alias(c) for c in ("n", "k"))))
    # at most a count per set of subgroups meets in a key, so there is nothing to gain from adding up before the exchange
    wide = base.repartition("unit", "level", "saps").groupBy("unit", "level", "saps").agg(*sums)
    return wide.select("unit", "level", "saps", F.inline(F.array(*rows))).where("n > 0").select(
        name, "unit", "level", "saps", "n", "k"
    )
