"""Places and running totals along a total order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import scratch_path, small_table

PART, ROW, START = "_ranked_part", "_ranked_row", "_ranked_start"


def _sorted_rows(df: DataFrame, order: Sequence[Column | str], check: Column | None = None) -> DataFrame:
    """The rows sorted by range partitions and written to the shared folder with their partition and their row in it, so
    that all that follows sees the same rows even after an executor is lost."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    path = scratch_path(spark, "sorted")
    ordered = df.orderBy(*order)
    if check is not None:
        ordered = ordered.where(check)
    placed = ordered.select(
        "*", F.shiftright(at, 33).cast("int").alias(PART), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(ROW)
    )
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _starts(placed: DataFrame, totals: Column) -> tuple[DataFrame, int]:
    """What lies before each partition, one row per partition, and the total."""
    starts, total = [], 0
    for found in sorted(placed.groupBy(PART).agg(totals.alias("total")).collect(), key=lambda r: r[PART]):
        starts.append((found[PART], total))
        total += found["total"]
    return F.broadcast(small_table(placed.sparkSession, starts, f"{PART} int, {START} bigint")), total


def numbered(
    df: DataFrame, order: Sequence[Column | str], name: str = "idx", unique: str | None = None
) -> DataFrame:
    """``df`` with ``name``: the place of each row in the given order, counted from 1, as a long.

    A range-partitioned sort puts row r of partition p at offset(p) + r. Only one number per partition reaches the driver.
    Rows that are equal in all keys get their places arbitrarily; they also share a partition, so an order with very many
    equal rows should end in a key that tells them apart. ``unique`` (what the table is called) instead fails the job if any
    two rows are equal in all keys, which have to be columns then; the check runs on the sorted rows, without an exchange.

    A null sorts as the order says; an empty table stays empty; a column called ``name`` is replaced.
    """
    return _numbered(df, order, name, unique)[0]


def numbered_with_total(
    df: DataFrame, order: Sequence[Column | str], name: str = "idx", unique: str | None = None
) -> tuple[DataFrame, int]:
    """``numbered`` and the number of rows."""
    return _numbered(df, order, name, unique)


def _numbered(df, order, name, unique) -> tuple[DataFrame, int]:
    kept = df.drop(name)
    check = None
    if unique is not None:
        # equal rows share a range partition and lie side by side there
        copies = F.count(F.lit(1)).over(Window.partitionBy(*order))
        kept = kept.repartitionByRange(*order).withColumn("_ranked_copies", copies)
        message = F.raise_error(F.lit(f"{unique}: {', '.join(map(str, order))} is not unique"))
        check = F.when(F.col("_ranked_copies") > 1, message.cast("boolean")).otherwise(F.lit(True))
    placed = _sorted_rows(kept, order, check)
    offsets, total = _starts(placed, F.max(ROW) + 1)
    found = placed.join(offsets, PART).select(
        *[f"`{c}`" for c in df.columns if c != name], (F.col(START) + F.col(ROW) + 1).alias(name)
    )
    return found, total


def running_totals(df: DataFrame, order: Sequence[Column | str], weight: str, name: str = "upto") -> tuple[DataFrame, int]:
    """``df`` with ``name``: the sum of the whole numbers in ``weight`` over this and all earlier rows in the given order; and
    the sum over all. Sums run within range partitions and are moved by the totals of the partitions before."""
    placed = _sorted_rows(df.drop(name), order)
    offsets, total = _starts(placed, F.sum(weight))
    within = F.sum(weight).over(Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("_ranked_sum", within).join(offsets, PART).select(
        *[f"`{c}`" for c in df.columns if c != name], (F.col(START) + F.col("_ranked_sum")).alias(name)
    )
    return found, total
