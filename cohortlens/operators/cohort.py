"""Cohort preparation: factor levels, frequencies, subgroups, binding of dates, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ranking import numbered, numbered_with_total
from cohortlens.session import small_table

# Subgroup name -> (column, value); fixed values.
SUBGROUPS = {
    "surg": ("adm_type", "eSurgery"),
    "med": ("adm_type", "Medical"),
    "ecog0": ("ecog", "0"),
    "ecog1": ("ecog", "1"),
    "ecog2": ("ecog", "2"),
    "infection": ("infection", "1"),
    "mv": ("mv", "1"),
}


def level_table(spark: SparkSession, levels: Sequence[str]) -> DataFrame:
    """``level, idx`` with idx counted from 1 in the given order."""
    return small_table(
        spark, [(level, idx) for idx, level in enumerate(levels, start=1)], "level string, idx int"
    )


def used_levels(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """``level, idx`` of the levels that occur in the data, in the given order or else sorted as text, numbered from 1.

    ``distinct`` combines map-side, so every task ships each level once; nothing is collected. The levels are numbered by
    range partitions with offsets, so that a factor may have as many levels as a large table has units. With a given order
    there are at most as many as it names.
    """
    found = df.select(F.col(column).cast("string").alias("level")).where("level is not null").distinct()
    if order is None:
        return numbered(found, ["level"], "idx").withColumn("idx", F.col("idx").cast("int"))
    kept = level_table(df.sparkSession, order).join(found, "level", "left_semi")
    return kept.select("level", F.row_number().over(Window.orderBy("idx")).alias("idx"))


def as_factor(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Column as text, null where the value is not one of the levels."""
    known = levels.select(F.col("level").alias(column))
    text = df.withColumn(column, F.col(column).cast("string"))
    return text.join(known.withColumn("_known", F.lit(True)), column, "left").withColumn(
        column, F.when(F.col("_known"), F.col(column))
    ).select(df.columns)


def freq(df: DataFrame, column: str, levels: DataFrame | None = None) -> DataFrame:
    """``level, n``: counts per level, unused levels as 0, nulls left out."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if levels is None:
        return counts
    return levels.select("level").join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def member_of(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is in the list; null is not."""
    return df.where(F.col(column).isin(list(values)))


def tag_subgroups(
    df: DataFrame, subgroups: Mapping[str, tuple[str, str]] = SUBGROUPS, name: str = "subgroup"
) -> DataFrame:
    """One copy of a row per subgroup it belongs to; rows in none are left out.

    One pass over the input instead of a filter per subgroup. Works on records as on cells that still carry the subgroup
    columns; on cells the copies are made after the rows have been counted, which is the cheaper order.
    """
    tags = F.array_compact(F.array(*[
        F.when(F.col(column) == value, F.lit(tag)) for tag, (column, value) in subgroups.items()
    ]))
    columns = {column for column, _ in subgroups.values()}
    kept = [c for c in df.columns if c not in columns]
    return df.select(F.explode(tags).alias(name), *kept)


def subgroup(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with one value; null does not match."""
    return df.where(F.col(column) == value)


def attach_dates(
    admissions: DataFrame,
    dates: DataFrame,
    key: str = "admission_id",
    date: str = "unit_admission_date",
    name: str = "adm_date",
    one_to_one: bool = True,
) -> DataFrame:
    """Bind the admission date from a second table by key; admissions without a date stay, with a null.

    The dates must have one row per key, and so must the admissions unless ``one_to_one`` is off; a repeated key fails the
    job that reads the date. Both checks are counts per key on the exchanges that the join needs anyway. A null key matches
    nothing, so such rows don't take part in the join and stay in their tasks.
    """
    bound = dates.where(F.col(key).isNotNull()).select(key, F.col(date).cast("date").alias(name)).groupBy(key).agg(
        F.count(F.lit(1)).alias("_dates"), F.first(name).alias(name)
    )
    keyed = admissions.where(F.col(key).isNotNull())
    found = F.when(F.col("_dates") > 1, _failed(f"dates: {key} is not unique")).otherwise(F.col(name))
    if one_to_one:
        copies = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
        bound = copies.join(bound, key, "left")
        found = F.when(F.col("_copies") > 1, _failed(f"admissions: {key} is not unique")).otherwise(found)
    joined = keyed.join(bound, key, "left").select(*admissions.columns, found.alias(name))
    return joined.unionAll(
        admissions.where(F.col(key).isNull()).select(*admissions.columns, F.lit(None).cast("date").alias(name))
    )


def _failed(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("date")


def bind_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], column: str, name: str
) -> DataFrame:
    """Bind a column of ``right`` to ``left`` row by row, for tables that share an order but no key.

    An order has to be stated for each side and has to be total; for tables whose files lie in the right order,
    ``bind_file_position`` needs neither. The tables must have equally many rows. Each side is exchanged twice, for the sort
    and by position; that no two rows are equal in the order is checked on the sorted rows.
    """
    needed = list(dict.fromkeys([*right_order, column]))
    other, rows_right = numbered_with_total(right.select(needed), right_order, "_pos", "order")
    mine, rows_left = numbered_with_total(left, left_order, "_pos", "order")
    if rows_left != rows_right:
        raise ValueError(f"tables differ in length: {rows_left} and {rows_right} rows")
    return mine.join(other.select("_pos", F.col(column).alias(name)), "_pos").drop("_pos")


def relabel(df: DataFrame, column: str, labels: Mapping[str, str] | DataFrame, name: str = "label") -> DataFrame:
    """Report label of each level, looked up by level rather than by its place on an axis. Labels are a mapping or a table
    of the column and its label."""
    if not isinstance(labels, DataFrame):
        labels = small_table(df.sparkSession, list(labels.items()), f"{column} string, {name} string")
    return df.join(labels, column, "left").select(*df.columns, name)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null (or NaN) in any of the model columns, as plain conditions that reach the scan."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
        if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(~F.isnan(column))
    return df
