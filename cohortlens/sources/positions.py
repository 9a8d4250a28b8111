"""Row positions of Parquet tables from their files, and binding of tables that share nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ranking import running_totals


def read_with_position(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, name: str = "pos"
) -> tuple[DataFrame, int]:
    """The columns of a Parquet table with ``name``, the 0-based position of each row, and the number of rows.

    A row's position is its index in its file after the rows of all files that come before by name, which is how a sorted
    table is written. Nothing is sorted but the list of files, and counting their rows reads no column. The list of files
    is joined by its own size: it is broadcast only while it is below the session's broadcast threshold. A column called
    ``name`` in the table is replaced; a table without rows gives none.
    """
    table = spark.read.parquet(path)
    kept = [f"`{c}`" for c in columns or table.columns if c != name]
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = table.groupBy(file.alias("_file")).agg((F.max(row) + 1).alias("_rows"))
    totals, total = running_totals(sizes, ["_file"], "_rows", "_upto")
    starts = totals.select("_file", (F.col("_upto") - F.col("_rows")).alias("_start"))
    rows = table.select(*kept, file.alias("_file"), row.alias("_row"))
    return rows.join(starts, "_file").select(*kept, (F.col("_start") + F.col("_row")).alias(name)), total


def bind_file_position(
    spark: SparkSession, left: str, right: str, column: str, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The columns of the table at ``left`` with one column of the table at ``right``, row by row as they lie in the files.

    The tables must have equally many rows. Each side is exchanged once, by position.
    """
    mine, rows_left = read_with_position(spark, left, columns, "_position")
    other, rows_right = read_with_position(spark, right, [column], "_position")
    if rows_left != rows_right:
        raise ValueError(f"tables differ in length: {rows_left} and {rows_right} rows")
    kept = [f"`{c}`" for c in mine.columns if c not in ("_position", name)]
    bound = other.select("_position", F.col(f"`{column}`").alias("_bound"))
    return mine.join(bound, "_position").select(*kept, F.col("_bound").alias(name))
