"""Tables written in the shared folder of the cluster, and the code in the Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_path, ship_package, stored

__all__ = ["crc_remainder", "discarded", "own_columns", "scratch_path", "ship_package", "stored"]


def own_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` alone, so that no other column of the input can clash with a name used inside."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def discarded(spark: SparkSession, path: str | None) -> None:
    """Remove a table of this package's own that was written to the shared folder and has served its purpose."""
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
