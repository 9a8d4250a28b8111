"""Reading admissions and writing extracts and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ADMISSIONS_SCHEMA = T.StructType([
    T.StructField("admission_id", T.StringType()),
    T.StructField("unit_code", T.StringType()),
    T.StructField("saps", T.IntegerType()),
    T.StructField("death", T.IntegerType()),
    T.StructField("adm_year", T.StringType()),
    T.StructField("adm_type", T.StringType()),
    T.StructField("ecog", T.StringType()),
    T.StructField("infection", T.StringType()),
    T.StructField("mv", T.StringType()),
])

ADMISSION_DATES_SCHEMA = T.StructType([
    T.StructField("admission_id", T.StringType()),
    T.StructField("unit_admission_date", T.DateType()),
])

EXTRACT_COLUMNS = ["saps", "death", "unit_code", "adm_year", "adm_date"]


def read_admissions(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str = ADMISSIONS_SCHEMA,
    **options,
) -> DataFrame:
    """Read a table with a declared schema; no inference pass, so only needed columns and row groups are scanned."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        options = {"header": True, "mode": "FAILFAST", **options}
    return reader.options(**options).load(path)


def write_extract(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save the seasonal extract, all years, one folder per year so that a later year filter prunes folders.

    Rows are rebalanced by year first: adaptive execution splits a year that holds most rows over many tasks and merges
    small ones, so the number of files follows the size of the data instead of tasks times years.
    """
    df.select(EXTRACT_COLUMNS).hint("rebalance", "adm_year").write.mode(mode).partitionBy("adm_year").parquet(path)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """Read an extract back; the year keeps its string type although it comes from folder names."""
    schema = T.StructType([
        T.StructField("saps", T.IntegerType()),
        T.StructField("death", T.IntegerType()),
        T.StructField("unit_code", T.StringType()),
        T.StructField("adm_date", T.DateType()),
        T.StructField("adm_year", T.StringType()),
    ])
    return read_admissions(spark, path, schema=schema)


def write_report(report: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a finished report as one file.

    Reports have one row per level (or pair of levels) and score, whatever the size of the cohort, so a single output
    task is enough.
    """
    writer = report.coalesce(1).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def shown(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Print a result, all of it unless a number of rows is given, and pass it on."""
    df.show(df.count() if rows is None else rows, truncate=False)
    return df
