"""The cohort schema laid over the order tables, for tests, checks and benchmarks.

The values mean nothing clinically; only types and shapes matter. The last year of the table plays the reference year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.admissions import read_admissions

LINEITEM_SCHEMA = (
    "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)

LAST_YEAR = "2001"
PREVIOUS_YEAR = "2000"


def lineitem_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as admissions, with its order number as join key and ship date as admission date."""
    line = read_admissions(spark, f"{sf_dir}/lineitem.parquet", schema=LINEITEM_SCHEMA)
    flag = lambda condition: condition.cast("int").cast("string")
    return line.select(
        F.col("l_orderkey"),
        F.col("l_suppkey").cast("string").alias("unit_code"),
        (F.col("l_quantity") * 2).cast("int").alias("saps"),
        (F.col("l_returnflag") == "R").cast("int").alias("death"),
        F.year("l_shipdate").cast("string").alias("adm_year"),
        F.when(F.col("l_linestatus") == "O", "eSurgery").otherwise("Medical").alias("adm_type"),
        (F.col("l_linenumber") % 3).cast("string").alias("ecog"),
        flag(F.col("l_tax") >= 0.04).alias("infection"),
        flag(F.col("l_discount") >= 0.05).alias("mv"),
        F.col("l_shipdate").cast("date").alias("adm_date"),
    )


def varied_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same admissions with an outcome that differs between units, so that the variance of unit effects is not zero: in
    units of the first kind all but the first two lines of an order count as deaths, in the next all but three, and so on."""
    line = read_admissions(spark, f"{sf_dir}/lineitem.parquet", schema=LINEITEM_SCHEMA)
    died = (F.col("l_returnflag") == "R") | (F.col("l_linenumber") > 2 + F.col("l_suppkey") % 5)
    return line.select(
        F.col("l_suppkey").cast("string").alias("unit_code"), (F.col("l_quantity") * 2).cast("int").alias("saps"),
        died.cast("int").alias("death"), F.year("l_shipdate").cast("string").alias("adm_year"),
    )
