"""A bit filter of fixed size over ids, so that texts which a join would only throw away, or only pass on, aren't shuffled.

The filter is built by grouped bitmap aggregates and broadcast; it takes ``FILTER_BITS`` bits whatever the input. It may let
an id through that is not in the set, never the other way round. With very many ids it fills up and saves nothing, but
results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27


def _place(id_column: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(FILTER_BITS))


def marked(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``_hit``: whether the filter of the ids (their only column) has the row's id."""
    name = ids.columns[0]
    bits = ids.select(_place(F.col(name).cast("bigint")).alias("p")).distinct().groupBy(
        F.bitmap_bucket_number("p").alias("_bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    place = _place(F.col(id_col).cast("bigint"))
    at = F.bitmap_bit_position(place)
    byte = F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (at % 8).cast("int")) == 1
    found = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return found.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def perhaps_with(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows with an id of the set, and a few others."""
    return marked(df, id_col, ids).where("_hit").drop("_hit")


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows without an id of the set, exactly; only rows that the filter lets through are shuffled to be looked up."""
    name = ids.columns[0]
    found = marked(df, id_col, ids)
    known = ids.select(F.col(name).cast("bigint").alias("_known")).distinct()
    sure = found.where("NOT _hit").drop("_hit")
    rest = found.where("_hit").drop("_hit")
    return sure.unionByName(rest.join(known, rest[id_col].cast("bigint") == F.col("_known"), "left_anti"))
