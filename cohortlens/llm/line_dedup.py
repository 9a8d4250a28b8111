"""Line deduplication against levelled sorted runs of line hashes.

Built from DataFrame functions only. Documents are taken in batches from the largest ids down. The runs hold the key of
every line kept so far, with the document that keeps it: a batch is merge-anti-joined with the runs, so that only keys
without a keeper are left; these get the largest document of the batch as keeper and are added as a run of their own.
When a level has ``fanout`` runs they are merged into one run of the next level, so that a batch meets few runs.

A run is range-partitioned and sorted by its key, written in the shared folder. Its size is that of the distinct repeated
keys; line texts are never shuffled, only two 64-bit hashes of them.

Defined results: a null or empty text is one empty line; null ids keep all their lines and count for nothing; rows that
share an id are one document with several texts; extra columns pass through, but one named like an output is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.shared import scratch_path, stored

# The characters stripped from a line and the letters lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column) -> Column:
    """128 bits for a key, as two numbers."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class SortedRuns:
    """Levelled sorted runs of ``h1, h2, keeper``; a key is in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key is in no run."""
        for level in self.levels:
            for run in level:
                batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, keys: DataFrame) -> DataFrame:
        """Write a run of new keys at the lowest level, compacting where a level is full; returns the new run."""
        run = self._write(keys)
        level = 0
        carry = run
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(carry)
            if len(self.levels[level]) < self.fanout:
                return run
            carry = self._write(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            level += 1

    def _write(self, keys: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "line-run")
        keys.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(keys.schema).parquet(path)


def _batch_number(doc_id: Column, cuts: list[int]) -> Column:
    """0 for the largest ids; cuts in descending order."""
    return reduce(lambda n, cut: n + (doc_id <= cut).cast("int"), cuts, F.lit(0))


def dropped_keys(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """``doc_id, h1, h2``: the keys whose lines a document loses. ``docs`` has ``doc_id, text``."""
    spark = docs.sparkSession
    keys = F.filter(F.transform(text_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    found = stored(
        docs.where("doc_id is not null")
        .select("doc_id", F.inline(F.array_distinct(F.transform(keys, key_hash)))), "line-keys"
    )
    common = (
        found.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs).select("h1", "h2")
    )
    # which documents hold a common key; the hot keys stay on the side that adaptive execution can split
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares).alias("c")).first()["c"] or []
    repeated = stored(
        found.join(common, ["h1", "h2"], "left_semi").distinct()
        .withColumn("batch", _batch_number(F.col("doc_id"), sorted(set(cuts), reverse=True))),
        "line-repeated",
    )
    runs, lost = SortedRuns(spark, fanout), []
    for number in range(len(set(cuts)) + 1):
        batch = repeated.where(F.col("batch") == number).drop("batch")
        fresh = runs.unseen(batch).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"))
        run = runs.add(fresh)
        own = run.select("h1", "h2", F.col("keeper").alias("doc_id"))
        lost.append(batch.join(own, ["h1", "h2", "doc_id"], "left_anti").select("doc_id", "h1", "h2"))
    return reduce(DataFrame.unionByName, lost)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3,
) -> DataFrame:
    """The documents with the lines that repeat across documents taken out of ``text_col``, and ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays only in the largest document that
    holds it, there in all its lines. Other lines stay, in order.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lost = dropped_keys(own, min_chars, min_docs, batches, fanout)
    lost = lost.groupBy(F.col("doc_id").alias("_lost_from")).agg(F.collect_list(F.struct("h1", "h2")).alias("_lost"))
    joined = docs.join(lost, F.col(id_col) == F.col("_lost_from"), "left")
    lines = text_lines(F.col(text_col))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("_lost"), key_hash(key))

    untouched = F.col("_lost").isNull()
    # a text all of whose lines go and one whose single line stays empty look alike, so lines are counted in the array
    counted = joined.withColumns({"_kept": F.when(~untouched, F.filter(lines, stays)), "n_lines": F.size(lines).cast("bigint")})
    return counted.withColumns({
        "n_dropped": F.when(untouched, F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("bigint"),
        text_col: F.when(untouched, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join("_kept", "\n")),
    }).drop("_kept", "_lost", "_lost_from")
