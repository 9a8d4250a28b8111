"""Importance resampling towards a target distribution, over hashed n-grams.

Two passes over the texts, both of Arrow kernels on whole columns: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten``
and ``dictionary_encode`` turn the words of a batch into indices; indices shifted against each other form n-grams, each a pair
of a shorter n-gram and a word; every distinct pair gets its CRC once, from the CRCs of its two halves. The first pass counts
buckets: a task sends one row of counts, so a bucket that holds most features costs no more than any other. The second pass
takes the gains of the buckets and sums them over the segment of every document. Only counts and gains per bucket reach the
driver; their number is a parameter.

The draw keeps the best scores plus Gumbel noise from a hash of seed and id. Ranks come from a range-partitioned sort with
offsets per partition, never from one task.

Rows and columns: null and empty texts have no words, no features and weight 0, and are never drawn. Rows that share an id are
documents of their own; a null id counts as an empty text in the noise and comes after all ids in ties; equal scores go to the
smaller id, then by features and weight, and rows equal in all of these are told apart arbitrarily. Columns other than id and
text are not read and cannot clash. An empty table gives no rows; an empty target leaves only the pull of the smoothing.
Malformed UTF-8 is taken as bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import release_memory
from cohortlens.llm.shared import own_columns, ship_package, stored
from cohortlens.operators.ranking import numbered

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # bytes between words; fixed value
BUCKETS = 10_000
LONGEST = 3            # words in a feature
SLICE_BYTES = 2 << 20  # text handled at once; a longer text is handled alone
_CRC_POLYNOMIAL = 0xEDB88320


# ---------------------------------------------------------------------------------------------------------------------
# CRC of a pair from the CRCs of its halves


def _times_x(crc: np.ndarray) -> np.ndarray:
    """Multiplication by x, one bit of the register."""
    return (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(_CRC_POLYNOMIAL), np.uint32(0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC's, entry by entry; the highest bit is the constant term."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = _times_x(b)
    return out


def _byte_powers(lengths: np.ndarray) -> np.ndarray:
    """x to the power of 8 times each length."""
    out = np.full(len(lengths), 1 << 31, np.uint32)
    square, left = np.full(1, 1 << 23, np.uint32), lengths.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _product(out[odd], square)
        square, left = _product(square, square), left >> 1
    return out


class _Appender:
    """What it does to a CRC that one of some words follows: four table look-ups per CRC, one table per length of word."""

    def __init__(self, crcs: np.ndarray, lengths: np.ndarray):
        self.crcs = crcs
        distinct, self.kind = np.unique(lengths, return_inverse=True)
        factors = _byte_powers(distinct)[:, None]
        values = np.arange(256, dtype=np.uint32)[None, :]
        self.tables = [_product(values << np.uint32(8 * i), factors) for i in range(4)]

    def __call__(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        kind = self.kind[word]
        out = self.crcs[word]
        for i, table in enumerate(self.tables):
            out = out ^ table[kind, before >> np.uint32(8 * i) & np.uint32(255)]
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and which of them each is."""
    coded = pc.dictionary_encode(pa.array(keys))
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


# ---------------------------------------------------------------------------------------------------------------------
# Features of a column of texts


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for every length of n-gram the bucket of each n-gram with the text it is in."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    solid = pc.greater(pc.binary_length(words), 0)
    row = rows.filter(solid).to_numpy(zero_copy_only=False)
    counts = np.bincount(row, minlength=len(texts))
    if not len(row):
        return counts, []
    coded = pc.dictionary_encode(words.filter(solid))
    index = coded.indices.to_numpy().astype(np.int64)
    spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
    crcs = np.array([zlib.crc32(word) for word in spelled], np.uint32)
    lengths = np.array([len(word) for word in spelled])
    append = _Appender(crcs, lengths)
    space = _Appender(np.array([zlib.crc32(b" ")], np.uint32), np.ones(1, np.int64))

    runs = [(crcs % np.uint32(buckets))[index]]
    found, gram, gram_crcs = [(runs[0], row)], index, crcs
    for size in range(2, longest + 1):
        # an n-gram and the word behind it, where both are in one text
        within = row[size - 1 :] == row[: len(row) - size + 1]
        gram = gram[: len(row) - size + 1]
        pairs, place = _distinct(gram[within] * len(spelled) + index[size - 1 :][within])
        first, last = np.divmod(pairs, len(spelled))
        one_space = space(gram_crcs[first], np.zeros(len(first), np.int64))
        gram_crcs = append(one_space, last)
        found.append(((gram_crcs % np.uint32(buckets))[place], row[: len(gram)][within]))
        # numbers of the n-grams at their places, for the next length; those across texts are never asked for again
        numbers = np.zeros(len(gram), np.int64)
        numbers[within] = place
        gram = numbers
    return counts, found


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of a bounded number of bytes, or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(row, end - row)
        row = end


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; repeats count."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                for places, _ in features(texts, longest, buckets)[1]:
                    total += np.bincount(places, minlength=buckets)
            release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counts"])

    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "counts array<bigint>")
    summed = counted.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.where("n > 0").collect():   # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


@dataclass(frozen=True)
class Gains:
    """What an n-gram of each bucket adds to a text's weight, in thousandths, and the length of n-grams it holds for."""

    values: np.ndarray
    longest: int = LONGEST


def fit_gains(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> Gains:
    """Gains of the buckets: log ratio of the smoothed shares in the target and in the documents, rounded down."""
    s, t = bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets)
    held, wanted = float(s.sum() + buckets), float(t.sum() + buckets)
    values = [
        math.floor(1000 * math.log(((a + 1.0) * held) / ((b + 1.0) * wanted))) for a, b in zip(t.tolist(), s.tolist())
    ]
    return Gains(np.array(values, np.int64), longest)


def with_weights(docs: DataFrame, gains: Gains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every text."""
    ship_package(docs.sparkSession)
    values, longest = gains.values, gains.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for texts in _pieces(batch.column(1)):
                n, found = features(texts, longest, len(values))
                weight = np.zeros(len(texts), np.int64)
                for places, row in found:
                    if len(row):
                        begins = np.flatnonzero(np.diff(row, prepend=-1))
                        weight[row[begins]] += np.add.reduceat(values.take(places), begins)
                words.append(n)
                counts.append(sum(np.maximum(n - k, 0) for k in range(longest)))
                weights.append(weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate(part), pa.int64()) for part in (words, counts, weights))],
                ["doc_id", "n_words", "n_features", "weight"],
            )
            release_memory()

    return own_columns(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def gumbel_noise(id_column: Column, seed: int) -> Column:
    """Noise in thousandths from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, id_col: str = "doc_id",
    text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document. ``percent`` of those with ``least_words`` words
    are drawn, best score first; the rank of the others is null."""
    gains = fit_gains(docs, target, text_col, target_text_col, longest, buckets)
    weighted = with_weights(docs, gains, id_col, text_col)
    # sorting samples its input first, so the texts are read once and the short rows stored
    scored = stored(
        weighted.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
        .withColumn("long", F.col("n_words") >= least_words)
        .withColumn("spread", F.monotonically_increasing_id()), "weights",
    )
    # the last key spreads rows that are equal in all others
    order = [
        F.col("long").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"),
        F.col("spread"),
    ]
    eligible = scored.where("long").count()
    drawn = percent * eligible // 100
    placed = numbered(scored, order, "place")
    return placed.select(
        "doc_id", "n_words", "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"),
    )
