"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

Grades 0..K are cut from one latent score by ordered thresholds: P(grade <= k) = logistic(threshold_k - w.x). The weights w
are shared by all thresholds; x holds which hashed words a text has. The expected severity is the sum of
P(grade >= k) over k = 1..K.

Fitting uses at most ``max_rows`` labelled documents, chosen by a hash of their id; equal texts count once. The penalty is
L1, so that all but the telling words have weight zero and long texts don't add up noise, and weights are not negative, so
that more text never hides a telling word. Scoring reads whole texts of all
documents, in Arrow batches with one broadcast vector of fixed length.

Defined results: a null or empty text has no features, so its grade comes from the thresholds alone, and it is never
rejected; null labels and labels of unknown documents don't count; of repeated labels the largest counts; without labels
of both kinds nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import release_memory, with_arrow_columns
from cohortlens.llm.shared import stored
from cohortlens.llm.tokens import PUNCTUATION, Words, mix, slices, span_hashes

MAX_ROWS = 20000
BITS = 19
PENALTY = 0.002
# A word counts as a whole and by its first bytes, so that inflected and compounded forms share a feature.
STEM_BYTES = (4, 5, 6, 7)
OUTPUT = "expected_severity double, severity int, p_toxic double, rejected boolean"


def word_features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of every text: all feature numbers, and the first of each row (one entry more than rows)."""
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in slices(texts):
        words = Words(data, offsets, PUNCTUATION)
        row = words.row.astype(np.int64) << bits
        parts = [row | (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)]
        for length in STEM_BYTES:
            longer = words.end - words.start > length
            start = words.start[longer]
            stem = mix(span_hashes(data, start, start + length) ^ np.uint64(length))
            parts.append(row[longer] | (stem >> np.uint64(64 - bits)).astype(np.int64))
        both = np.unique(np.concatenate(parts))
        found.append(both & ((1 << bits) - 1))
        counts.append(np.bincount(both >> bits, minlength=len(offsets) - 1))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SeverityModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades
    bits: int = BITS
    cut: float = 0.5  # of P(grade >= 1), for rejection

    def at_least(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P(grade >= k) for k = 1..K, one row per text, and the number of features of each."""
        feature, first = word_features(texts, self.bits)
        score = _sums(self.weights[feature], first)
        return _logistic(score[:, None] - self.thresholds[None, :]), np.diff(first)


def fit_ordinal(
    feature: np.ndarray, first: np.ndarray, grade: np.ndarray, bits: int = BITS, penalty: float = PENALTY, steps: int = 150
) -> SeverityModel:
    """Penalized likelihood by proximal steps whose size adapts per weight; thresholds stay ordered by construction."""
    rows, top = len(grade), int(grade.max()) if len(grade) else 0
    if not top:
        return SeverityModel(np.zeros(1 << bits, np.float32), np.full(max(top, 1), 40.0), bits)
    below = np.array([(grade < k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(below / (1 - below))

    def slopes(w: np.ndarray, theta: np.ndarray, feature: np.ndarray, first: np.ndarray):
        """Derivatives of the mean negative log-likelihood by weights and thresholds."""
        score = _sums(w[feature], first)
        bound = np.concatenate([[-40.0], theta, [40.0]])
        upper, lower = _logistic(bound[grade + 1] - score), _logistic(bound[grade] - score)
        inside = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        each = np.repeat((d_upper - d_lower) / rows, np.diff(first))
        by_threshold = [(d_lower[grade == k + 1].sum() - d_upper[grade == k].sum()) / rows for k in range(top)]
        return np.bincount(feature, weights=each, minlength=len(w)), np.array(by_threshold)

    # words that hardly pull upwards at the start stay at zero; the others are numbered afresh
    start, _ = slopes(np.zeros(1 << bits), theta, feature, first)
    alive = np.flatnonzero(start < -penalty / 4)
    number = np.full(1 << bits, -1)
    number[alive] = np.arange(len(alive))
    row = np.repeat(np.arange(rows), np.diff(first))
    held = number[feature] >= 0
    feature, row = number[feature[held]], row[held]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    w = np.zeros(len(alive))
    # the second pass takes most of the shrinking back for the words that the first one chose
    for shrink, passes in ((penalty, steps), (penalty / 20, 3 * steps)):
        chosen = (w > 0) | (shrink == penalty)
        square_w, square_t = np.full(len(alive), 1e-10), np.full(top, 1e-10)
        for _ in range(passes):
            g, g_theta = slopes(w, theta, feature, first)
            square_w += g * g
            square_t += g_theta * g_theta
            size = 0.5 / np.sqrt(square_w)
            w = np.maximum(w - size * (g + shrink), 0) * chosen
            theta = np.maximum.accumulate(theta - 0.2 * g_theta / np.sqrt(square_t))
    weights = np.zeros(1 << bits, np.float32)
    weights[alive] = w
    return SeverityModel(weights, theta, bits)


def severity_grades(toxic: np.ndarray, feature: np.ndarray, first: np.ndarray, bits: int, bands: int = 3) -> np.ndarray:
    """Ordered grades where the labels say only toxic or not: 0 for clean texts, and for toxic ones 1..bands, by the number
    of words in the text that are at least twenty times as frequent among toxic as among clean texts; bands of equal size."""
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    bad = toxic > 0
    in_bad = np.bincount(feature[bad[row]], minlength=1 << bits)
    in_good = np.bincount(feature[~bad[row]], minlength=1 << bits)
    telling = (in_bad >= 5) & (in_bad / max(bad.sum(), 1) >= 20 * (in_good + 0.5) / max((~bad).sum(), 1))
    hits = np.bincount(row[telling[feature]], minlength=len(toxic))
    cuts = np.quantile(hits[bad], [k / bands for k in range(1, bands)]) if bad.any() else []
    return np.where(bad, 1 + sum((hits > cut).astype(int) for cut in cuts), 0).astype(np.int64)


def calibrated_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """The cut of P(grade >= 1) with the best F score on the fitted rows, in the middle of the gap it falls in."""
    order = np.argsort(-p, kind="stable")
    p, bad = p[order], bad[order]
    hits = np.cumsum(bad)
    score = 2 * hits / (np.arange(1, len(p) + 1) + bad.sum())
    last = np.append(p[1:] < p[:-1], True)  # equal scores fall on one side
    best = int(np.argmax(np.where(last, score, -1)))
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_rows`` labelled documents in the order of a hash, equal texts once.
    ``docs`` has ``doc_id, text``. Only labels of documents that are there count towards the bound."""
    known = docs.where("text is not null").select("doc_id")
    chosen = (
        labels.where("doc_id is not null and toxic is not null").join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # bounded by max_rows, hence small enough to broadcast
    return docs.join(F.broadcast(chosen), "doc_id").where("text is not null")


def fit_severity(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, bands: int = 3
) -> SeverityModel:
    """Fit on ``docs`` (``doc_id, text``) with ``labels`` (``doc_id, toxic``)."""
    model = _fitted(docs, labels, max_rows, bits, bands)
    # the driver goes on to other work and needs none of what the fit took
    release_memory()
    return model


def _fitted(docs: DataFrame, labels: DataFrame, max_rows: int, bits: int, bands: int) -> SeverityModel:
    featured = with_arrow_columns(
        labelled_sample(docs, labels.select(F.col("doc_id"), F.col("toxic").cast("int")), max_rows)
        .withColumn("text_hash", F.xxhash64("text")),
        "text", "features array<int>", lambda texts: [_lists(*word_features(texts, bits))],
    )
    sample = stored(
        featured.groupBy("text_hash").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"), F.first("features").alias("features")),
        "toxicity-sample",
    )
    rows, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < rows:
        return SeverityModel(np.zeros(1 << bits, np.float32), np.full(1, 40.0), bits, 1.0)
    # only words that are likelier in toxic texts can get a weight; the others need not leave the executors
    pull = (F.col("bad") - F.lit(bad / rows) * F.col("n")) / rows
    alive = (
        sample.select(F.explode("features").alias("f"), "toxic").groupBy("f")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).where(pull > PENALTY / 4).select("f").toArrow()
    )
    alive = np.sort(alive.column(0).to_numpy())

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.asarray(lists.flatten())
            keep = np.isin(values, alive)
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(values[keep], ends)], ["text_hash", "toxic", "features"])

    # bounded by max_rows and the words left
    table = sample.select("text_hash", "toxic", "features").mapInArrow(telling, "text_hash bigint, toxic int, features array<int>").toArrow()
    table = table.sort_by("text_hash").combine_chunks()
    lists = table.column("features").combine_chunks()
    feature = np.asarray(lists.flatten(), np.int64)
    first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    grade = severity_grades(table.column("toxic").to_numpy(), feature, first, bits, bands)
    model = fit_ordinal(feature, first, grade, bits)
    model.cut = calibrated_cut(_logistic(_sums(model.weights[feature], first) - model.thresholds[0]), grade > 0)
    return model


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def with_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """The documents with ``expected_severity``, ``severity`` (the likeliest grade bound: how many of P(grade >= k) are
    over a half), ``p_toxic`` = P(grade >= 1) and ``rejected``: ``p_toxic`` over the calibrated cut, and there is a word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        p, words = model.at_least(texts)
        return [
            pa.array(p.sum(axis=1)), pa.array((p > 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0].copy()),
            pa.array((p[:, 0] > model.cut) & (words > 0)),
        ]

    return with_arrow_columns(docs, text_col, OUTPUT, compute)


def keep_clean(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS
) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_severity(own, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        p, words = shared.value.at_least(texts)
        return [pa.array((p[:, 0] > shared.value.cut) & (words > 0))]

    return with_arrow_columns(docs, text_col, "_rejected boolean", compute).where("NOT _rejected").drop("_rejected")
