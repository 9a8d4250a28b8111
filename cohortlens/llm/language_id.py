"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are reduced to lower-case letters with single spaces between words. A model of order n gives a character's probability
after the n - 1 before it: the discounted count of the longest n-gram plus the freed mass times the probability at the next
lower order, whose counts are numbers of different characters in front. All languages share sorted arrays of n-gram hashes,
per order one for n-grams and one for contexts, with a column per language. A text goes to the language with the lowest
cross-entropy per character. A prediction is accepted if that is not above what held-back training texts of the language
reach (a high quantile), otherwise rejected.

Training takes at most ``max_docs`` documents per language, chosen by a hash of the id, one in five of them held back for
the calibration; their n-grams are counted by Spark. Prediction reads whole texts; every n-gram of a slice of texts is looked
up once.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are not accepted; so does every text if
nothing could be learned. Null languages, null texts and rows without an id are not learned from; rows that share an id are
learned from each under its own language (the bound on documents counts ids per language). Equal cross-entropies go to the
first language in sorted order. Every row gets a prediction, with or without an id, repeated or not; other columns pass through,
and those with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.arrow import with_arrow_columns
from cohortlens.llm.shared import ship_package
from cohortlens.llm.tokens import mix, slices

ORDER = 4
MAX_DOCS = 2000
HELD_BACK = 5
QUANTILE = 0.995
# A score counts evidence of at most this many characters.
SCORE_CHARS = 50
UNKNOWN = "und"
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space where it is no letter."""
    if "letters" not in _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _TABLES["letters"] = table
    return _TABLES["letters"]


def reduced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduced texts as code points, and the first of each row."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:  # row by row, with a mark for every bad byte
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    codes = _letters()[points]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32  # the first space of a run stays
    starts = at[:-1][at[1:] > at[:-1]]
    keep[starts] = codes[starts] != 32
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[at]


def ngrams(codes: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` characters that end at every place; before a row there are spaces."""
    start = np.repeat(first[:-1], np.diff(first))
    out = np.full((len(codes), order), 32, np.uint32)
    place = np.arange(len(codes))
    for back in range(order):
        there = place - back >= start
        out[there, order - 1 - back] = codes[place[there] - back]
    return out


def gram_hash(grams: np.ndarray) -> np.ndarray:
    key = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    # per order n = 1..order: sorted n-gram hashes with the discounted share per language, and sorted context hashes with
    # the freed mass per language
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray  # probability of an unknown character
    limits: np.ndarray  # highest accepted cross-entropy

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram, one column per language."""
        p = np.tile(self.floor, (len(grams), 1))
        for n in range(1, self.order + 1):
            tail = grams[:, self.order - n :]
            p = _lookup(*self.contexts[n - 1], gram_hash(tail[:, :-1]), 1.0) * p
            p += _lookup(*self.grams[n - 1], gram_hash(tail), 0.0)
        return np.log(p)

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character and language, and the number of letters."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in slices(texts):
            codes, first = reduced(data, offsets)
            grams = ngrams(codes, first, self.order)
            _, example, which = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
            logs = self.log_probabilities(grams[example])
            n = np.maximum(np.diff(first), 1)
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(logs[which, k])])
                out[lo:hi, k] = -(sums[first[1:]] - sums[first[:-1]]) / n
            spaces = np.concatenate([[0], np.cumsum(codes != 32)])
            letters[lo:hi] = spaces[first[1:]] - spaces[first[:-1]]
        return out, letters


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], absent)


def kneser_ney(grams: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: list[str]) -> LanguageModel:
    """The model from counted n-grams of the highest order (one row per n-gram and language)."""
    order, width = grams.shape[1], len(languages)
    gram_tables, context_tables = [], []
    level = (grams, language, counts.astype(np.float64))
    for n in range(order, 0, -1):
        g, lang, c = level
        h, ctx = gram_hash(g), gram_hash(g[:, :-1])
        discount = np.zeros(width)
        for k in range(width):
            own = c[lang == k]
            ones, twos = (own == 1).sum(), (own == 2).sum()
            discount[k] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        contexts, where = np.unique(ctx, return_inverse=True)
        cell = where * width + lang
        total = np.bincount(cell, weights=c, minlength=len(contexts) * width)
        kinds = np.bincount(cell, minlength=len(contexts) * width)
        freed = np.where(total > 0, np.tile(discount, len(contexts)) * kinds / np.maximum(total, 1), 1.0)
        keys, place = np.unique(h, return_inverse=True)
        share = np.zeros((len(keys), width))
        share[place, lang] = np.maximum(c - discount[lang], 0) / total[cell]
        gram_tables.append((keys, share))
        context_tables.append((contexts, freed.reshape(-1, width)))
        if n > 1:
            # the lower order counts different characters in front
            tail = g[:, 1:]
            _, example, pair = np.unique(mix(gram_hash(tail) ^ lang.astype(np.uint64)), return_index=True, return_inverse=True)
            level = (tail[example], lang[example], np.bincount(pair).astype(np.float64))
    alphabet = np.array([len(np.unique(grams[language == k, -1])) for k in range(width)])
    return LanguageModel(
        languages, order, gram_tables[::-1], context_tables[::-1], 1.0 / (alphabet + 1), np.full(width, np.inf)
    )


def _counted(docs: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n`` of ``docs`` (``lang, text``)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(0).dictionary_encode()
            code = np.asarray(languages.indices)
            for lo, hi, data, offsets in slices(batch.column(1)):
                codes, first = reduced(data, offsets)
                grams = ngrams(codes, first, order)
                lang = np.repeat(code[lo:hi], np.diff(first))
                _, example, which = np.unique(mix(gram_hash(grams) ^ lang.astype(np.uint64)), return_index=True, return_inverse=True)
                text = grams[example].astype("<u4").tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_arrays(
                    [
                        languages.dictionary.take(pa.array(lang[example])),
                        pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()),
                        pa.array(np.bincount(which, minlength=len(example))),
                    ],
                    ["lang", "gram", "n"],
                )

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(
    docs: DataFrame, order: int = ORDER, max_docs: int = MAX_DOCS, quantile: float = QUANTILE
) -> LanguageModel | None:
    """Fit on ``docs`` (``doc_id, lang, text``); None where no text has a language."""
    # rows that share an id are learned from each under its own language; choosing them takes no look at the texts
    row = F.xxhash64("doc_id", "lang")
    by_hash = Window.partitionBy("lang").orderBy("row")
    labelled = docs.where("lang is not null and doc_id is not null").select("lang", row.alias("row"))
    # a language with far more rows is thinned by the hash first, so that few rows meet in the ranking; the counts are one row
    # per language
    counts = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(1 << 30)) / (1 << 30)
    chosen = (
        labelled.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(place * F.col("_n") < 2 * max_docs)
        .select("lang", "row").distinct().withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= max_docs)
    )
    # bounded by max_docs per language
    texts = docs.where("text is not null and lang is not null and doc_id is not null").select("lang", "text", row.alias("row"))
    sample = texts.join(F.broadcast(chosen.select("row", "rank")), "row").drop("row")
    rows = _counted(sample.where(F.col("rank") % HELD_BACK != 0), order).toArrow()
    if not rows.num_rows:
        return None
    names = np.asarray(rows.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    points = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
    place = {name: k for k, name in enumerate(languages)}
    model = kneser_ney(points, np.array([place[x] for x in names]), rows.column("n").to_numpy(), languages)
    held = with_languages(sample.where(F.col("rank") % HELD_BACK == 0), model)
    reached = held.where("lang_pred = lang").groupBy("lang").agg(F.percentile("cross_entropy", F.lit(quantile)).alias("q"))
    for row in reached.collect():
        model.limits[place[row["lang"]]] = row["q"]
    return model


def with_languages(
    docs: DataFrame, model: LanguageModel | None, text_col: str = "text", score_chars: int = SCORE_CHARS
) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (share of the best language, 0 to 1, by the evidence of a text of its own
    length or ``score_chars`` characters, whichever is shorter), ``cross_entropy`` and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows, model = len(texts), shared.value
        if model is None:
            return [pa.array([UNKNOWN] * rows, pa.string()), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64()), pa.array(np.zeros(rows, bool))]
        entropy, letters = model.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(rows), best]
        share = 1 / np.exp((low[:, None] - entropy) * np.minimum(letters, score_chars)[:, None]).sum(axis=1)
        none = letters == 0
        names = pa.array([UNKNOWN if n else model.languages[k] for n, k in zip(none.tolist(), best.tolist())], pa.string())
        return [
            names, pa.array(np.where(none, 0.0, share)), pa.array(low, mask=none),
            pa.array(~none & (low <= model.limits[best])),
        ]

    return with_arrow_columns(docs, text_col, "lang_pred string, score double, cross_entropy double, accepted boolean", compute)
