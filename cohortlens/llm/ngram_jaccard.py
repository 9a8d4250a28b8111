"""Exact Jaccard join of word n-gram sets: a size-aware heavy-light join.

Documents with equal sets form a class, which its smallest id represents; only classes are joined.

Light sets (few n-grams) are joined by fixed-size subsets: two sets of sizes a and b reach the threshold exactly when they
share a subset of c(a, b) = ceil(p (a + b) / (100 + p)) n-grams, so every light set emits the hashes of its subsets of each
size that some partner asks for. That is a handful of deletions from a small set.

Heavy sets are joined by inverted lists. N-grams have a global order, rare ones first: those found often in a sample of
documents come last, the others by the frequency that the sample's counts of their words let expect; a set enters the lists of its
first n - ceil(p n / 100) + 1 n-grams only, which a partner above the threshold cannot miss. A light set that a heavy one
can still reach enters the lists as well. Lists give candidates after length and position filters. Every set also has a
sketch of a byte per part of the hash range, with about half as many parts as n-grams; the parts that differ are a lower bound of the symmetric difference,
which drops most false candidates without a look at their texts. The others are verified exactly on their whole texts.

The boundary between light and heavy minimizes the estimated number of emitted subsets, list entries and list pairs. The
estimate and the frequent n-grams come from a bounded sample of documents; both decide about cost only, any boundary and
any order give the same links.

A list with very many members is not turned into all its pairs. First every member meets one pivot, the member with the
fewest n-grams before the shared one (in a group of near copies: the text nearest to the common core). Then only members
that are still in different components meet each other.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import release_memory, with_arrow_columns
from cohortlens.llm.components import connected_components
from cohortlens.llm.idfilter import perhaps_with, without
from cohortlens.llm.shared import own_columns, ship_package, stored
from cohortlens.llm.tokens import Words, mix, shingles, slices

SHINGLE, PERCENT = 5, 80
SAMPLE_DOCS = 5000
# An n-gram in this many sampled documents comes late in the order.
SAMPLE_FREQUENT = 5
# Light sets have at most this many subsets each, whatever the cost estimate says.
MOST_SUBSETS = 500
# Least number of parts of a sketch.
SKETCH = 256
_SALT = np.uint64(0x5851F42D4C957F2D)


def distinct_ngrams(
    data: np.ndarray, offsets: np.ndarray, size: int, word_class=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct n-gram hashes (sorted by row and hash) and the sums of their words' classes. A text of fewer words is
    one n-gram as a whole, of class 0. ``word_class`` maps word hashes to classes."""
    words = Words(data, offsets)
    hashes = words.hashes()
    gram, whole = shingles(hashes, words.first, size)
    classes = np.zeros(len(gram), np.int16)
    if word_class is not None:
        each = word_class(hashes)
        for k in range(size):
            classes[: max(len(each) - k, 0)] += each[k:]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    rows, grams, classes = words.row[whole], gram[whole], classes[whole]
    if len(short):
        ends = []
        for row in short:
            value = np.uint64(counts[row])
            for h in hashes[words.first[row] : words.first[row + 1]]:
                value = mix(np.array([value ^ h]))[0]
            ends.append(value)
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, np.array(ends, np.uint64)])
        classes = np.concatenate([classes, np.zeros(len(short), np.int16)])
    order = np.argsort(grams)
    order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new], classes[order][new]


def sketch_cells(n: np.ndarray) -> np.ndarray:
    """Parts of the sketch of a set of n n-grams: a power of two, half of n at least."""
    return 2 ** np.ceil(np.log2(np.maximum(n / 2, SKETCH))).astype(np.int64)


def needed(a: int, b: int, percent: int) -> int:
    """Common n-grams that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(a: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of size ``a`` shares with some partner above the threshold."""
    smallest, largest = -(-percent * a // 100), 100 * a // percent
    return sorted({c for b in range(smallest, largest + 1) if (c := needed(a, b, percent)) <= min(a, b)})


def subset_count(a: int, percent: int) -> int:
    return sum(comb(a, c) for c in subset_sizes(a, percent))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


def choose_boundary(sizes: np.ndarray, list_length: float, percent: int) -> int:
    """Largest light size, by cost: subsets of the light sets against entries and list pairs of the heavy ones."""
    best, boundary, total = 0.0, 0, 0.0
    counts = np.bincount(sizes) if len(sizes) else np.zeros(1)
    for a in range(1, len(counts)):
        subsets = subset_count(a, percent)
        if subsets > MOST_SUBSETS:
            break
        total += counts[a] * (subsets - prefix_length(a, percent) * (1 + list_length))
        if total <= best:
            best, boundary = total, a
    return boundary


def subset_hashes(grams: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of all subsets of the sizes in question; a subset's hash is a sum over its n-grams, so that it follows from
    the sum of all by deletions."""
    n, out = len(grams), []
    terms = mix(grams ^ _SALT)
    everything = terms.sum(dtype=np.uint64)
    for c in subset_sizes(n, percent):
        sums, last = np.array([everything], np.uint64), np.array([-1])
        for _ in range(n - c):
            # each partial subset drops one more n-gram behind the last dropped
            more = n - 1 - last
            at = np.repeat(np.arange(len(sums)), more)
            nxt = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + last[at] + 1
            sums, last = sums[at] - terms[nxt], nxt
        out.append(mix(sums + np.uint64((c * int(_SALT)) % 2**64)))
    return np.concatenate(out)


class Signatures:
    """Signature columns of a batch of texts: set size, 128-bit set hash, list entries in order, subset hashes."""

    ddl = "n int, h1 bigint, h2 bigint, prefix array<bigint>, subsets array<bigint>, sketch binary"

    def __init__(self, size: int, percent: int, plan: "Plan"):
        self.size, self.percent, self.boundary, self.frequent = size, percent, plan.boundary, plan.frequent
        self.plan = plan

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        parts = [self._slice(data, offsets) for _, _, data, offsets in slices(texts)]
        if not parts:
            lists = pa.list_(pa.int64())
            return [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), lists, lists, pa.binary())]
        return [pa.chunked_array([part[i] for part in parts]).combine_chunks() for i in range(6)]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n_rows = len(offsets) - 1
        rows, grams, classes = distinct_ngrams(data, offsets, self.size, self.plan.word_class)
        n = np.bincount(rows, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(n)])
        hashes = []
        for salt in (np.uint64(1), _SALT):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ salt), dtype=np.uint64)])
            hashes.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        # rare n-grams first
        if len(self.frequent) and len(grams):
            at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
            classes = np.where(self.frequent[at] == grams, np.int16(1000), classes)
        by_class = np.argsort(classes, kind="stable")
        ordered = grams[by_class[np.argsort(rows[by_class].astype(np.int32), kind="stable")]]
        place = np.arange(len(rows)) - first[rows]
        smallest = -(-self.percent * (self.boundary + 1) // 100)
        listed = (place < prefix_length(n, self.percent)[rows]) & (n[rows] >= smallest)
        light = np.flatnonzero((n > 0) & (n <= self.boundary))
        subsets = [subset_hashes(grams[first[r] : first[r + 1]], self.percent) for r in light]
        many = np.zeros(n_rows, np.int64)
        many[light] = [len(s) for s in subsets]
        terms = mix(grams)
        cells = sketch_cells(n)
        begin = np.concatenate([[0], np.cumsum(cells)])
        part = (terms >> (np.uint64(64) - np.log2(cells).astype(np.uint64)[rows])).astype(np.int64)
        held = np.bincount(begin[rows] + part, weights=(terms & np.uint64(255)).astype(np.float64), minlength=begin[-1])
        held = (held.astype(np.int64) & 255).astype(np.uint8)
        sketch = pa.Array.from_buffers(
            pa.binary(), n_rows, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(held)]
        )
        return [
            pa.array(n.astype(np.int32)), pa.array(hashes[0]), pa.array(hashes[1]),
            _lists(ordered[listed], np.bincount(rows[listed], minlength=n_rows)),
            _lists(np.concatenate([np.zeros(0, np.uint64), *subsets]), many),
            sketch,
        ]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.array(values.view(np.int64)))


def pair_overlap(size: int):
    """For an array ``[text, text]`` per row: common and united n-grams."""

    def compute(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        inter, union = np.zeros(len(texts_a), np.int64), np.zeros(len(texts_a), np.int64)
        for lo, hi, data, offsets in slices(texts_a):
            rows_a, grams_a, _ = distinct_ngrams(data, offsets, size)
            rows_b, grams_b = [], []
            for lo_b, _, data_b, offsets_b in slices(texts_b.slice(lo, hi - lo)):
                r, g, _ = distinct_ngrams(data_b, offsets_b, size)
                rows_b.append(r + lo_b)
                grams_b.append(g)
            rows = np.concatenate([rows_a, *rows_b])
            grams = np.concatenate([grams_a, *grams_b])
            order = np.argsort(grams, kind="stable")
            order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
            rows, grams = rows[order], grams[order]
            same = (rows[1:] == rows[:-1]) & (grams[1:] == grams[:-1])
            both = np.bincount(rows[1:][same], minlength=hi - lo)
            inter[lo:hi] = both
            union[lo:hi] = np.bincount(rows, minlength=hi - lo) - both
        return inter, union

    return compute


def parts_that_differ(x, y) -> int:
    """Parts in which two sketches differ; the finer one is folded to the parts of the other."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = y.reshape(len(x), -1).sum(axis=1, dtype=np.uint8)
    return int(np.count_nonzero(x != y))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sketches (``doc_id, n, sketch``) don't rule the threshold out."""
    ship_package(pairs.sparkSession)
    side = lambda c: sketches.select(
        F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.expr("n_a + n_b"), "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy(zero_copy_only=False)
            differ = np.array([parts_that_differ(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(3), batch.column(4))], np.int64)
            keep = pa.array((100 + percent) * differ <= (100 - percent) * total)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
            del batch
            release_memory()

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole texts (``doc_id, text``) reach the threshold."""
    texts = perhaps_with(docs, "doc_id", pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    overlap = pair_overlap(size)

    def run(batches):
        for batch in batches:
            inter, union = overlap(batch.column(2), batch.column(3))
            keep = pa.array(100 * inter >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
            del batch
            release_memory()

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


class Plan:
    """What the sample tells: the light boundary, the frequent n-grams, and classes of words by frequency (rare: 0)."""

    def __init__(self, boundary: int = 0, frequent: np.ndarray | None = None, words: np.ndarray | None = None, times: np.ndarray | None = None):
        none = np.zeros(0, np.uint64)
        self.boundary, self.frequent = boundary, none if frequent is None else frequent
        self.words = none if words is None else words
        self.classes = np.zeros(0, np.int16) if times is None else np.log2(times).astype(np.int16)

    def word_class(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int16)
        distinct, which = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, self.classes[at], np.int16(0))[which]


def _plan(docs: DataFrame, size: int, percent: int, sample_docs: int) -> Plan:
    """From at most about ``sample_docs`` documents, which also bounds what is collected here."""
    rows = docs.count()
    if not rows:
        return Plan()
    share = min(1.0, sample_docs / rows)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def found(texts: pa.Array) -> list[pa.Array]:
        parts = []
        for _, _, data, offsets in slices(texts):
            r, g, _ = distinct_ngrams(data, offsets, size)
            rw, w, _ = distinct_ngrams(data, offsets, 1)
            rows = len(offsets) - 1
            parts.append((_lists(g, np.bincount(r, minlength=rows)), _lists(w, np.bincount(rw, minlength=rows))))
        return [pa.chunked_array([p[i] for p in parts], type=pa.list_(pa.int64())).combine_chunks() for i in (0, 1)]

    sampled = stored(
        with_arrow_columns(drawn, "text", "grams array<bigint>, words array<bigint>", found).select("grams", "words"), "jaccard-sample"
    )
    sizes = sampled.groupBy(F.least(F.size("grams"), F.lit(1000)).alias("n")).count().collect()
    counted = lambda c: sampled.select(F.explode(c).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    grams = stored(counted("grams"), "jaccard-counted")

    def hashes(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = df.toArrow()
        h = table.column("g").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        return h[order], table.column("c").to_numpy().astype(np.int64)[order]

    frequent, _ = hashes(grams.where(F.col("c") >= SAMPLE_FREQUENT))
    words, times = hashes(counted("words").where("c > 1"))
    counts = np.repeat([r["n"] for r in sizes], [r["count"] for r in sizes]).astype(np.int64)
    # other documents that a rarer n-gram has on average, carried over from the sample to the table
    rare = grams.where(F.col("c") < SAMPLE_FREQUENT).agg(F.sum(F.col("c") * (F.col("c") - 1)), F.sum("c")).first()
    list_length = (rare[0] or 0) / max(rare[1] or 0, 1) / max(share, 1e-9)
    return Plan(choose_boundary(counts[counts > 0], list_length, percent), frequent, words, times)


def _fits(percent: int) -> Column:
    """Length and position filter of a pair of list entries."""
    small, large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    left = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * (F.col("n_x") + F.col("n_y")))


def ngram_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable over links
    (100 * intersection >= percent * union). Texts without words (null, empty) have no set and link with nothing. Rows that
    share an id are one document: what links to one of its texts links to all. A null id links with nothing and has null
    results. Other columns of ``docs`` are not looked at.
    """
    own = own_columns(docs, id_col, text_col)
    plan = own.sparkSession.sparkContext.broadcast(_plan(own, shingle, percent, sample_docs))
    signed = with_arrow_columns(own, "text", Signatures.ddl, lambda texts: Signatures(shingle, percent, plan.value)(texts))
    signatures = stored(signed.drop("text"), "jaccard-signatures")
    linked = signatures.where("n > 0 and doc_id is not null")
    classes = stored(linked.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    reps = linked.drop("sketch").join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "n", "doc_id"], "left_semi")
    entries = reps.select(
        F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("rep"), "n"
    ).unionByName(
        # a shared subset is proof enough, whatever its place
        reps.select(F.lit(0).alias("pos"), F.explode("subsets").alias("token"), F.col("doc_id").alias("rep"), "n")
    )
    # one exchange serves the counts and the join with them
    entries = entries.repartition("token")
    shared = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("pos", "rep", "n")).alias("pivot")
    ).where("members > 1").select(
        "token", F.col("pivot.pos").alias("pos_y"), F.col("pivot.rep").alias("b"), F.col("pivot.n").alias("n_y")
    )
    lists = stored(
        entries.join(shared, "token").select("token", F.col("pos").alias("pos_x"), F.col("rep").alias("a"),
                                             F.col("n").alias("n_x"), "pos_y", "b", "n_y"),
        "jaccard-lists",
    )
    pairs_of = lambda df: df.where("a != b").where(_fits(percent)).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    listed = lists.select(F.col("a").alias("doc_id")).distinct()
    sketches = stored(linked.join(listed, "doc_id", "left_semi").select("doc_id", "n", "sketch"), "jaccard-sketches")
    to_pivots = stored(pairs_of(lists), "jaccard-pairs")
    likely = stored(plausible(to_pivots, sketches, percent), "jaccard-likely")
    links = stored(verified(likely, own, shingle, percent), "jaccard-links")
    # documents with several texts tie their classes together
    own_class = signatures.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    several = own_class.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"))
    ties = several.where("a != b").select("a", "b").union(
        own_class.join(several.where("a != b"), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b")
    )
    so_far = connected_components(links.union(ties))
    # members of one list that are still apart
    apart = lists.join(so_far.withColumnRenamed("node", "a"), "a", "left").select(
        "token", "pos_x", "a", "n_x", F.coalesce("component", "a").alias("c_x")
    )
    mixed = apart.groupBy("token").agg(F.min("c_x").alias("lo"), F.max("c_x").alias("hi")).where("lo != hi").select("token")
    apart = stored(apart.join(mixed, "token", "left_semi"), "jaccard-apart")
    others = apart.select("token", F.col("pos_x").alias("pos_y"), F.col("a").alias("b"), F.col("n_x").alias("n_y"),
                          F.col("c_x").alias("c_y"))
    rest = pairs_of(apart.join(others, "token").where("a > b and c_x != c_y"))
    rest = rest.join(to_pivots, ["a", "b"], "left_anti")
    likely = stored(plausible(rest, sketches, percent), "jaccard-likely")
    more = stored(verified(likely, own, shingle, percent), "jaccard-more-links")
    final = connected_components(so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return own_class.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns; rows that share such an id all stay,
    and so do rows without an id."""
    classes = ngram_classes(docs, id_col, text_col, shingle, percent)
    gone = stored(classes.where("component_id < doc_id").select("doc_id").distinct(), "jaccard-gone")
    return without(docs, id_col, gone)
