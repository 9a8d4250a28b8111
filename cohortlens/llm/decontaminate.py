"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of w words is looked for in the windows of w words of every document. Windows and items are multisets of
word shingles (five words; a shorter item is one shingle as a whole). A window's fingerprint takes, bit by bit, the
majority of its weighted shingle hashes. Fingerprints are looked up in a multi-index: the 64 bits are cut in ``blocks``
parts, and within Hamming distance ``radius`` at least one part differs in no more than radius // blocks bits, so probing
every part with that many flips finds all items within the radius. Candidates are verified exactly: the sum of the smaller
weights over the sum of the larger ones must reach ``similarity``, a shingle's weight being how often it occurs.

A window fewer than similarity * m of whose m shingles are in any item at all can't reach the threshold with any; it gets
no fingerprint.

The index of the items is broadcast if the benchmark has at most ``index_words`` words; a larger benchmark is split by a
hash of the item into parts of that size, each of which makes a pass over the documents. Documents are never shuffled.

Only places next to shingles of some item are looked at: a window with enough of them holds so many in a row of the list of
such shingles within its length, which is tested on that list, not on all words.

With ``radius`` 64 every window with enough shingles of items is compared with every item of its length and nothing can be
missed; a smaller radius trades that for time. Texts at exactly the threshold differ in some 10 bits, with a deviation of 3:
at the default of 20 about 1 in 5,000 of them is missed, and none that is clearly more alike (tested).

Defined results: null or empty texts match nothing, items without words are not looked for, nor are items without an id;
equal items match alike, and so do different texts under one ``item_id``, of which the better match is reported. Rows that
share an id are looked at one by one and reported once per item with the best window; rows without an id are documents of
their own and are reported one by one with a null id. Other columns are not read by ``benchmark_matches`` and pass through
``drop_contaminated``, which only needs ``_leaky`` for itself. Very long texts are handled whole, in slices of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.arrow import with_arrow_columns
from cohortlens.llm.shared import own_columns, ship_package
from cohortlens.llm.tokens import Words, mix, shingles, slices

SHINGLE, SIMILARITY = 5, 0.8
# Texts at the threshold differ in some 10 of 64 bits, with a deviation of 3.
RADIUS, BLOCKS = 20, 8
INDEX_WORDS = 2_000_000
BITS_AT_ONCE = 200_000   # shingles whose bits are spread out at once
WINDOWS_AT_ONCE = 10_000   # windows looked up together, and a slice more
MATCH = "item_id bigint, similarity double, hamming int, start_word int, n_words int, passage string"


def _pack(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Majority bits as one number per row."""
    bits = 2 * ones > total[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _bit_sums(values: np.ndarray) -> np.ndarray:
    """Running counts of set bits: row i covers the first i values."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(values) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return sums


def _ranked(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values made distinct within their group: the k-th of equal ones is marked with k."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v), np.uint64)
    out[order] = mix(v + (np.arange(len(v)) - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return out


class ItemIndex:
    """Shingles and fingerprints of a part of the benchmark, with the block tables."""

    def __init__(self, ids: list[int], texts: list[str], size: int, radius: int, blocks: int):
        self.size, self.radius, self.blocks = size, radius, blocks
        self.width = 64 // blocks
        parts = [(lo, Words(data, offsets)) for lo, _, data, offsets in slices(pa.array(texts, pa.string()))]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[w.hashes() for _, w in parts]])
        counts = np.concatenate([np.zeros(0, np.int64), *[np.diff(w.first) for _, w in parts]])
        there = np.flatnonzero(counts > 0)
        self.ids, self.n_words = np.array(ids, np.int64)[there], counts[there]
        starts = np.concatenate([[0], np.cumsum(counts)])
        gram_of = {}
        for length in sorted({min(size, n) for n in self.n_words.tolist()}):
            gram_of[length] = shingles(hashes, starts, length)[0]
        self.short = [length for length in gram_of if length < size]
        lists = [gram_of[min(size, n)][s : s + n - min(size, n) + 1] for n, s in zip(self.n_words, starts[:-1][there])]
        self.n_grams = np.array([len(x) for x in lists], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_grams)]).astype(np.int64)
        grams = np.concatenate([np.zeros(0, np.uint64), *lists])
        self.ranked = _ranked(np.repeat(np.arange(len(lists)), self.n_grams), grams)
        self.prints = self._prints(grams, self.first)
        self.known = np.unique(grams)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.sizes = np.unique(self.n_words)
        size_no = np.searchsorted(self.sizes, self.n_words)
        # per block: items ordered by window size and block value, and where each such key starts
        self.tables = []
        for b in range(blocks):
            key = (size_no << self.width) | self._block(self.prints, b)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((len(self.sizes) << self.width) + 1))))
        flips = range(radius // blocks + 1)
        self.masks = [sum(1 << i for i in on) for k in flips for on in combinations(range(self.width), k)]

    @staticmethod
    def _prints(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Fingerprints of consecutive runs of shingles, some runs at a time."""
        out, row, rows = np.zeros(len(first) - 1, np.uint64), 0, len(first) - 1
        while row < rows:
            end = max(row + 1, int(np.searchsorted(first, first[row] + BITS_AT_ONCE, "right")) - 1)
            sums = _bit_sums(mix(grams[first[row] : first[end]]))
            at = first[row : end + 1] - first[row]
            out[row:end] = _pack(sums[at[1:]] - sums[at[:-1]], np.diff(at))
            row = end
        return out

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which shingles are in some item."""
        out = self.filter[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        out[at] = self.known[place] == grams[at]
        return out

    def near(self, prints: np.ndarray, size_no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a window and an item of its size within the radius, and their distance."""
        items = len(self.ids)
        pairs = [np.zeros(0, np.int64)]
        for b, (order, starts) in enumerate(self.tables):
            value = self._block(prints, b)
            for mask in self.masks:
                key = (size_no << self.width) | (value ^ mask)
                lo, many = starts[key], starts[key + 1] - starts[key]
                at = np.repeat(np.arange(len(prints)), many)
                if len(at):
                    inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    pairs.append(at * items + order[lo[at] + inner])
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // max(items, 1), pairs % max(items, 1)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
        close = distance <= self.radius
        return window[close], item[close], distance[close]

    def matches(self, data: np.ndarray, offsets: np.ndarray, similarity: float) -> Iterator[tuple]:
        """``row, item_id, similarity, hamming, start_word, n_words, passage``: the best window per row and item."""
        words = Words(data, offsets)
        if not len(words) or not len(self.ids):
            return
        hashes = words.hashes()
        last = np.repeat(words.first[1:], np.diff(words.first))
        found = []
        for length in [*self.short, self.size]:
            sizes = self.sizes[self.sizes == length] if length < self.size else self.sizes[self.sizes >= length]
            grams, whole = shingles(hashes, words.first, length)
            hit = self.hits(grams) & whole
            hit_at = np.flatnonzero(hit)
            held, many = [], 0
            for w in sizes:
                m = w - length + 1
                p = self._places(hit_at, int(m), similarity)
                p = p[p + w <= last[p]]
                # windows in slices, so that a very long text costs no more memory
                step = max(1, BITS_AT_ONCE // int(m))
                for lo in range(0, len(p), step):
                    held.append((p[lo : lo + step], int(w), int(m)))
                    many += len(held[-1][0])
                    if many >= WINDOWS_AT_ONCE:
                        found.append(self._verify(held, grams, similarity))
                        held, many = [], 0
            if held:
                found.append(self._verify(held, grams, similarity))
        found = [f for f in found if len(f[0])]
        if not found:
            return
        p, item, sim, distance = (np.concatenate([f[i] for f in found]) for i in range(4))
        row = words.row[p]
        order = np.lexsort((p, -sim, item, row))
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
        for i in order[new]:
            n = int(self.n_words[item[i]])
            text = data[words.start[p[i]] : words.end[p[i] + n - 1]].tobytes().decode("utf-8", "replace")
            yield int(row[i]), int(self.ids[item[i]]), float(sim[i]), int(distance[i]), int(p[i] - words.first[row[i]]), n, text

    @staticmethod
    def _places(hit_at: np.ndarray, m: int, similarity: float) -> np.ndarray:
        """First shingles of the windows of m shingles that hold enough of the given ones (by place, ascending)."""
        enough = max(1, int(np.ceil(similarity * m)))
        low, high = hit_at[: max(0, len(hit_at) - enough + 1)], hit_at[enough - 1 :]
        near = high - low < m
        # a window that holds such a run begins no later than it does, and ends no earlier
        begin, end = np.maximum(high[near] - m + 1, 0), low[near] + 1
        if not len(begin):
            return begin
        # both bounds ascend: what the run before has covered is left out
        begin[1:] = np.maximum(begin[1:], end[:-1])
        many = np.maximum(end - begin, 0)
        return np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    @staticmethod
    def _window_prints(p: np.ndarray, m: int, grams: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows of m shingles at the given places, ascending."""
        # all shingles of the windows, each once
        begin = np.maximum(p, np.concatenate([p[:1], p[:-1] + m]))
        many = np.maximum(p + m - begin, 0)
        covered = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        sums = _bit_sums(mix(grams[covered]))
        at = np.searchsorted(covered, p)
        return _pack(sums[at + m] - sums[at], np.full(len(p), m))

    def _verify(self, held: list[tuple[np.ndarray, int, int]], grams: np.ndarray, similarity: float):
        """Matches of windows given by their places, words and shingles. Windows of all sizes are looked up together, because
        probing a table costs about the same for few windows as for some thousands."""
        p = np.concatenate([places for places, _, _ in held])
        prints = np.concatenate([self._window_prints(places, m, grams) for places, _, m in held])
        size_no = np.repeat(np.searchsorted(self.sizes, [w for _, w, _ in held]), [len(places) for places, _, _ in held])
        window, item, distance = self.near(prints, size_no)
        sim, n_grams = np.zeros(len(window)), self.n_grams[item]
        for m in np.unique(n_grams).tolist():
            of_size = np.flatnonzero(n_grams == m)
            for lo in range(0, len(of_size), 20_000):
                part = of_size[lo : lo + 20_000]
                k = len(part)
                own = grams[p[window[part]][:, None] + np.arange(m)].ravel()
                ranked = _ranked(np.repeat(np.arange(k), m), own)
                theirs = self.ranked[(self.first[item[part]][:, None] + np.arange(m)).ravel()]
                group = np.tile(np.repeat(np.arange(k), m), 2)
                value = np.concatenate([ranked, theirs])
                order = np.lexsort((value, group))
                g, v = group[order], value[order]
                same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
                both = np.bincount(g[1:][same], minlength=k)
                sim[part] = both / (2 * m - both)
        good = sim >= similarity
        return p[window[good]], item[good], sim[good], distance[good]


def _matches_of_part(docs: DataFrame, index: ItemIndex, similarity: float) -> DataFrame:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for lo, _, data, offsets in slices(batch.column(1)):
                rows += [(lo + r, *rest) for r, *rest in shared.value.matches(data, offsets, similarity)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            found = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(found), batch.column(2).take(found), *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]],
                ["doc_id", "unnamed", "item_id", "similarity", "hamming", "start_word", "n_words", "passage"],
            )

    return docs.mapInArrow(run, f"doc_id bigint, unnamed bigint, {MATCH}")


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS,
    blocks: int = BLOCKS, index_words: int = INDEX_WORDS,
) -> DataFrame:
    """``doc_id, item_id, similarity, hamming, start_word, n_words, passage``: the best window of every document and item
    that match; ``start_word`` counts from 0."""
    # rows without an id are told apart by their place
    own = own_columns(docs, id_col, text_col).withColumn(
        "unnamed", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    )
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where(
        "item_id is not null and text is not null"
    )
    found = [_matches_of_part(own, index, similarity) for index in item_indexes(items, shingle, radius, blocks, index_words)]
    best = Window.partitionBy("doc_id", "unnamed", "item_id").orderBy(F.desc("similarity"), "start_word", "passage")
    return (
        reduce(DataFrame.unionByName, found).withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place", "unnamed")
    )


def item_indexes(items: DataFrame, shingle: int, radius: int, blocks: int, index_words: int) -> Iterator[ItemIndex]:
    """Indexes that together cover all items (``item_id, text``), each of some ``index_words`` words at most."""
    spaces = F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) + 1
    words = items.agg(F.sum(spaces).alias("n")).first()["n"] or 0
    parts = max(1, -(-words // index_words))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], shingle, radius, blocks)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS,
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """The documents none of whose windows matches an item, with all their columns; a filter without a shuffle."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where(
        "item_id is not null and text is not null"
    )
    for index in item_indexes(items, shingle, radius, blocks, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def leaky(texts: pa.Array, shared=shared) -> list[pa.Array]:
            out = np.zeros(len(texts), bool)
            for lo, _, data, offsets in slices(texts):
                for match in shared.value.matches(data, offsets, similarity):
                    out[lo + match[0]] = True
            return [pa.array(out)]

        docs = with_arrow_columns(docs, text_col, "_leaky boolean", leaky).where("NOT _leaky").drop("_leaky")
    return docs
