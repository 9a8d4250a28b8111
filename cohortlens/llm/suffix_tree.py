"""Scoring with a probabilistic suffix tree over words.

The root is the add-one unigram distribution of the training tokens. A state is a context of one or more preceding words; its
distribution counts the next tokens it was seen with and leaves the rest to its parent, the context without the oldest word:

    P_s(w) = (c(s, w) + (c(s) - listed(s) + smoothing) * P_parent(w)) / (c(s) + smoothing)

where listed(s) is the sum of the counts that the state keeps; this sums to one. A context becomes a state if its divergence
from the parent, weighted by its count, reaches ``min_gain`` nats, and its parent is one. A state keeps the next tokens seen
at least ``min_count`` times behind it, whatever the size of the input. Contexts get longer as long as states pass the test. A
token is scored by the longest state that ends before it; the start of a text counts as a word of contexts.

Counts are gathered over all training tokens and all words. States and their entries are tables of blocks, found by 64-bit
hashes of their words: the hash of n + 1 tokens is that of the two runs of n tokens in it. What is known of a key meets what asks
for it in a part of the range of keys, in blocks of numbers, not in rows. Broadcast are only structures of fixed size: a bit
filter that keeps most other contexts out of the shuffles, and the ``head_keys`` most frequent states and entries; the others,
and the root counts of words below ``dictionary_share``, are looked up, and sums per text come back. Where few tokens are left
behind a state, several depths are counted in one pass over the texts. None of this changes any result.

The score is a sum over the depths: a state adds log10 of the share it leaves to its parent, and the next tokens that it keeps
add what is between that and their own probability.

Defined results: a null or empty text is the end token alone; rows that share an id are scored one by one; a null id is
neither training nor held out (null) but scored; without training texts every base probability is one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.arrow import pieces, release_memory
from cohortlens.llm.shared import discarded, ship_package, stored
from cohortlens.llm.tokens import Words, mix, slices

MIN_COUNT = 2
DICTIONARY_SHARE = 5e-7
HEAD_KEYS, FILTER_BITS = 1 << 20, 1 << 28
# Texts are hashed about this many bytes at a time, so that what is computed stays in the processor's cache.
TEXT_BYTES = 1 << 18
# Of a filter: places in a part of it, and up to how many keys reach the driver as they are.
FILTER_PART, FEW_KEYS = 1 << 22, 1 << 20
# Depths counted in one pass, at most: as many as take no more than this share of the tokens together.
DEPTHS, DEPTHS_SHARE = 8, 0.125
# Pairs that a worker counts at once, and about how many of all pairs meet in a group.
PAIRS, GROUP_PAIRS = 1 << 20, 1 << 18
# Lookups that a worker gathers before it sends them, how many travel in a row, how many parts of the range of keys there are at
# least, and how many keys of the model are in a part at most.
LOOKUPS, BLOCK, LOOKUP_PARTS, PART_KEYS = 1 << 21, 1 << 10, 32, 1 << 20
MIN_GAIN = 10.0
SMOOTHING = 20.0
# Fixed hashes of the end token and of the start, which is never a next token.
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A2757A2757A275)
# The key of a state is its hash with these bits flipped, so that it differs from the entry of the same words.
STATE = 0x1B873593CC9E2D51
_OLDER, _NEWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, every text followed by the end, and the first token of each text."""
    words = Words(data, offsets)
    rows = len(offsets) - 1
    first = words.first + np.arange(rows + 1)
    out = np.full(first[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] - 1] = False
    out[is_word] = words.hashes()
    return out, first


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of every wanted key in the sorted keys, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Lookup:
    """Sorted keys, found by their first bits: these tell where the keys that begin with them start."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.held, self.shift = len(keys), np.uint64(64 - bits)
        self.keys = np.append(keys, ~np.uint64(0))
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of every wanted key, -1 where it isn't there."""
        at = self.start[wanted >> self.shift]
        key = self.keys[at]
        left = np.flatnonzero(key < wanted)
        while len(left):
            at[left] += 1
            key[left] = self.keys[at[left]]
            left = left[key[left] < wanted[left]]
        return np.where((key == wanted) & (at < self.held), at, -1)


def _joined(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Hash of n + 1 tokens from those of the first n and the last n."""
    return mix(older * _OLDER + newer * _NEWER)


def _in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(FILTER_BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


@dataclass
class SuffixTree:
    tokens: int
    distinct: int
    dictionary: np.ndarray  # sorted hashes of the frequent tokens
    counts: np.ndarray
    bits: np.ndarray  # filter of the keys of all states and entries
    head: np.ndarray  # sorted keys of the frequent ones
    head_value: np.ndarray
    states: list[DataFrame]  # per depth: ctx, pctx, escape, whole
    kept: list[DataFrame]  # per depth: blocks of states and entries
    held: int  # how many these are

    def __getstate__(self) -> dict:
        """What a worker needs: no tables, only how many."""
        own = {k: v for k, v in self.__dict__.items() if not k.startswith("_")}
        return own | {"states": [None] * len(self.states), "kept": []}

    @cached_property
    def _words(self) -> tuple[Lookup, np.ndarray, np.ndarray]:
        return Lookup(self.dictionary), np.append(self.counts, -1), np.append(self.root_log(self.counts), 0.0)

    @cached_property
    def _head(self) -> Lookup:
        return Lookup(self.head)

    @cached_property
    def _numbered(self) -> tuple[int, list[np.ndarray]]:
        tables = [[(r["ctx"], r["pctx"]) for r in s.select("ctx", "pctx").collect()] for s in self.states]
        base = 1 + max((max(Counter(p for _, p in t).values(), default=0) for t in tables), default=0)
        number, out = {0: 0}, []
        for d, table in enumerate(tables):
            seen, own = Counter(), {}
            for ctx, parent in sorted(table):
                own[ctx] = number[parent] + seen[parent] * base**d
                seen[parent] += 1
            number = own
            out.append(np.array(sorted(own.values()), object))
        return base, out

    @property
    def contexts(self) -> list[np.ndarray]:
        """Per depth the states of a small model, numbered: modulo ``base`` to the power of the depth before, their parent's."""
        return self._numbered[1]

    @property
    def base(self) -> int:
        return self._numbered[0]

    def root_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def walk(self, tokens: np.ndarray, first: np.ndarray, start: int = 1):
        """Per depth, from ``start`` on: the tokens (their places) whose context of one word less may be a state, the hashes of the
        context and of the context with the token, of the token with the context of one word less, and whether that may be an
        entry; then which of these contexts may be states, and which of the latter's tokens may be entries. Beyond the depths
        of the tree, all may be. At the depth ``start`` also which contexts were counted as pairs at the depth before."""
        rows = len(first) - 1
        length = np.diff(first)
        # a start in front of every text
        run = np.full(len(tokens) + rows, START, np.uint64)
        at = np.arange(len(tokens)) + np.repeat(np.arange(rows), length) + 1
        run[at] = tokens
        behind = np.arange(len(tokens)) - np.repeat(first[:-1], length) + 1
        own, listed, d = np.arange(len(tokens)), np.ones(len(tokens), bool), 1
        counted = np.zeros(len(tokens), bool)
        while len(own):
            longer = run.copy()
            longer[1:] = _joined(run[:-1], run[1:])
            place = at[own]
            context = run[place - 1]
            if d <= len(self.states):
                inside = np.flatnonzero(_in_bits(self.bits, context ^ np.uint64(STATE)))
            else:
                inside = np.arange(len(own))
            entered = np.ones(len(inside), bool)
            if d >= start - 1:
                entry = longer[place]
                if d <= len(self.states):
                    entered = _in_bits(self.bits, entry[inside])
                if d >= start:
                    yield own, context, entry, run[place], listed, inside, entered, counted[own - 1] if d == start else None
                else:
                    counted[own[listed]] = True
            own = own[inside]
            alive = np.flatnonzero(behind[own] > d)
            own, listed = own[alive], entered[alive]
            run, d = longer, d + 1

    def score(self, tokens: np.ndarray, first: np.ndarray):
        """Per token: its count (-1: not in the dictionary), and log10 P without what has to be looked up: the root's part of
        words that aren't in the dictionary, and states and entries beyond the head."""
        count, root, value, _, _ = self.parts(tokens, first)
        return count, root, value

    def parts(self, tokens: np.ndarray, first: np.ndarray):
        """``score``, and the tokens with keys that are still to be looked up."""
        words, counts, logs = self._words
        place = words.find(tokens)
        count, root = counts[place], logs[place]
        value = root.copy()
        token, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for own, context, entry, _, _, inside, entered, _ in islice(self.walk(tokens, first), len(self.states)):
            own = own[inside]
            for places, keys in ((own, context[inside] ^ np.uint64(STATE)), (own[entered], entry[inside[entered]])):
                found = self._head.find(keys)
                held, other = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
                value[places[held]] += self.head_value[found[held]]
                token.append(places[other])
                key.append(keys[other])
        return count, root, value, np.concatenate(token), np.concatenate(key)


def _order(key: np.ndarray) -> np.ndarray:
    """Order of the keys, equal ones as they come: sorted with their places in the last bits, which is faster."""
    bits = max(len(key) - 1, 1).bit_length()
    if bits <= 24:
        last = np.uint64((1 << bits) - 1)
        packed = (key & ~last) | np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & last).astype(np.int64)
        key_in_order = key[order]
        # the bits that were left out seldom matter
        if (key_in_order[1:] >= key_in_order[:-1]).all():
            return order
    return np.argsort(key, kind="stable")


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys' order, the first of each distinct key in it, where they are among the keys, and the distinct keys."""
    order = _order(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return order, first, order[first], key[first]


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers between each two ends, as bytes."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]
    )


def _flat(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers held in a column of bytes, one row after the other."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_flat(x, kind) for x in column.chunks] or [np.zeros(0, kind)])
    _, ends, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(ends, np.int32)
    at, end = int(ends[column.offset]), int(ends[column.offset + len(column)])
    return np.frombuffer(data, kind, (end - at) // np.dtype(kind).itemsize, at)


# Keys with what is held for each travel and are stored as rows of up to ``RUN`` of them: ``a`` and ``b`` hold keys, ``c`` counts,
# ``d`` and ``e`` other numbers; ``n`` is how many, ``total`` the sum of the counts.
RUN = 1 << 13
_KINDS = {"a": np.uint64, "b": np.uint64, "c": np.int64, "d": np.float64, "e": np.float64}
_HELD = {"level": "int", "part": "int", "kind": "int", "n": "bigint", "total": "bigint"} | dict.fromkeys(_KINDS, "binary")
# Of the first two a context's own count; the pairs of a context and a next token. Then what the tree keeps.
_ALONE, _PAIR, _STATE, _ENTRY = range(4)
# In a part: what is known of a key, and what asks for it.
_KNOWN, _ASKING = range(2)


def _packed(kind: int, values: Sequence[np.ndarray | None], part: np.ndarray | None = None, level: int = 0) -> pa.RecordBatch:
    """Rows that hold the values, whose parts come one after the other."""
    n = len(values[0])
    edge = np.flatnonzero(np.diff(part, prepend=-1)) if part is not None else np.zeros(min(n, 1), np.int64)
    cuts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(edge, np.append(edge[1:], n))] or [edge])
    ends = np.append(cuts, n).astype(np.int64)
    total = np.add.reduceat(values[2], cuts) if len(values) > 2 and values[2] is not None and n else np.zeros(len(cuts), np.int64)
    held = dict(zip(_KINDS, values))
    held = [pa.nulls(len(cuts), pa.binary()) if held.get(k) is None else _cut(held[k], ends) for k in _KINDS]
    same = lambda x: pa.array(np.full(len(cuts), x, np.int32))
    parts = pa.array(part[cuts].astype(np.int32)) if part is not None else same(0)
    return pa.RecordBatch.from_arrays([same(level), parts, same(kind), pa.array(np.diff(ends)), pa.array(total), *held], list(_HELD))


def _values(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [_flat(rows.column(k), kind) for k, kind in _KINDS.items()]


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in columns.items())


def _gathered(found: Iterator[Sequence[np.ndarray | None]], most: int) -> Iterator[list[np.ndarray | None]]:
    """Values put together until there are about so many."""
    joined = lambda: [None if x[0] is None else np.concatenate(x) for x in zip(*waiting)]
    waiting, held = [], 0
    for values in found:
        if len(values[0]):
            waiting.append(values)
            held += len(values[0])
        if held >= most:
            yield joined()
            waiting, held = [], 0
    if held:
        yield joined()


def _dealt(found: Iterator[Sequence[np.ndarray | None]], kind: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Values as rows for the parts of the range of keys that their first ones are in."""
    for values in _gathered(found, PAIRS):
        order = _order(values[0])
        values = [None if x is None else x[order] for x in values]
        yield from pieces(_packed(kind, values, _part_of(values[0], parts).astype(np.int64)))
    release_memory()


def _in_tasks(table: DataFrame, n: int) -> DataFrame:
    """A table of blocks that hold n keys, read by no more tasks than these need: a task takes a while to begin."""
    return table.coalesce(max(1, -(-n // GROUP_PAIRS)))


def _sent(
    table: DataFrame, n: int, change: Callable[[pa.RecordBatch], Sequence[np.ndarray | None]], kind: int, parts: int
) -> DataFrame:
    return _in_tasks(table, n).mapInArrow(lambda batches: _dealt(map(change, batches), kind, parts), _ddl(_HELD))


def _meeting(known: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
    """Rows of each part together, what is known first."""
    return known.unionAll(asking).repartition(parts, "part").sortWithinPartitions("part", "kind")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Part, kind and values of consecutive rows of a part and a kind."""
    for batch in batches:
        part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        edge = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
        for a, b in zip(edge, [*edge[1:], len(part)]):
            yield int(part[a]), int(kind[a]), _values(batch.slice(a, b - a))


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the training tokens: every word is a context, and every text has a start and an end."""
    context, _, c, _, _ = _values(batch)
    return np.where(context == START, END, context), c


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of states and entries, what each adds to a score, and their counts."""
    a, _, c, d, _ = _values(batch)
    state = np.repeat(batch.column("kind").to_numpy() == _STATE, batch.column("n").to_numpy())
    return np.where(state, a ^ np.uint64(STATE), a), d, c


def _all_kept(tree: SuffixTree) -> DataFrame:
    return _in_tasks(reduce(DataFrame.unionAll, tree.kept), tree.held)


def _state_rows(kept: DataFrame) -> DataFrame:
    """``ctx, pctx, escape, whole``, a row per state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, parent, whole, escape, _ = _values(batch)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (context, parent)), pa.array(escape), pa.array(whole)], ["ctx", "pctx", "escape", "whole"]
            )

    return kept.where(F.col("kind") == _STATE).mapInArrow(run, "ctx bigint, pctx bigint, escape double, whole bigint")


def _bits_of(table: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], n: int) -> np.ndarray:
    """Bit filter of the n keys that are in a table of blocks."""
    few = n <= FEW_KEYS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique((keys(batch) & np.uint64(FILTER_BITS - 1)).astype(np.uint32))
            part = (place // np.uint32(FILTER_PART)).astype(np.int64) * (not few)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            held = _cut(place, np.append(first, len(place)))
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), held], ["part", "held"])

    def merged(rows: pa.Table) -> pa.Table:
        flags = np.zeros(FILTER_PART, bool)
        flags[_flat(rows.column("held"), np.uint32) % FILTER_PART] = True
        bits = np.packbits(flags, bitorder="little")
        return pa.table({"part": rows.column("part").slice(0, 1), "held": pa.array([bits.tobytes()], pa.binary())})

    rows = _in_tasks(table, n).mapInArrow(places, "part int, held binary")
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    if few:
        place = _flat(rows.toArrow().column("held"), np.uint32)
        np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return out
    size = FILTER_PART >> 3
    found = rows.groupBy("part").applyInArrow(merged, "part int, held binary").toArrow()
    for part, held in zip(found.column("part").to_pylist(), found.column("held")):
        out[part * size : (part + 1) * size] = np.frombuffer(held.as_buffer(), np.uint8)
    return out


def _blocks(key: np.ndarray, context: np.ndarray, parent: np.ndarray, c: np.ndarray, parts: int) -> pa.RecordBatch:
    """Counts as one row per part of the range of keys: ``part``, and as bytes ``ctx, pentry, c``."""
    part = _part_of(key, parts)
    first = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    ends = np.append(first, len(key))
    held = [_cut(x, ends) for x in (context, parent, c.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *held], ["part", "ctx", "pentry", "c"])


def _block_sums(blocks: DataFrame, min_count: int) -> DataFrame:
    """Sums of the counts in blocks, where they are at least ``min_count``; of single words, all."""

    def run(table: pa.Table) -> pa.Table:
        level, part = table.column("level")[0].as_py(), table.column("part")[0].as_py()
        context, parent = _flat(table.column("ctx"), np.uint64), _flat(table.column("pentry"), np.uint64)
        c = _flat(table.column("c"), np.int32).astype(np.int64)
        # counts below zero are those of contexts themselves
        order, first, at, _ = _distinct(np.where(c < 0, context ^ np.uint64(STATE), _joined(context, parent)))
        c = np.add.reduceat(c[order], first)
        alone = np.flatnonzero(c <= (-1 if level == 1 else -min_count))
        pair = np.flatnonzero(c >= min_count)
        found = [
            _packed(kind, [context[at[own]], next_, np.abs(c[own])], np.full(len(own), part, np.int64), level)
            for kind, own, next_ in ((_ALONE, alone, None), (_PAIR, pair, parent[at[pair]])) if len(own)
        ]
        return pa.Table.from_batches(found, _packed(_PAIR, [np.zeros(0, np.uint64)]).schema)

    return blocks.groupBy("part", "level").applyInArrow(run, _ddl(_HELD))


def _context_counts(train: DataFrame, shared: Broadcast, depths: range, min_count: int, parts: int) -> DataFrame:
    """Counts (``_PAIR``: ``ctx, pentry, c``) of contexts of so many words (the ``level``) whose parent may be a state and which
    are seen with a next token at least ``min_count`` times; ``pentry`` is the token with the parent. But for two words, there
    are the counts of the contexts themselves (``_ALONE``: ``ctx, -, c``). ``shared`` holds the tree and a filter, if any, of the
    pairs of the depth before: a context that was counted among them and isn't there has too few next tokens. Counts travel in blocks, one per ``parts``-th of the range of keys, so that what is seen once is no
    row of its own."""

    def counted(waiting: dict[int, tuple[list, list, list]]) -> Iterator[pa.RecordBatch]:
        for level, (contexts, parents, alone) in waiting.items():
            blocks = []
            if contexts:
                context, parent = np.concatenate(contexts), np.concatenate(parents)
                contexts.clear()
                parents.clear()
                _, first, at, key = _distinct(_joined(context, parent))
                c = np.diff(np.append(first, len(context)))
                blocks.append(_blocks(key, context[at], parent[at], c, parts))
            if alone:
                key = np.concatenate(alone) ^ np.uint64(STATE)
                alone.clear()
                n = len(key)
                _, first, _, key = _distinct(key)
                c = -np.diff(np.append(first, n))
                blocks.append(_blocks(key, key ^ np.uint64(STATE), np.zeros(len(key), np.uint64), c, parts))
            for block in blocks:
                yield from pieces(block.append_column("level", pa.array(np.full(block.num_rows, level, np.int32))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, repeated = shared.value
        waiting, held = {level: ([], [], []) for level in depths}, 0
        for texts in (piece.column(0) for batch in batches for piece in pieces(batch)):
            for _, _, data, offsets in slices(texts, TEXT_BYTES):
                walk = tree.walk(*_tokens(data, offsets), depths.start)
                for level, (_, context, _, parent, listed, _, _, known) in zip(depths, walk):
                    if repeated is not None and known is not None:
                        known = np.flatnonzero(known)
                        worth = np.ones(len(context), bool)
                        worth[known] = _in_bits(repeated, context[known])
                        context, parent, listed = context[worth], parent[worth], listed[worth]
                    keep = np.flatnonzero(listed)
                    waiting[level][0].append(context[keep])
                    waiting[level][1].append(parent[keep])
                    held += len(waiting[level][0][-1])
                    if level != 2:
                        waiting[level][2].append(context)
                        held += len(context) if level > 2 else 0
                if held >= PAIRS:
                    yield from counted(waiting)
                    held = 0
                    release_memory()
        yield from counted(waiting)
        release_memory()

    return _block_sums(train.mapInArrow(run, "part int, ctx binary, pentry binary, c binary, level int"), min_count)


CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the table that needed them is written; every table here is read back from its files."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def _spent(table: DataFrame) -> None:
    """Remove a stored table."""
    files = table.inputFiles()
    discarded(table.sparkSession, files[0].rsplit("/", 1)[0] if files else None)


def _with_parents(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pairs with what is known of the next token with the parent: ``ctx, pentry, c, plog, pctx``, dealt out by their contexts."""

    def found() -> Iterator[Sequence[np.ndarray]]:
        current, known = None, []
        for part, kind, (key, other, c, plog, _) in _runs(batches):
            if part != current:
                current, known = part, []
            if kind == _KNOWN:
                known.append((key, other, plog))
                continue
            if isinstance(known, list):
                known = [np.concatenate(x) for x in zip(*known)] or [np.zeros(0, k) for k in (np.uint64, np.uint64, np.float64)]
                order = _order(known[0])
                known = tuple(x[order] for x in known)
            at = _find(known[0], key)
            have = np.flatnonzero(at >= 0)
            at = at[have]
            yield other[have], key[have], c[have], known[2][at], known[1][at].view(np.float64)

    return _dealt(found(), _ASKING, parts)


def _kept_of(batches: Iterator[pa.RecordBatch], min_gain: float, smoothing: float) -> Iterator[pa.RecordBatch]:
    """Of a part's contexts, the states (``ctx, pctx, whole, escape``) and their entries (``entry, ctx, c, value, log``)."""

    def tested(totals: list, pairs: list) -> Iterator[pa.RecordBatch]:
        if not totals or not pairs:
            return
        (known, whole), (context, parent, c, plog, above) = ([np.concatenate(x) for x in zip(*held)] for held in (totals, pairs))
        order = _order(known)
        known, whole = known[order], whole[order]
        order, first, _, key = _distinct(context)
        at = _find(known, key)
        parent, c, plog, above = (x[order] for x in (parent, c, plog, above))
        times = np.diff(np.append(first, len(order)))
        listed, whole = np.add.reduceat(c, first), np.where(at >= 0, whole[at], 0)
        escape = np.log10((whole - listed + smoothing) / (whole + smoothing), where=at >= 0, out=np.zeros(len(at)))
        of = lambda x: np.repeat(x, times)
        log = np.log10(c / of(whole + smoothing) + 10.0 ** (of(escape) + plog))
        gain = np.add.reduceat(c * (log - plog), first) + (whole - listed) * escape
        state = (at >= 0) & (gain * float(np.log(10)) >= min_gain)
        if state.any():
            yield _packed(_STATE, [key[state], above.view(np.uint64)[first[state]], whole[state], escape[state]])
            own, context = of(state), of(key)
            value = log - plog - of(escape)
            entry = _joined(context[own], parent[own])
            yield from pieces(_packed(_ENTRY, [entry, context[own], c[own], value[own], log[own]]))

    current, held = None, ([], [])
    for part, kind, (a, b, c, d, e) in _runs(batches):
        if part != current:
            yield from tested(*held)
            current, held = part, ([], [])
        held[kind].append((a, c) if kind == _KNOWN else (a, b, c, d, e))
    yield from tested(*held)
    release_memory()


def _grow(
    tree: SuffixTree, pairs: DataFrame, totals: Callable[[int], DataFrame], parents: Callable[[int], DataFrame], n: int,
    known: int, min_gain: float, smoothing: float,
) -> tuple[int, int]:
    """Add the states of the next depth to the tree; the sum of their counts, and how many entries there are (zero if there are
    no states). ``totals`` and ``parents`` deal out to so many parts: the counts of contexts; of the tokens with the parent, the
    parent and its log10 P of the entries it keeps. A token kept by a state is kept by its parent, too. There are ``n`` pairs
    and as many as ``known`` of the others."""
    parts = -(-(n + known) // GROUP_PAIRS)

    def asking(batch: pa.RecordBatch) -> Sequence[np.ndarray | None]:
        context, parent, c, _, _ = _values(batch)
        return parent, context, c

    found = _meeting(parents(parts), _sent(pairs, n, asking, _ASKING, parts), parts).mapInArrow(
        lambda batches: _with_parents(batches, parts), _ddl(_HELD)
    )
    kept = _meeting(totals(parts), found, parts).mapInArrow(lambda batches: _kept_of(batches, min_gain, smoothing), _ddl(_HELD))
    kept = stored(kept, "tree-kept")
    sizes = _sizes(kept)
    if not sizes:
        _spent(kept)
        return 0, 0
    whole, entries = sizes[_STATE, 0][1], sizes[_ENTRY, 0][0]
    held = sizes[_STATE, 0][0] + entries
    tree.kept.append(kept)
    tree.states.append(_state_rows(kept))
    tree.held += held
    tree.bits |= _bits_of(kept, lambda batch: _keyed(batch)[0], held)
    return whole, entries


def _sizes(table: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """By kind and level: how many keys there are, and the sum of the counts."""
    return {(r["kind"], r["level"]): (r["n"], r["total"]) for r in table.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}


def _no_parents(tree: SuffixTree, d: int) -> None:
    """Entries of a depth whose states have been tested are only looked up from now on: what their children needed goes."""
    kept = tree.kept[d - 1]
    of_state = lambda k: F.when(F.col("kind") == _STATE, F.col(k)).alias(k)
    tree.kept[d - 1] = stored(kept.select(*(of_state(k) if k in ("b", "e") else k for k in _HELD)), "tree-kept")
    tree.states[d - 1] = _state_rows(tree.kept[d - 1])
    _spent(kept)


def _set_head(tree: SuffixTree, most: int) -> None:
    """Take the most frequent keys, at most ``most``, whose counts are above a common bound."""
    if not tree.kept:
        return
    model = _all_kept(tree)
    band_of = lambda c: np.floor(np.log2(c) * 8).astype(np.int64)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, n = np.unique(band_of(_keyed(batch)[2]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(n)], ["band", "n"])

    low = None
    for row in sorted(model.mapInArrow(bands, "band bigint, n bigint").groupBy("band").agg(F.sum("n").alias("n")).collect(), reverse=True):
        most -= row["n"]
        if most < 0:
            break
        low = row["band"]
    if low is not None:

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, value, c = _keyed(batch)
                own = np.flatnonzero(band_of(c) >= low)
                yield _packed(_KNOWN, [key[own], None, None, value[own]])

        rows = model.mapInArrow(taken, _ddl(_HELD)).select("a", "d").toArrow()
        key, value = _flat(rows.column("a"), np.uint64), _flat(rows.column("d"), np.float64)
        del rows
        order = _order(key)
        tree.head, tree.head_value = key[order], value[order]


def fit_suffix_tree(
    train: DataFrame, depth: int | None = None, min_count: int = MIN_COUNT, dictionary_share: float = DICTIONARY_SHARE,
    min_gain: float = MIN_GAIN, smoothing: float = SMOOTHING, head_keys: int = HEAD_KEYS,
) -> tuple[SuffixTree, DataFrame]:
    """The tree, and the counts of all training tokens (a table of blocks), from a table with a ``text`` column. With a
    ``depth`` no context is longer."""
    with _shuffles_removed(train.sparkSession):
        return _fit(train, depth, min_count, dictionary_share, min_gain, smoothing, head_keys)


def _fit(
    train: DataFrame, depth: int | None, min_count: int, dictionary_share: float, min_gain: float, smoothing: float, head_keys: int
) -> tuple[SuffixTree, DataFrame]:
    spark = train.sparkSession
    ship_package(spark)
    texts = train.select(F.col("text").cast("string"))
    length, rows = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    # words have some five letters
    counting = -(-((length or 0) // 6 + rows) // GROUP_PAIRS) or 1

    def counted_at(depths: range, repeated: np.ndarray | None) -> DataFrame:
        shared = spark.sparkContext.broadcast((tree, repeated))
        counted = stored(_context_counts(texts, shared, depths, min_count, counting), "tree-contexts")
        shared.destroy()
        del shared
        # the driver gives back what the copies for the workers took
        release_memory()
        return counted

    none = np.zeros(0, np.uint64)
    # counting words and their pairs needs no filter
    tree = SuffixTree(0, 0, none, none.astype(np.int64), np.zeros(0, np.uint8), none, np.zeros(0), [], [], 0)
    counted = before = counted_at(range(1, 2), None)
    words = stored(counted.where(F.col("kind") == _ALONE), "tree-words")
    tree.tokens, tree.distinct = (x or 0 for x in words.agg(F.sum("total"), F.sum("n")).first())
    least, bottom = max(1, int(np.ceil(tree.tokens * dictionary_share))), float(tree.tokens + tree.distinct + 1)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = _words_of(batch)
            own = np.flatnonzero(c >= least)
            yield _packed(_KNOWN, [h[own], None, c[own]])

    # bounded by 1 / dictionary_share
    found = words.mapInArrow(frequent, _ddl(_HELD)).select("a", "c").toArrow()
    h, c = _flat(found.column("a"), np.uint64), _flat(found.column("c"), np.int64)
    del found
    order = _order(h)
    tree.dictionary, tree.counts, tree.bits = h[order], c[order], np.zeros(FILTER_BITS >> 3, np.uint8)

    def own_count(batch: pa.RecordBatch) -> Sequence[np.ndarray | None]:
        context, _, c, _, _ = _values(batch)
        return context, None, c

    def pair(batch: pa.RecordBatch) -> Sequence[np.ndarray | None]:
        context, parent, c, _, _ = _values(batch)
        return _joined(context, parent), None, c

    def word(batch: pa.RecordBatch) -> Sequence[np.ndarray | None]:
        h, c = _words_of(batch)
        # what is seen less isn't in a pair either
        h, c = h[c >= min_count], c[c >= min_count]
        return h, np.zeros(len(h), np.uint64), None, np.log10((c + 1) / bottom)

    def entry(batch: pa.RecordBatch) -> Sequence[np.ndarray | None]:
        entry, context, _, _, log = _values(batch)
        return entry, context, None, log

    of_kind = lambda table, kind, level: table.where((F.col("kind") == kind) & (F.col("level") == level))
    depths, d, sizes, entries = range(1, 2), 1, _sizes(counted), tree.distinct
    while tree.tokens and (depth is None or d <= depth):
        if d not in depths:
            more = min(DEPTHS, int(tree.tokens * DEPTHS_SHARE) // whole) if d > 2 else 1
            depths = range(d, min(d + max(1, more), d + DEPTHS if depth is None else depth + 1))
            counted = counted_at(depths, repeated)
            sizes |= _sizes(counted)
        n = sizes.get((_PAIR, d), (0, 0))[0]
        # the counts of one depth are the totals of the next
        sums, of, change = (before, (_PAIR, 1), pair) if d == 2 else (counted, (_ALONE, d), own_count)
        above, known = (words, word) if d == 1 else (tree.kept[-1].where(F.col("kind") == _ENTRY), entry)
        summed = sizes.get(of, (0, 0))[0]
        whole, entries = _grow(
            tree, of_kind(counted, _PAIR, d), lambda parts: _sent(of_kind(sums, *of), summed, change, _KNOWN, parts),
            lambda parts: _sent(above, entries, known, _KNOWN, parts), n, max(summed, entries), min_gain, smoothing,
        ) if n else (0, 0)
        if d > 1:
            _no_parents(tree, d - 1)
        if d == 2:
            _spent(before)
            before = None
        d += 1
        if d not in depths:
            repeated = _bits_of(of_kind(counted, _PAIR, d - 1), lambda batch: pair(batch)[0], n) if whole else None
            if counted is not before:
                _spent(counted)
                counted = None
        if not whole:
            break
    if tree.kept and len(tree.kept) == d - 1:
        _no_parents(tree, d - 1)
    for table in (before, counted if counted is not before else None):
        if table is not None:
            _spent(table)
    _set_head(tree, head_keys)
    release_memory()
    return tree, words


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes in front, then their second ones: small numbers leave runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(held: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held.as_buffer(), np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _asked(key: np.ndarray, row: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]:
    """Lookups in blocks of at most ``BLOCK``, each within a part of the range of keys: the parts, and as bytes the steps between
    the distinct keys, how many rows ask for each, and these rows (once for each time)."""
    order = _order(key)
    key, row = key[order], row[order].astype(np.int32)
    part = _part_of(key, parts)
    edge = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edge, np.append(edge[1:], len(key)))])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[cuts] = True
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    at = np.append(np.searchsorted(first, cuts), len(first)).tolist()
    steps, rows = key[first], np.append(cuts, len(key)).tolist()
    steps[1:] -= key[first[:-1]]
    steps[at[:-1]] = key[cuts]
    return (
        part[cuts], [_planes(steps[a:b]) for a, b in zip(at, at[1:])], [_planes(times[a:b]) for a, b in zip(at, at[1:])],
        [_planes(row[a:b]) for a, b in zip(rows, rows[1:])],
    )


_ASK = {"part": "int", "kind": "int", "row": "bigint"}
_BLOBS = {"steps": "binary", "times": "binary", "rows": "binary", "held": "binary"}
_SUMS = {"doc_id": "bigint", "n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
_FOUND = {"more": "bigint", "rest": "double", "longer": "double"}
# What a row of a part is, in the order in which they come: words and states and entries of the model, blocks that ask for either, and
# the sums of a text's own.
_WORD, _LONGER, _ASK_WORD, _ASK_LONGER, _OWN = range(5)


def _filled(columns: dict[str, str], n: int, values: dict) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values[k], kinds[t]) if k in values else pa.nulls(n, kinds[t]) for k, t in columns.items()], list(columns)
    )


def _model_blocks(kind: int, key: np.ndarray, value: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys of the model with what is held for each, in blocks like those that ask for them."""
    order = _order(key)
    key, value = key[order], value[order]
    part = _part_of(key, parts)
    edge = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edge, np.append(edge[1:], len(key)))])
    steps = np.diff(key, prepend=np.uint64(0))
    steps[cuts] = key[cuts]
    ends = [*cuts[1:].tolist(), len(key)]
    return _filled(_ASK | _BLOBS | _SUMS, len(cuts), {
        "part": part[cuts].astype(np.int32), "kind": np.full(len(cuts), kind, np.int32),
        "steps": [_planes(steps[a:b]) for a, b in zip(cuts, ends)], "held": [_planes(value[a:b]) for a, b in zip(cuts, ends)],
    })


def _block_answers(
    blocks: pa.RecordBatch, keys: np.ndarray, values: np.ndarray, root_log: Callable[[np.ndarray], np.ndarray] | None
) -> tuple[int, dict]:
    """How many texts ask, and their sums: of words with ``root_log``, else of states and entries."""
    wanted = np.concatenate([np.cumsum(_numbers(x, np.uint64)) for x in blocks.column("steps")])
    times = np.concatenate([_numbers(x, np.int32) for x in blocks.column("times")])
    rows = [_numbers(x, np.int32) for x in blocks.column("rows")]
    row = np.repeat(blocks.column("row").to_numpy(), list(map(len, rows))) + np.concatenate(rows)
    at = _find(keys, wanted)
    value = values[np.maximum(at, 0)] if len(keys) else np.zeros(len(at))
    value = np.repeat(np.where(at >= 0, value, 0), times)
    texts, which = np.unique(row, return_inverse=True)
    if root_log is None:
        return len(texts), {"row": texts, "longer": np.bincount(which, value)}
    return len(texts), {"row": texts, "more": np.bincount(which, value > 0).astype(np.int64), "rest": np.bincount(which, root_log(value))}


def _answered(batches: Iterator[pa.RecordBatch], root_log: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums per text of what the blocks of a part ask for; the parts come one after the other, in the order of the kinds."""
    columns = {"row": "bigint"} | _SUMS | _FOUND
    current, tables = None, {}
    for batch in batches:
        part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
        for a, b in zip(edge, [*edge[1:], len(part)]):
            if part[a] != current:
                current, tables = part[a], {_WORD: [], _LONGER: []}
            own, held = kind[a], batch.slice(a, b - a)
            if own in (_WORD, _LONGER):
                key = np.concatenate([np.cumsum(_numbers(x, np.uint64)) for x in held.column("steps")])
                tables[own].append((key, np.concatenate([_numbers(x, np.float64) for x in held.column("held")])))
            elif own == _OWN:
                yield _filled(columns, b - a, {k: held.column(k) for k in ("row", *_SUMS)})
            else:
                table = tables[own - _ASK_WORD]
                if isinstance(table, list):
                    key = np.concatenate([k for k, _ in table] or [np.zeros(0, np.uint64)])
                    order = _order(key)
                    value = np.concatenate([v for _, v in table] or [np.zeros(0)])
                    table = tables[own - _ASK_WORD] = (key[order], value[order])
                for blocks in pieces(held):
                    yield _filled(columns, *_block_answers(blocks, *table, root_log if own == _ASK_WORD else None))
        del batch
    release_memory()


def score_texts(docs: DataFrame, tree: SuffixTree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    release_memory()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")
    )
    parts = max(LOOKUP_PARTS, -(-(tree.distinct + tree.held) // PART_KEYS))
    columns = _ASK | _BLOBS | _SUMS
    bottom = tree.tokens + tree.distinct + 1

    def tree_log(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / bottom)

    def sent(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What was gathered, as blocks; the rows in them count from the first one."""
        base = waiting[0][0] if waiting else 0
        for kind, k in ((_ASK_WORD, 1), (_ASK_LONGER, 3)):
            key = np.concatenate([x[k] for x in waiting] or [np.zeros(0, np.uint64)])
            if len(key):
                row = np.concatenate([x[k + 1] + (x[0] - base) for x in waiting])
                part, steps, times, asking = _asked(key, row, parts)
                n = len(part)
                blocks = _filled(columns, n, {
                    "part": part.astype(np.int32), "kind": np.full(n, kind, np.int32), "row": np.full(n, base), "steps": steps,
                    "times": times, "rows": asking,
                })
                del key, row, steps, times, asking
                yield from pieces(blocks)
        waiting.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        waiting, held = [], 0
        for batch in (piece for batch in batches for piece in pieces(batch)):
            number = batch.column(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(2), TEXT_BYTES):
                tokens, first = _tokens(data, offsets)
                count, root, value, token, key = tree.parts(tokens, first)
                run_of = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[first[1:]] - s[first[:-1]]
                own = number[lo:hi]
                yield _filled(columns, hi - lo, {
                    "part": (own % parts).astype(np.int32), "kind": np.full(hi - lo, _OWN, np.int32), "row": own,
                    "doc_id": batch.column(1).slice(lo, hi - lo), "n_tokens": np.diff(first).astype(np.int64),
                    "n_known": run_of(count > 0).astype(np.int64), "base_score": run_of(root), "score": run_of(value),
                })
                rare = np.flatnonzero(count < 0)
                # rows of a partition are numbered without gaps
                rows_of = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))
                waiting.append((own[0], tokens[rare], rows_of[rare], key, rows_of[token]))
                held += len(rare) + len(key)
                if held >= LOOKUPS:
                    yield from sent(waiting)
                    held = 0
                    release_memory()
        yield from sent(waiting)
        release_memory()

    def packed(batches: Iterator[pa.RecordBatch], kind: int, keyed: Callable) -> Iterator[pa.RecordBatch]:
        for key, value in _gathered(map(keyed, batches), LOOKUPS):
            yield from pieces(_model_blocks(kind, key, value, parts))
        release_memory()

    def word(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h, c = _words_of(batch)
        return h, c.astype(np.float64)

    asked = rows.mapInArrow(run, _ddl(columns)).unionAll(
        _in_tasks(counts, tree.distinct).mapInArrow(lambda batches: packed(batches, _WORD, word), _ddl(columns))
    )
    if tree.kept:
        asked = asked.unionAll(_all_kept(tree).mapInArrow(lambda batches: packed(batches, _LONGER, lambda x: _keyed(x)[:2]), _ddl(columns)))
    found = asked.repartition(parts, "part").sortWithinPartitions("part", "kind", "row").mapInArrow(
        lambda batches: _answered(batches, tree_log), _ddl({"row": "bigint"} | _SUMS | _FOUND)
    )
    per_row = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("known"),
        F.sum("more").alias("more"), F.sum("rest").alias("rest"), F.max("base_score").alias("base"), F.max("score").alias("value"),
        F.sum("longer").alias("longer"),
    )
    rest = F.coalesce("rest", F.lit(0.0))
    return per_row.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + rest).alias("base_score"), (F.col("value") + rest + F.coalesce("longer", F.lit(0.0))).alias("score"),
    )
