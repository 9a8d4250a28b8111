"""Byte-level BPE by a monoid tree reduction.

A text is cut by the pattern of the rank file; every match is encoded by itself. A match that is a token as a whole is that
token. Any other is halved until a part has at most ``LEAF`` bytes, which is merged pair by pair, lowest rank and then leftmost
first. Two encoded neighbours are joined by merging a window over their border anew, from one token on either side, and
doubling it on a side until the tokens outside stay as they are: until the token next to the window and the first one inside
merge to themselves when they are merged as a pair. That settles it, because a sequence of tokens is the encoding of its bytes
if and only if each two neighbours are the encoding of theirs: the first merge across a border in the whole would be the first
one in that pair, too. Joining is associative, and so is decoding, the concatenation of the tokens' bytes.

Rows and columns: null texts count as empty and have no ids. Repeated rows, null ids and any other columns pass through;
``token_ids``, ``n_tokens`` and ``decoded`` replace columns of the same names. Malformed UTF-8 counts as U+FFFD. Texts of any
length are encoded whole: a match without any break costs about n log(n)^2. A null list of ids decodes to no bytes, and null
ids among others are passed over; an id that the rank file lacks is an error. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import heapq
import pathlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.arrow import with_arrow_columns
from cohortlens.llm.tokens import slices

LEAF = 32                  # bytes merged without a further cut
SHORT = 48                 # bytes up to which looking through all pairs is quicker than a heap
WORD_BYTES = 64 << 20      # bound on the words a worker remembers, with their ids
LONGEST_KEPT = 256         # bytes of a word worth remembering
PAIRS_KEPT = 1 << 16


class Merges:
    """Merging by ranks, and the tree reduction on top of it."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.single = [bytes([i]) for i in range(256)]
        self.apart = functools.lru_cache(PAIRS_KEPT)(self._apart)

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of some bytes by merging pairs, without any cut."""
        return self._scanned(data) if len(data) <= SHORT else self._heaped(data)

    def _scanned(self, data: bytes) -> list[bytes]:
        rank = self.ranks.get
        parts = [self.single[b] for b in data]
        scores = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, score in enumerate(scores):
                if score is not None and (best is None or score < best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at])

    def _heaped(self, data: bytes) -> list[bytes]:
        rank, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))          # of the part that starts here; 0 where none does any more
        before = list(range(-1, n))          # start of the part before
        waiting = [(score, i, i + 2) for i in range(n - 1) if (score := rank(data[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, at, stop = heapq.heappop(waiting)
            middle = end[at]
            # a pair whose parts have changed since is out of date
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
                if (score := rank(data[at : end[stop]])) is not None:
                    heapq.heappush(waiting, (score, at, end[stop]))
            if at and (score := rank(data[before[at] : stop])) is not None:
                heapq.heappush(waiting, (score, before[at], stop))
        parts, at = [], 0
        while at < n:
            parts.append(data[at : end[at]])
            at = end[at]
        return parts

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens stay as they are next to each other."""
        return self.merged(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of two encoded neighbours."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(left[len(left) - i :]) + b"".join(right[:j]))
            settled_left = i == len(left) or self.apart(left[-i - 1], window[0])
            settled_right = j == len(right) or self.apart(window[-1], right[j])
            if settled_left and settled_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if settled_left else 2 * i), (j if settled_right else 2 * j)

    def reduced(self, data: bytes) -> list[bytes]:
        """Tokens of some bytes by the tree."""
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.reduced(data[:half]), self.reduced(data[half:]))

    def ids(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        return [known] if known is not None else [self.ranks[token] for token in self.reduced(word)]


class _Words(dict):
    """Ids of words as packed 32-bit numbers, found when first asked for, within a bound of bytes."""

    def __init__(self, merges: Merges, most: int = WORD_BYTES):
        self.merges, self.most, self.held = merges, most, 0

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8", "replace")
        packed = np.array(self.merges.ids(data), dtype="<i4").tobytes()
        if len(data) <= LONGEST_KEPT:
            # text, ids, and about what the two objects and their entry take
            self.held += len(data) + len(packed) + 200
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = packed
        return packed


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base 64 and its id per line."""
    lines = pathlib.Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def _unlike_letters() -> frozenset[str]:
    """Characters that the two regular-expression libraries put in different classes, being of different Unicode versions.
    The tokenizer's library decides."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    unlike: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding(
            "classes", pat_str=kind + "+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
        )
        unlike |= set(probe.decode(probe.encode_ordinary(every))) ^ set(regex.findall(kind, every))
    return frozenset(unlike)


class _Splitter:
    """Matches of the pattern in a text."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.unlike = _unlike_letters()

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.unlike.isdisjoint(text):
            return self.find(text)
        # they are unassigned to the older library, like U+FFFF to both; the matches cover the text
        words, at = [], 0
        for word in self.find("".join("\uffff" if c in self.unlike else c for c in text)):
            words.append(text[at : at + len(word)])
            at += len(word)
        return words


@functools.lru_cache(4)
def _encoder(path: str, pattern: str, leaf: int) -> tuple[_Splitter, _Words]:
    return _Splitter(pattern), _Words(Merges(read_ranks(path), leaf))


@functools.lru_cache(4)
def _token_bytes(path: str) -> pa.Array:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def encoded(texts: pa.Array, path: str, pattern: str, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's begin (one entry more than texts)."""
    split, words = _encoder(path, pattern, leaf)
    found, counts = [], [0]
    for _, _, data, offsets in slices(texts):
        held = data.tobytes()
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            packed = b"".join(map(words.__getitem__, split(held[start:end].decode("utf-8", "replace"))))
            found.append(packed)
            counts.append(len(packed) // 4)
    return np.frombuffer(b"".join(found), dtype="<i4"), np.cumsum(counts)


def decoded(ids: np.ndarray, starts: np.ndarray, path: str) -> pa.Array:
    """Bytes of lists of ids. The tokens' bytes lie one behind another, so that those of a list are one range of them."""
    table = _token_bytes(path)
    known = len(ids) == 0 or (ids.min() >= 0 and ids.max() < len(table))
    if not known or (taken := table.take(pa.array(ids))).null_count:
        raise ValueError("an id that the vocabulary does not have")
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[starts])), data]
    ).cast(pa.binary())


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))


def with_token_ids(df: DataFrame, path: str, pattern: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``df`` with ``token_ids`` and ``n_tokens``."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids, starts = encoded(texts, path, pattern, leaf)
        return [_lists(ids, starts), pa.array(np.diff(starts))]

    return with_arrow_columns(df, text_col, "token_ids array<int>, n_tokens bigint", compute)


def with_decoded(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids."""

    def compute(lists: pa.Array) -> list[pa.Array]:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.flatten()
        present = flat.is_valid().to_numpy(zero_copy_only=False)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.cumsum(present)])
        starts = kept[np.concatenate([[0], np.cumsum(lengths)])]
        return [decoded(flat.drop_null().to_numpy(zero_copy_only=False), starts, path)]

    narrow = df.withColumn(ids_col, F.col(f"`{ids_col}`").cast("array<int>"))
    return with_arrow_columns(narrow, ids_col, "decoded binary", compute, cast="array<int>")


def with_round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``token_ids``, ``n_tokens`` and ``decoded`` in one pass over the texts."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids, starts = encoded(texts, path, pattern, leaf)
        return [_lists(ids, starts), pa.array(np.diff(starts)), decoded(ids, starts, path)]

    return with_arrow_columns(df, text_col, "token_ids array<int>, n_tokens bigint, decoded binary", compute)
