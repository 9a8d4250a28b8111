"""Words and word shingles of a whole Arrow column of texts at once, as 64-bit hashes.

Shared by the operators that run inside ``mapInArrow``. A word is a maximal run of bytes outside space and 0x09-0x0D, so
words never cut a UTF-8 sequence; A-Z counts as a-z. The hash of a word is a polynomial over its bytes modulo 2**64 with a
random byte table, finished by a bit mixer; it depends on nothing but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
EXACT = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Bytes between words where only letters and digits count (bytes of other scripts do).
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
# Texts are handled in slices of about this many bytes, whatever the size of the Arrow batch; a longer text is one slice.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest slice seen in this worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


powers = _Powers.upto


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return held[first : offsets[-1]] if len(offsets) else held, offsets - first


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most about ``most`` bytes: first row, row behind the last, their bytes and offsets."""
    data, offsets = buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of some texts: byte ranges ``start`` to ``end``, the ``row`` each is in, and ``first``: for every row its
    first word (one entry more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        solid = ~between[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        opens, closes = solid.copy(), solid.copy()
        if n:
            opens[1:] &= ~solid[:-1] | edge[1:n]
            closes[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data = data

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each byte range; with the table ``EXACT``, upper and lower case differ."""
    n = len(data)
    up, down = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``size`` consecutive words at every word, and whether all of them are in the same row."""
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        factor = np.uint64(_BYTE[200 + k % 56])
        out[: max(n - k, 0)] += words[k:] * factor
        out = mix(out) if k + 1 < size else out
    ends = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n) + size <= ends
