"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked (a space becomes the word mark, one is put in front) and cut before every run of marks; no piece of the
vocabulary reaches over such a cut, so the marked words are encoded one by one. The distinct marked words of an Arrow batch
are sorted, which lays them out as a depth-first walk of their trie: from one word to the next the forward states of the
common prefix are kept, and only those of the new characters are computed.

The forward state of a prefix is its best last piece. In a unigram model that is the piece with the largest sum of scores.
A BPE model doesn't maximize a sum; there the encoding of a prefix ends in the one piece t for which the encoding of the
rest ends in a piece that stays apart from t when the two are merged on their own, so the state is found by the same
forward pass with that test in place of the sum. A worker remembers a bounded number of words and tests during a task. Both give
the ids of the model's own library. Runs of several marks,
whose pieces have equal scores, are merged directly.

Decoding puts the pieces' bytes together again. Characters outside the vocabulary are written as byte pieces, and so is the
mark where it occurs in a text (the library would turn it into a space), so that every valid text survives the round trip.

Defined results: a null text has null ids, an empty one no ids. The model file is read on the driver and broadcast; its
size is that of the vocabulary.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.arrow import with_arrow_columns
from cohortlens.llm.tokens import EXACT, SLICE_BYTES, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# stands for a mark that is in the text itself; can't occur in valid UTF-8
_LITERAL_MARK = "\udc81"
UNKNOWN_PENALTY = 10.0
# Distinct words are gathered over about this much text at a time.
ENCODE_BYTES = 2 << 20
# Words remembered before a slice, and tests whether pieces stay apart.
CACHED_WORDS, CACHED_TESTS = 50_000, 200_000
# Characters of a word whose prefixes have their ids kept; what is behind them is found by the last pieces.
KEPT_PREFIX = 48


class PieceModel:
    """Vocabulary of a SentencePiece model with byte fallback."""

    def __init__(self, model_file: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as source:
            proto.ParseFromString(source.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalization can be decoded to the same text")
        if not proto.normalizer_spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with a leading word mark and byte fallback are supported")
        kinds = pb.ModelProto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.ids, self.scores, self.bytes_of = {}, {}, []
        self.byte_ids = [0] * 256
        for number, piece in enumerate(proto.pieces):
            if piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_ids[value] = number
                self.bytes_of.append(bytes([value]))
            elif piece.type == kinds.NORMAL:
                if MARK in piece.piece.lstrip(MARK):
                    raise ValueError("a piece reaches over a word mark")
                self.ids[piece.piece] = number
                self.scores[piece.piece] = piece.score
                self.bytes_of.append(piece.piece.replace(MARK, " ").encode())
            else:
                self.bytes_of.append(b"")
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.packed = {piece: array("I", [number]).tobytes() for piece, number in self.ids.items()}
        # by the left piece
        self._apart: dict[str, dict[str, bool]] = {}
        self._tests = 0
        self._spines: dict[str, tuple[list, list]] = {}
        self._words: dict[str, bytes] = {}
        # pieces that merging can yield
        self.whole = {p for p in self.ids if self.merge(p) == [p]} if self.bpe else set(self.ids)

    def forget(self) -> None:
        """Let go of what was remembered."""
        for held in (self._apart, self._spines, self._words):
            held.clear()
        self._tests = 0

    def merge(self, text: str, log: list | None = None) -> list[str]:
        """BPE pieces of a text by merging the best pair, the leftmost of equal ones. ``log`` gets the merges."""
        parts = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (score := self.scores.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            if log is not None:
                log.append((parts[i], parts[j]))
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def spines(self, piece: str) -> tuple[list, list]:
        """How a piece comes about by merging: the parts at its left edge and those at its right edge, from the character to
        the whole, each with the score of the merge that ends it (none for the whole)."""
        if piece not in self._spines:
            log: list[tuple[str, str]] = []
            self.merge(piece, log)
            split = {a + b: (a, b) for a, b in log}
            edges = []
            for side in (0, 1):
                chain, part, end = [], piece, None
                while True:
                    chain.append((part, end))
                    if part not in split:
                        break
                    end = self.scores[part]
                    part = split[part][side]
                edges.append(chain[::-1])
            self._spines[piece] = (edges[0], edges[1])
        return self._spines[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay as they are when merged from characters.

        The parts that meet at the border at any time are one of the left piece's right edge and one of the right piece's left
        edge. They merge across the border if that merge is better than the one that ends the left part, and no worse than the
        one that ends the right part (of equal merges the leftmost comes first).
        """
        known = self._apart.get(left, {}).get(right)
        if known is not None:
            return known
        a, b = self.spines(left)[1], self.spines(right)[0]
        i = j = 0
        fits = True
        while True:
            x, x_end = a[i]
            y, y_end = b[j]
            own = self.scores.get(x + y)
            if own is not None and (x_end is None or own > x_end) and (y_end is None or own >= y_end):
                fits = False
                break
            if x_end is None and y_end is None:
                break
            # the better merge comes first, and the left one of equal ones
            if y_end is None or (x_end is not None and x_end >= y_end):
                i += 1
            else:
                j += 1
        if self._tests >= CACHED_TESTS:
            for held in self._apart.values():
                held.clear()
            self._apart.clear()
            self._tests = 0
        self._apart.setdefault(left, {})[right] = fits
        self._tests += 1
        return fits

    def encode_cached(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct marked words; words of earlier calls are looked up, the others walked in sorted order. When
        there are too many, those stay that are asked for again."""
        cache = self._words
        out = list(map(cache.get, words))
        if len(cache) > CACHED_WORDS:
            self._words = cache = {w: ids for w, ids in zip(words, out) if ids is not None}
        places = sorted([i for i, ids in enumerate(out) if ids is None], key=words.__getitem__)
        new = [words[i] for i in places]
        for i, word, ids in zip(places, new, self._pieces(new)):
            out[i] = ids
            if len(word) <= 32:
                cache[word] = ids
        return out

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of sorted distinct marked words, by one depth-first pass over their trie."""
        return (array("I", ids).tolist() for ids in self._pieces(words))

    def _pieces(self, words: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of sorted distinct marked words."""
        return self._walk_bpe(words) if self.bpe else self._walk_unigram(words)

    def _walk_unigram(self, words: Iterable[str]) -> Iterator[bytes]:
        # per prefix length: its last piece, its score
        last, score = [""], [0.0]
        previous = ""
        for word in words:
            common = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], score[common + 1 :]
            self._extend_unigram(word, common, last, score)
            previous = word
            pieces, end = [], len(word)
            while end:
                piece = last[end]
                pieces.append(piece)
                end -= len(piece)
            pieces.reverse()
            yield self._pack(pieces)

    def _walk_bpe(self, words: Iterable[str]) -> Iterator[bytes]:
        """The forward state of a prefix is the piece that stays apart from the one before it; the packed ids of the first
        ``KEPT_PREFIX`` prefixes are part of it, so that a word needs no way back."""
        known, packed, longest, apart = self.whole, self.packed, self.longest, self._apart
        # per prefix length: its last piece, what is known about that piece as the left one, its ids
        last: list[str] = [""]
        tests: list[dict[str, bool]] = [{}]
        ids = [b""]
        previous = ""
        for word in words:
            if word.startswith(MARK + MARK):
                yield self._pack(self.merge(word))
                continue
            common = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], tests[common + 1 :], ids[common + 1 :]
            previous, size = word, len(word)
            for end in range(common + 1, size + 1):
                start = end - 1
                piece = word[start]
                while start:
                    fits = tests[start].get(piece)
                    if fits or (fits is None and self.apart(last[start], piece)):
                        break
                    # the next longer piece that ends here
                    stop = end - longest if end > longest else 0
                    start -= 1
                    while start >= stop and (piece := word[start:end]) not in known:
                        start -= 1
                    if start < stop:
                        raise AssertionError(f"no encoding of {word[:end]!r}")
                last.append(piece)
                try:
                    tests.append(apart[piece])
                except KeyError:
                    held = apart[piece] = {}
                    tests.append(held)
                if end <= KEPT_PREFIX:
                    ids.append(ids[start] + (packed[piece] if piece in packed else self._pack([piece])))
            if size <= KEPT_PREFIX:
                yield ids[size]
            else:
                pieces = []
                while size > KEPT_PREFIX:
                    pieces.append(last[size])
                    size -= len(last[size])
                pieces.reverse()
                yield ids[size] + self._pack(pieces)

    def _pack(self, pieces: list[str]) -> bytes:
        packed = self.packed
        try:
            return b"".join([packed[piece] for piece in pieces])
        except KeyError:
            return array("I", self._numbers(pieces)).tobytes()

    def _extend_unigram(self, word: str, done: int, last: list[str], score: list[float]) -> None:
        """Forward states of the characters behind the first ``done``: the best sum of scores."""
        for end in range(done + 1, len(word) + 1):
            best, chosen = None, word[end - 1]
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                own = self.scores.get(piece)
                if own is None:
                    if start < end - 1:
                        continue
                    own = self.unknown
                total = score[start] + own
                if best is None or total > best:
                    best, chosen = total, piece
            last.append(chosen)
            score.append(best)

    def _numbers(self, pieces: Iterable[str]) -> list[int]:
        out = []
        for piece in pieces:
            number = self.ids.get(piece)
            if number is not None:
                out.append(number)
            else:
                raw = MARK if piece == _LITERAL_MARK else piece
                out += [self.byte_ids[b] for b in raw.encode("utf-8", "surrogatepass")]
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes in one array, and the first byte of each."""
        first = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), first.astype(np.int64)


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... (counts[i] of them) one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front; an empty text stays empty."""
    lens = np.diff(offsets)
    new = np.concatenate([[0], np.cumsum(lens + (lens > 0))])
    out = np.full(new[-1], 32, np.uint8)
    keep = np.ones(new[-1], bool)
    keep[new[:-1][lens > 0]] = False
    out[keep] = data
    return out, new


def _marked_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The byte ranges as marked words, decoded many at a time with a zero byte behind each."""
    out: list[str] = []
    ends = np.cumsum(end - start + 1)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        if hi == lo + 1:
            held = data[start[lo] : end[lo]].tobytes().decode("utf-8", "replace")
            out.append(held.replace(MARK, _LITERAL_MARK).replace(" ", MARK))
        else:
            lens = end[lo:hi] - start[lo:hi] + 1
            chars = data[np.minimum(_ragged(start[lo:hi], lens), len(data) - 1)]
            behind = np.cumsum(lens) - 1
            chars[behind] = 1
            if chars.all():
                chars[behind] = 0
                held = chars[:-1].tobytes().decode("utf-8", "replace").replace(MARK, _LITERAL_MARK).replace(" ", MARK)
                out += held.split("\0")
            else:  # a text has zero bytes of its own
                for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist()):
                    held = data[a:b].tobytes().decode("utf-8", "replace")
                    out.append(held.replace(MARK, _LITERAL_MARK).replace(" ", MARK))
        lo = hi
    return out


def encode(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the first of each (one entry more than texts)."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in slices(texts, ENCODE_BYTES):
        own, first = _encode_slice(model, data, offsets)
        ids.append(own)
        counts.append(np.diff(first))
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


def _encode_slice(model: PieceModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _marked(data, offsets)
    space = data == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    hashes = [np.zeros(0, np.uint64)]
    lo = 0
    while lo < len(start):  # in slices, for the memory
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE_BYTES, "right")))
        base = start[lo]
        hashes.append(span_hashes(data[base : end[hi - 1]], start[lo:hi] - base, end[lo:hi] - base, EXACT))
        lo = hi
    _, example, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    ids = model.encode_cached(_marked_words(data, start[example], end[example]))
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    flat = np.frombuffer(b"".join(ids), np.int32)
    at = which
    total = np.concatenate([[0], np.cumsum(counts[at])])
    words_before = np.searchsorted(start, offsets)
    return flat[_ragged(first[at], counts[at])], total[words_before].astype(np.int64)


def decode(model: PieceModel, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and their offsets; the leading mark of each is taken off."""
    table, starts = model.tables()
    lens = (starts[1:] - starts[:-1])[ids]
    out = table[_ragged(starts[ids], lens)]
    ends = np.concatenate([[0], np.cumsum(lens)])
    offsets = ends[first]
    some = offsets[1:] > offsets[:-1]
    keep = np.ones(len(out), bool)
    lead = offsets[:-1][some]
    keep[lead[out[lead] == 32]] = False
    removed = np.concatenate([[0], np.cumsum(~keep)])
    return out[keep], offsets - removed[offsets]


def with_pieces(docs: DataFrame, text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """The documents with ``token_ids array<int>`` and ``n_tokens int``."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_file))

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids, first = encode(shared.value, texts)
        counts = pa.array(np.diff(first).astype(np.int32), mask=np.asarray(texts.is_null()))
        return [_id_lists(ids, first, texts), counts]

    return with_arrow_columns(docs, text_col, "token_ids array<int>, n_tokens int", compute, forget=lambda: shared.value.forget())


def with_round_trip(docs: DataFrame, text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """The documents with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to the very bytes of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_file))

    def compute(texts: pa.Array) -> list[pa.Array]:
        model, same, ids, counts = shared.value, [np.zeros(0, bool)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in slices(texts, ENCODE_BYTES):
            own, first = _encode_slice(model, data, offsets)
            back, ends = decode(model, own, first)
            if len(back) == len(data) and (ends == offsets).all():
                wrong = np.concatenate([[0], np.cumsum(back != data)])
                same.append(wrong[offsets[1:]] == wrong[offsets[:-1]])
            else:
                same.append(np.array([
                    np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])
                ]))
            ids.append(own)
            counts.append(np.diff(first))
        flat, first = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        null = np.asarray(texts.is_null())
        return [
            _id_lists(flat, first, texts), pa.array(np.diff(first).astype(np.int32), mask=null), pa.array(np.concatenate(same)),
        ]

    return with_arrow_columns(
        docs, text_col, "token_ids array<int>, n_tokens int, round_trip boolean", compute, forget=lambda: shared.value.forget()
    )


def _id_lists(ids: np.ndarray, first: np.ndarray, texts: pa.Array) -> pa.Array:
    null = np.append(np.asarray(texts.is_null()), False)
    offsets = pa.array(first.astype(np.int32), mask=null) if null.any() else pa.array(first.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids))


def with_decoded(docs: DataFrame, ids_col: str = "token_ids", name: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """The documents with the text of their ids; null ids give a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_file))

    def compute(lists: pa.Array) -> list[pa.Array]:
        null = np.asarray(lists.is_null())
        counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        data, offsets = decode(shared.value, np.asarray(lists.flatten()), first)
        text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        return [pa.array(text.to_pylist(), pa.string(), mask=null) if null.any() else text.cast(pa.string())]

    return with_arrow_columns(docs, ids_col, f"{name} string", compute, cast=None)
