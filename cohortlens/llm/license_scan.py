"""Licence recognition by sentence rules.

A text is cut in sentences: runs of words (letters and digits; case and punctuation don't count, "licence" counts as
"license") up to a full stop, exclamation or question mark, colon or semicolon that white space follows. A line end closes a
sentence too, but a sentence may also run on over single line ends, as in wrapped text; both readings are looked up. Sentences
whose hash is that of a known licence sentence get its identifier, and the sequence of identifiers of a document is matched
against ordered rules, rules of more sentences first. Consecutive sentences of a rule may be at most ``max_gap`` words apart
(a name, a year, a list number); a sentence serves one match only.

The rule set is a parameter: a small table that goes to the tasks as it is. Nothing is shuffled.

Defined results: null and empty texts have no match; a rule that occurs several times matches several times; rows that share
an id are scanned one by one. Where a sentence of its own is part of a longer known one read over a line end, the longer counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.license_rules import RULES, SENTENCES
from cohortlens.llm.shared import own_columns, ship_package
from cohortlens.llm.tokens import PUNCTUATION, Words, mix, powers, slices

MAX_GAP = 60
MATCH = "doc_id bigint, license string, rule string, first_word int, n_words int, n_sentences int, passage string"


class RuleSet:
    """Known sentences by hash and rules by the identifiers of their sentences."""

    def __init__(self, sentences: Mapping[str, str], rules: Mapping[str, tuple[str, Sequence[str]]], max_gap: int):
        self.max_gap = max_gap
        self.spelling = [Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), PUNCTUATION).hashes()[0] for w in (b"licence", b"license")]
        self.names = list(sentences)
        # known sentences are cut like texts; one with a colon or semicolon inside is several in a row
        self.parts: dict[str, list[int]] = {}
        ids: dict[int, int] = {}
        for name, text in sentences.items():
            found = [h for _, _, h in self.sentences(text.encode(), wrapped=True)]
            self.parts[name] = [ids.setdefault(int(h), len(ids)) for h in found]
        order = np.argsort(np.array(list(ids), np.uint64))
        self.hashes = np.array(list(ids), np.uint64)[order]
        self.numbers = np.array(list(ids.values()), np.int64)[order]
        self.rules = sorted(
            (
                (name, license_id, numbers) for name, (license_id, parts) in rules.items()
                if (numbers := [p for s in parts for p in self.parts[s]])
            ),
            key=lambda rule: -len(rule[2]),
        )

    def word_hashes(self, words: Words) -> np.ndarray:
        h = words.hashes()
        h[h == self.spelling[0]] = self.spelling[1]
        return h

    def spans(self, data: np.ndarray, words: Words, wrapped: bool) -> tuple[np.ndarray, np.ndarray]:
        """First word and the word behind the last of every sentence."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        white = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        follows = np.append(white[1:], True)
        stop = np.isin(data, np.frombuffer(b".!?;:", np.uint8)) & follows
        line = data == 10
        if wrapped:
            # only an empty line closes
            bare = np.flatnonzero(data != 13)
            twice = np.zeros(len(data), bool)
            if len(bare) > 1:
                twice[bare[1:]] = line[bare[1:]] & line[bare[:-1]]
            line = twice
        marks = np.concatenate([[0], np.cumsum(stop | line)])
        closes = np.ones(n, bool)
        closes[:-1] = (marks[words.start[1:]] > marks[words.end[:-1]]) | (words.row[1:] != words.row[:-1])
        ends = np.flatnonzero(closes) + 1
        return np.concatenate([[0], ends[:-1]]), ends

    def _sentence_hashes(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = powers(len(h) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def sentences(self, text: bytes, wrapped: bool) -> list[tuple[int, int, np.uint64]]:
        data = np.frombuffer(text, np.uint8)
        words = Words(data, np.array([0, len(data)]), PUNCTUATION)
        start, end = self.spans(data, words, wrapped)
        return list(zip(start, end, self._sentence_hashes(self.word_hashes(words), start, end)))

    def known(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[tuple[int, int, int, int]]]:
        """Known sentences in order: row, first word, the word behind the last, number."""
        words = Words(data, offsets, PUNCTUATION)
        if not len(self.hashes):
            return words, []
        h = self.word_hashes(words)
        found = set()
        for wrapped in (False, True):
            start, end = self.spans(data, words, wrapped)
            own = self._sentence_hashes(h, start, end)
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == own)
            found.update(zip(words.row[start[hit]].tolist(), start[hit].tolist(), end[hit].tolist(), self.numbers[at[hit]].tolist()))
        # of sentences that overlap the longer counts
        out: list[tuple[int, int, int, int]] = []
        for item in sorted(found, key=lambda f: (f[1], -f[2])):
            if not out or item[1] >= out[-1][2]:
                out.append(item)
        return words, out

    def matches(self, hits: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, int]]:
        """Rule matches in the known sentences of one text: licence, rule, first word, word behind the last, sentences."""
        free = [True] * len(hits)
        where: dict[int, list[int]] = {}
        for i, (_, _, number) in enumerate(hits):
            where.setdefault(number, []).append(i)
        out = []
        for name, license_id, parts in self.rules:
            if any(p not in where for p in parts):
                continue
            for first in where[parts[0]]:
                if not free[first]:
                    continue
                chain = [first]
                for part in parts[1:]:
                    i = chain[-1] + 1
                    while i < len(hits) and hits[i][0] - hits[chain[-1]][1] <= self.max_gap and not (free[i] and hits[i][2] == part):
                        i += 1
                    if i >= len(hits) or hits[i][0] - hits[chain[-1]][1] > self.max_gap:
                        break
                    chain.append(i)
                if len(chain) == len(parts):
                    for i in chain:
                        free[i] = False
                    out.append((license_id, name, hits[first][0], hits[chain[-1]][1], len(chain)))
        return sorted(out, key=lambda m: (m[2], m[1]))


def license_matches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: Mapping[str, str] = SENTENCES,
    rules: Mapping[str, tuple[str, Sequence[str]]] = RULES, max_gap: int = MAX_GAP,
) -> DataFrame:
    """``doc_id, license, rule, first_word, n_words, n_sentences, passage``: a row per match; ``first_word`` counts from 0."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(RuleSet(sentences, rules, max_gap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_set = shared.value
        for batch in batches:
            rows = []
            for lo, _, data, offsets in slices(batch.column(1)):
                words, hits = rule_set.known(data, offsets)
                by_row: dict[int, list[tuple[int, int, int]]] = {}
                for row, start, end, number in hits:
                    by_row.setdefault(row, []).append((start, end, number))
                for row, own in by_row.items():
                    for license_id, name, start, end, n in rule_set.matches(own):
                        passage = data[words.start[start] : words.end[end - 1]].tobytes().decode("utf-8", "replace")
                        rows.append((lo + row, license_id, name, start - int(words.first[row]), end - start, n, passage))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]],
                ["doc_id", "license", "rule", "first_word", "n_words", "n_sentences", "passage"],
            )

    return own_columns(docs, id_col, text_col).mapInArrow(run, MATCH)
