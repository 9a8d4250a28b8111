"""Importance resampling against a word-by-word version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm.importance import BETWEEN, _pieces, bucket_counts, features, fit_gains, resample, with_weights

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    data = (text or "").encode()
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in data))


def grams(text, longest=3):
    found = words(text)
    return [b" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def counts(texts, buckets=10_000):
    out = [0] * buckets
    for text in texts:
        for gram in grams(text):
            out[zlib.crc32(gram) % buckets] += 1
    return out


def brute(docs, target, percent=5, seed=42, least=20):
    s, t = counts(x for _, x in docs), counts(target)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)
    ]
    rows = []
    for doc, text in docs:
        weight = sum(gain[zlib.crc32(g) % 10_000] for g in grams(text))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(words(text)), len(grams(text)), weight, score, None])
    drawn = [r for r in rows if r[1] >= least]
    drawn.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


def test_features_are_the_crcs_of_all_runs():
    texts = ["a", "", "Hello, World! foo-bar", None, "é中 x\x00y Z z ÀZ", "The quick brown fox " * 30 + "x" * 700 + " tail"]
    n, found = features(pa.array(texts), 3, 10_000)
    assert n.tolist() == [len(words(t)) for t in texts]
    for size, (places, row) in enumerate(found, 1):
        for i, text in enumerate(texts):
            w = words(text)
            assert places[row == i].tolist() == [zlib.crc32(b" ".join(w[j : j + size])) % 10_000 for j in range(len(w) - size + 1)]


def test_pieces_of_a_column_cover_it(monkeypatch):
    monkeypatch.setattr("cohortlens.llm.importance.SLICE_BYTES", 50)
    texts = pa.array([f"text number {i} with Some words" * (i % 4) if i % 5 else None for i in range(100)])
    total = sum(
        np.bincount(places, minlength=97) for piece in _pieces(texts) for places, _ in features(piece, 3, 97)[1]
    )
    whole = sum(np.bincount(places, minlength=97) for places, _ in features(texts, 3, 97)[1])
    assert total.tolist() == whole.tolist() and sum(len(p) for p in _pieces(texts)) == 100
    assert BETWEEN.startswith("[")


def test_draw_equals_brute_force_on_awkward_rows(spark, awkward, docs_of):
    more = docs_of([(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(15 + i % 20))) for i in range(300)])
    docs = awkward.unionByName(more).repartition(5)
    target = spark.createDataFrame([(1, "w1 w2 w3 w4 the same text of words"), (2, None), (3, "")], "item_id int, text string")
    got = resample(docs, target)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows == brute(given, [r["text"] for r in target.collect()])
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_one_id_holds_most_rows(docs_of, spark):
    docs = docs_of([(None, "a b c d e f g h i j k l m n o p q r s t u")] * 400 + [(1, "a b")])
    target = spark.createDataFrame([("a b c",)], "text string")
    ranks = [r["rank"] for r in resample(docs, target).where("rank is not null").collect()]
    assert sorted(ranks) == list(range(1, 21))


def test_empty_tables(nothing, docs_of, spark):
    some = docs_of([(1, "a b c")])
    assert resample(nothing, some).count() == 0
    gains = fit_gains(some, nothing)
    assert with_weights(some, gains).first()["weight"] == sum(gains.values[zlib.crc32(g) % 10_000] for g in grams("a b c"))
    assert bucket_counts(nothing).sum() == 0


@pytest.mark.parametrize("buckets", [7, 1 << 16])
def test_other_sizes(docs_of, buckets):
    some = docs_of([(1, "x y z"), (2, "x y")])
    assert bucket_counts(some, longest=2, buckets=buckets).sum() == 8
    assert bucket_counts(some.withColumn("text", F.upper("text")), longest=2, buckets=buckets).tolist() == bucket_counts(
        some, longest=2, buckets=buckets
    ).tolist()
