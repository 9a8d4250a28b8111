"""Product codes against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortlens.llm import vector_codes
from cohortlens.llm.vector_codes import _Travel, whole_numbers, with_codes, with_group_error

DDL = "vec_id bigint, embedding array<double>, label int, code int, kept_0 string, vector string, sums int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "k", "v", 2) for i, v, label in rows], DDL)


def brute(rows, parts, entries, rounds, scale=4096):
    usable = [(i, [math.floor(x * scale) for x in v]) for i, v, _ in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((r for r in usable if r[0] is not None and r[1] and len(r[1]) % parts == 0))
    size = len(named[0][1])
    named = [r for r in named if len(r[1]) == size]
    w = size // parts
    books = [[r[1][p * w : (p + 1) * w] for r in named[:entries]] for p in range(parts)]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    full = [(i, v) for i, v in usable if len(v) == size]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v in full]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v), c in zip(full, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    codes = assign()
    out = [(i, "".join(f"{x:02x}" for x in c), sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)))
           for (i, v), c in zip(full, codes)]
    out += [(i, None, None) for i, v in usable if len(v) != size]
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(out, key=str), hashlib.sha256(flat.encode()).hexdigest()


def some_rows(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 2) for _ in range(width)] for _ in range(9)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centers)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n, width, parts, entries, rounds", [(300, 16, 8, 16, 6), (200, 12, 3, 5, 9), (40, 4, 4, 2, 3), (9, 8, 8, 16, 6)])
def test_codes_are_those_of_plain_k_means(spark, n, width, parts, entries, rounds):
    rows = some_rows(n, width, n)
    coded, books = with_codes(frame(spark, rows).repartition(5), parts=parts, entries=entries, rounds=rounds)
    want, digest = brute(rows, parts, entries, rounds)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == want
    assert books.digest() == digest
    assert set(coded.columns) == {"vec_id", "embedding", "label", "code", "kept_0", "vector", "sums", "error"}


def test_awkward_rows(spark):
    rows = some_rows(60, 8, 5) + [
        (3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (3, [0.25] * 8, 2), (None, [0.1] * 8, None), (None, [0.1] * 8, None),
        (-1, None, 1), (-2, [1.0, None] + [0.0] * 6, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, 1),
        (-5, [], 1), (-6, [1.0, 2.0], 2), (-7, [1.0] * 16 + [2.0], 2), (70, [-1e-9] * 8, 3), (71, [1e9] * 8, 3), (72, [-1e9] * 8, 3),
    ]
    coded, books = with_codes(frame(spark, rows))
    want, digest = brute(rows, 8, 16, 6)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == want
    assert books.digest() == digest
    errors = {}
    for r in coded.collect():
        errors[r["label"]] = errors.get(r["label"], 0) + (r["error"] or 0)
    for held in (100, 0):
        vector_codes.LABELS_HELD, before = held, vector_codes.LABELS_HELD
        summed = with_group_error(coded).collect()
        vector_codes.LABELS_HELD = before
        assert len(summed) == len(want) and all(r["label_error"] == errors[r["label"]] for r in summed)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i // 2)] * 4, 0) for i in range(6)] + [(9, [0.5] * 4, 0)]
    coded, books = with_codes(frame(spark, rows), parts=2, entries=6, rounds=4, scale=2)
    want, digest = brute(rows, 2, 6, 4, 2)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == want
    assert books.digest() == digest


def test_bounds_spare_most_scans(spark):
    rows = some_rows(2000, 8, 11, spread=0.05)
    trace = []
    with_codes(frame(spark, rows), parts=2, entries=8, trace=trace)
    assert trace[0] == 4000 and trace[-1] < 400


def test_net_displacement_is_never_longer_than_the_moves_added_up():
    rng = np.random.default_rng(2)
    history = [rng.integers(-50, 50, (2, 4, 3)) for _ in range(6)]
    travel = _Travel(history)
    for past in range(6):
        steps = sum((np.sqrt(((b - a) ** 2).sum(-1)) for a, b in zip(history[past:], history[past + 1 :])), np.zeros((2, 4)))
        assert (travel.own[past] <= steps * (1 + 1e-9) + 1e-9).all()
    assert travel.own[-1].max() == 0


def test_empty_and_unusable(spark):
    none = frame(spark, [(1, None, 1)])
    coded, books = with_codes(none)
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    assert with_group_error(coded).count() == 0
    coded, _ = with_codes(frame(spark, [(None, [1.0] * 8, 1)]))
    assert [tuple(r) for r in coded.select("code", "error").collect()] == [(None, None)]
    with pytest.raises(Exception, match="too large"):
        frame(spark, [(1, [1e300] * 8, 1)]).select(whole_numbers(vector_codes.F.col("embedding"))).collect()
    with pytest.raises(ValueError):
        with_codes(none, entries=300)
