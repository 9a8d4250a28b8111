import itertools
import random
import re

import numpy as np
import pytest

from cohortlens.llm.components import connected_components
from cohortlens.llm.ngram_jaccard import ngram_classes, one_of_each, subset_sizes


def grams(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, grams(t, size)) for d, t in rows if d is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted(((d, len(grams(t, size)), root(d) if d is not None else None) for d, t in rows), key=str)


def mine(frame, size, percent, **options):
    out = ngram_classes(frame, shingle=size, percent=percent, **options).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (2, 60)])
def test_against_brute_force(docs_of, size, percent):
    random.seed(size * percent)
    rows, number = [], 0
    for length in [1, 2, 3, 4, 6, 8, 11, 12, 14, 20, 23, 30, 45, 70, 120]:
        base = [f"w{random.randint(0, 60)}" for _ in range(length)]
        for _ in range(9):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                kind, at = random.choice("dis"), random.randrange(len(text) + 1)
                if kind == "i":
                    text.insert(at, f"n{random.randint(0, 9)}")
                elif at < len(text):
                    text[at : at + 1] = [] if kind == "d" else [f"s{random.randint(0, 9)}"]
            number += 1
            rows.append((number, " ".join(text)))
    random.shuffle(rows)
    assert mine(docs_of(rows), size, percent) == brute(rows, size, percent)
    # another order of n-grams and another boundary, the same links
    assert mine(docs_of(rows), size, percent, sample_docs=1) == brute(rows, size, percent)


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert mine(awkward, 3, 90) == brute(rows, 3, 90)
    assert ngram_classes(nothing).count() == 0


def test_one_of_each_keeps_rows_and_columns(awkward, nothing):
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["1", "2", "3", "4", "5", "5", "7", "8", "9", "9", "None", "None", "10", "11"]
    )
    assert one_of_each(nothing).count() == 0


def test_subset_sizes_follow_from_the_threshold():
    assert subset_sizes(5, 90) == [5]
    assert subset_sizes(10, 90) == [9, 10]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    np.random.default_rng(1).shuffle(edges)
    found = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
