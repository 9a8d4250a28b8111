import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cohortlens.llm import decontaminate
from cohortlens.llm.decontaminate import ItemIndex, benchmark_matches, drop_contaminated
from cohortlens.llm.tokens import slices

BENCH = "item_id bigint, text string, doc_id string"


def weighted(words, size=5):
    size = min(size, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, items, least=0.8):
    """All pairs with some item-sized window at the threshold, and the best similarity."""
    out = {}
    for d, text in rows:
        words = (text or "").lower().split()
        for i, item in items:
            wanted = (item or "").lower().split()
            if not wanted:
                continue
            x = weighted(wanted)
            for p in range(len(words) - len(wanted) + 1):
                y = weighted(words[p : p + len(wanted)])
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def passages(seed, count, words=40):
    random.seed(seed)
    return [(i, " ".join(f"b{random.randint(0, 400)}" for _ in range(random.randint(words // 2, words * 2)))) for i in range(count)]


def test_against_brute_force(spark, docs_of):
    items = passages(1, 25) + [(100, "Short exact words"), (101, ""), (102, None)]
    rows = []
    for d in range(120):
        words = [f"c{random.randint(0, 500)}" for _ in range(random.randint(0, 120))]
        if d % 3:
            leak = random.choice(items[:25])[1].upper().split()
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                leak[random.choice([0, -1, random.randrange(len(leak))])] = "changed"
            at = random.randint(0, len(words))
            words[at:at] = leak[: len(leak) - random.choice([0, 0, 1, 3])]
        rows.append((d, " ".join(words)))
    rows += [(500, "here are short  EXACT\nwords again"), (501, None), (502, "")]
    expected = brute(rows, items)
    found = benchmark_matches(docs_of(rows), spark.createDataFrame([(*i, "z") for i in items], BENCH)).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert len(found) == len(got)
    # nothing wrong, and at the radius nothing missed in this sample
    assert got.keys() == expected.keys() and len(got) > 40
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_a_benchmark_in_several_parts_gives_the_same(spark, docs_of):
    items = passages(2, 12)
    rows = [(d, f"x y {items[d % 12][1]} z") for d in range(30)]
    bench = spark.createDataFrame([(*i, "z") for i in items], BENCH)
    whole = {tuple(r) for r in benchmark_matches(docs_of(rows), bench).collect()}
    parts = {tuple(r) for r in benchmark_matches(docs_of(rows), bench, index_words=150).collect()}
    assert whole == parts and len({(r[0], r[1]) for r in whole}) == 30


def test_multi_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    index = ItemIndex(list(range(300)), [" ".join(f"w{k}" for k in rng.integers(0, 9000, 30)) for _ in range(300)], 5, 20, 8)
    flips = rng.integers(0, 26, 300)
    probes = index.prints.copy()
    for i, k in enumerate(flips):
        for bit in rng.choice(64, k, replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(bit)
    window, item, distance = index.near(probes, np.zeros(300, np.int64))
    every = {(i, j) for i in range(300) for j in range(300) if int(probes[i] ^ index.prints[j]).bit_count() <= 20}
    assert set(zip(window.tolist(), item.tolist())) == every and distance.max() <= 20


def test_filter_keeps_clean_rows_and_columns(spark, docs_of, awkward, nothing):
    items = passages(3, 5)
    bench = spark.createDataFrame([(*i, "z") for i in items], BENCH)
    rows = [(1, "clean text"), (2, f"a {items[0][1]} b"), (3, None), (None, "no id"), (None, items[1][1])]
    kept = drop_contaminated(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "clean text"), ("3", None), ("None", "no id")]
    assert drop_contaminated(awkward, bench).count() == awkward.count()
    assert drop_contaminated(nothing, bench).count() == 0
    assert benchmark_matches(awkward, bench.where("item_id < 0")).count() == 0


def test_documents_without_an_id_are_kept_apart(spark, docs_of):
    item = passages(3, 1)[0][1]
    other = item.split()
    other[0] = "changed"
    docs = docs_of([(None, f"a b {item}"), (None, f"{' '.join(other)} c d"), (None, "nothing"), (7, item), (7, item)])
    rows = benchmark_matches(docs, spark.createDataFrame([(1, item, "z"), (None, item, "z")], BENCH)).collect()
    assert sorted((r["doc_id"] is None, r["start_word"], r["similarity"] == 1.0) for r in rows) == [
        (False, 0, True), (True, 0, False), (True, 2, True)
    ]


def test_one_item_id_with_two_texts(spark, docs_of):
    first, second = (t for _, t in passages(8, 2))
    rows = benchmark_matches(docs_of([(1, second), (2, first + " x")]), spark.createDataFrame(
        [(5, first, "z"), (5, second, "z")], BENCH)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in rows) == [(1, 5, 1.0), (2, 5, 1.0)]


def test_places_are_the_windows_with_enough_hits():
    rng = np.random.default_rng(1)
    for m in (1, 3, 7, 30):
        for share in (0.05, 0.3, 0.9):
            hit = rng.random(300) < share
            run = np.concatenate([[0], np.cumsum(hit)])
            want = [p for p in range(300 - m + 1) if run[p + m] - run[p] >= 0.8 * m and run[p + m] > run[p]]
            got = ItemIndex._places(np.flatnonzero(hit), m, 0.8)
            assert [p for p in got.tolist() if p + m <= 300] == want
            assert len(got) == len(set(got.tolist()))


def test_fingerprints_do_not_depend_on_how_many_are_made_at_once(monkeypatch):
    import cohortlens.llm.decontaminate as module

    items = passages(6, 30)
    ids, texts = [i for i, _ in items], [t for _, t in items]
    whole = ItemIndex(ids, texts, 5, 20, 8).prints
    monkeypatch.setattr(module, "BITS_AT_ONCE", 25)
    assert (ItemIndex(ids, texts, 5, 20, 8).prints == whole).all()


def test_recall_at_the_threshold(spark, docs_of):
    """Windows between 0.8 and 0.85 alike: nearly all within the default radius, every one with a radius of 64."""
    random.seed(9)
    items = passages(9, 40, 60)
    rows = []
    for d in range(200):
        words = items[d % 40][1].split()
        # one change spoils up to five shingles
        for _ in range(max(1, len(words) // 45)):
            words[random.randrange(len(words))] = f"n{d}"
        rows.append((d, " ".join(words)))
    expected = {k for k, sim in brute(rows, items).items() if sim < 0.87}
    bench = spark.createDataFrame([(*i, "z") for i in items], BENCH)
    assert len(expected) > 20
    for radius, least in ((20, 0.95), (64, 1.0)):
        blocks = 8 if radius < 64 else 16
        got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(docs_of(rows), bench, radius=radius, blocks=blocks).collect()}
        assert len(expected & got) >= least * len(expected)


def test_windows_of_all_sizes_are_looked_up_together(monkeypatch):
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{i}" for i in rng.integers(0, 4000, n)) for n in range(12, 40)]
    index = decontaminate.ItemIndex(list(range(len(items))), items, 5, 20, 8)
    texts = pa.array([f"before {item} after" for item in items] + ["nothing of it"])
    calls, near = [], index.near
    monkeypatch.setattr(index, "near", lambda *args: calls.append(1) or near(*args))
    found = lambda: [m for lo, _, data, offsets in slices(texts) for m in index.matches(data, offsets, 0.8)]
    together = found()
    assert len(calls) == 1 and [m[1] for m in together] == list(range(len(items)))
    # the bound on windows held at once changes nothing
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 1)
    assert found() == together and len(calls) > len(items)
