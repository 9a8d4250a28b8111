import collections
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import suffix_tree
from cohortlens.llm.suffix_tree import CLEANUP_KEY, END, _blocks, _distinct, _joined, _tokens, fit_suffix_tree, score_texts
from cohortlens.llm.tokens import buffers
from cohortlens.session import checkpoint_dir


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower) + [None]


def test_base_scores_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    train = [d for d in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(w for d in train for w in rows[d])
    tokens, kinds = sum(count.values()), len(count)
    # with a small dictionary most words take the way over the join
    for share in (5e-7, 1e-3):
        tree, counts = fit_suffix_tree(docs.where("crc32(cast(doc_id AS string)) % 7 != 2"), dictionary_share=min(share, 1e-4))
        assert (tree.tokens, tree.distinct) == (tokens, kinds)
        out = score_texts(docs, tree, counts).collect()
        assert len(out) == len(rows)
        for r in out:
            own = rows[r["doc_id"]]
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(count[w] > 0 for w in own)
            assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (tokens + kinds + 1)) for w in own))


def chain(seed, count):
    """Texts of a second-order source: every word but a few follows from the two before it."""
    random.seed(seed)
    rows = []
    for d in range(count):
        text = [random.choice("abcdef"), random.choice("abcdef")]
        for _ in range(random.randint(5, 60)):
            a, b = text[-2:]
            text.append("abcdef"[(3 * ord(a) + 5 * ord(b)) % 6] if random.random() < 0.8 else random.choice("abcdef"))
        rows.append((d, " ".join(text)))
    return rows


def test_held_out_texts_are_likelier_with_longer_contexts(docs_of):
    rows = chain(1, 500)
    docs = docs_of(rows)
    totals = []
    for depth in (0, 1, 2):
        tree, counts = fit_suffix_tree(docs.where("doc_id < 400"), depth=depth)
        out = score_texts(docs.where("doc_id >= 400"), tree, counts).collect()
        totals.append(sum(r["score"] for r in out))
        if not depth:
            assert totals[0] == pytest.approx(sum(r["base_score"] for r in out))
    # at depth 1 the source looks nearly random, at depth 2 it doesn't
    assert totals[2] > totals[1] + 500 and totals[1] >= totals[0] - 5


def test_next_symbol_distributions_sum_to_one(docs_of):
    rows = chain(2, 200)
    tree, _ = fit_suffix_tree(docs_of(rows))
    assert len(tree.contexts[0]) or len(tree.contexts[1])
    kinds = sorted({w for _, t in rows for w in t.split()})
    for context in ("", "a", "a b", "f c", "zzz a"):
        total = 0.0
        for w in [*kinds, None, "never seen"]:
            text = f"{context} {w or ''}".strip()
            tokens, first = _tokens(*buffers(__import__("pyarrow").array([text])))
            at = len(context.split())
            count, root, value = tree.score(tokens, first)
            p = value[at] if count[at] >= 0 else value[at] + tree.root_log(np.array([0]))[0]
            total += 10**p
        # all unseen words together have the share of one
        assert total == pytest.approx(1, abs=1e-9)


def test_states_need_their_divergence_and_their_parent(docs_of):
    docs = docs_of(chain(3, 200))
    few, _ = fit_suffix_tree(docs, min_gain=1e9)
    assert not any(map(len, few.contexts))
    tree, _ = fit_suffix_tree(docs)
    for d in range(1, len(tree.contexts)):
        parents = set(tree.contexts[d - 1].tolist())
        assert all(c % tree.base**d in parents for c in tree.contexts[d].tolist())


def test_awkward_rows(awkward, nothing):
    tree, counts = fit_suffix_tree(awkward.where("text is not null"))
    out = score_texts(awkward, tree, counts).collect()
    assert len(out) == awkward.count()
    assert sorted(r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    empty, no_counts = fit_suffix_tree(nothing)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in score_texts(awkward, empty, no_counts).collect())
    assert score_texts(nothing, tree, counts).count() == 0
    assert END in tree.dictionary


def brute_force(rows, held_out, min_gain=10.0, smoothing=20.0):
    """log10 of held-out texts by the definition, over contexts of any length."""
    texts = [[0, *words(t)] for t in rows]
    seen = collections.defaultdict(collections.Counter)
    unigrams = collections.Counter(w for t in texts for w in t[1:])
    for t in texts:
        for i in range(1, len(t)):
            for d in range(1, min(i, 12) + 1):
                seen[tuple(t[i - d : i])][t[i]] += 1
    bottom = sum(unigrams.values()) + len(unigrams) + 1
    states = {}

    def prob(s, w):
        if not s:
            return (unigrams[w] + 1) / bottom
        kept, whole, share = states[s]
        return (kept[w] / (whole + smoothing) if w in kept else 0) + (share * prob(s[1:], w))

    depth, deepest = 1, 0
    while depth == 1 or depth == deepest + 1:
        for s, following in seen.items():
            kept = {w: c for w, c in following.items() if c > 1}
            if len(s) == depth and kept and (depth == 1 or s[1:] in states):
                whole = following.total()
                share = (whole - sum(kept.values()) + smoothing) / (whole + smoothing)
                own = lambda w: kept[w] / (whole + smoothing) + share * prob(s[1:], w)  # noqa: B023, E731
                gain = sum(c * math.log(own(w) / prob(s[1:], w)) for w, c in kept.items())
                if gain + (whole - sum(kept.values())) * math.log(share) >= min_gain:
                    states[s], deepest = (kept, whole, share), depth
        depth += 1

    def score(text):
        t, total = [0, *words(text)], 0.0
        for i in range(1, len(t)):
            d = 0
            while d < i and tuple(t[i - d - 1 : i]) in states:
                d += 1
            total += math.log10(prob(tuple(t[i - d : i]), t[i]))
        return total

    return deepest, [score(t) for t in held_out], len(states)


def test_rare_words_and_long_contexts_against_brute_force(docs_of):
    random.seed(4)
    rows = []
    for _ in range(300):
        text = random.choices("abcdef", k=3)
        for _ in range(80):
            # what comes next depends on the last word, the last two or the last three
            last = text[-random.choice((1, 2, 3)) :]
            text.append("abcdef"[zlib.crc32(" ".join(last).encode()) % 6])
        rows.append(" ".join(text))
    # words far below 1e-4 of all tokens
    rows += ["rare pair of words"] * 2
    held = ["a rare pair of words", "a b c d e f a b c", "rare pair never of words", *rows[:20]]
    deepest, expected, n_states = brute_force(rows, held)
    assert deepest >= 3
    docs = docs_of(list(enumerate(rows)))
    for head in (1 << 20, 3):
        tree, counts = fit_suffix_tree(docs, head_keys=head)
        assert len(tree.states) == deepest and sum(s.count() for s in tree.states) == n_states
        out = score_texts(docs_of(list(enumerate(held))), tree, counts).collect()
        assert [r["score"] for r in sorted(out, key=lambda r: r["doc_id"])] == pytest.approx(expected)


def test_tables_that_were_needed_for_one_depth_go(docs_of, spark):
    held = lambda: [p for kind in ("contexts", "entries") for p in pathlib.Path(
        checkpoint_dir(spark).removeprefix("file:")).glob(f"tree-{kind}-*/*.parquet")]
    before, setting = set(held()), spark.conf.get(CLEANUP_KEY)
    for depth in (None, 1):
        tree, counts = fit_suffix_tree(docs_of(chain(5, 200)), depth=depth)
        assert tree.states and set(held()) <= before and spark.conf.get(CLEANUP_KEY) == setting
        assert score_texts(docs_of(chain(6, 5)), tree, counts).count() == 5


def test_counts_travel_in_blocks_of_bounded_size():
    """What a worker has counted is a row per part of the range of keys, not a row per context and token."""
    rng = np.random.default_rng(7)
    context, parent = (rng.integers(0, 50, 20_000).astype(np.uint64) for _ in range(2))
    _, first, at, key = _distinct(_joined(context, parent))
    c = np.diff(np.append(first, len(context)))
    blocks = _blocks(key, context[at], parent[at], c, 16)
    assert 1 < blocks.num_rows <= 16 and blocks.column(0).to_pylist() == sorted(set(blocks.column(0).to_pylist()))
    held = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in blocks.column(k)]) for k, kind in ((1, np.uint64), (2, np.uint64), (3, np.int32))]
    expected = collections.Counter(zip(context.tolist(), parent.tolist()))
    assert dict(zip(zip(held[0].tolist(), held[1].tolist()), held[2].tolist())) == expected


def test_lookups_travel_in_blocks():
    """A text's lookups are no rows of their own: few rows carry them all, each within a part of the range of keys."""
    rng = np.random.default_rng(8)
    model = np.unique(rng.integers(0, 2**64, 3_000, np.uint64))
    value = rng.normal(size=len(model))
    key = np.concatenate([rng.choice(model, 20_000), rng.integers(0, 2**64, 5_000, np.uint64)])
    row = rng.integers(0, 40, len(key))
    known = dict(zip(model.tolist(), value.tolist()))
    expected = collections.Counter()
    for k, r in zip(key.tolist(), row.tolist()):
        expected[1000 + r] += known.get(k, 0.0)
    part, steps, times, rows = suffix_tree._asked(key, row, 8)
    assert len(part) <= len(key) / suffix_tree.BLOCK + 8 and part.tolist() == sorted(part.tolist())
    assert sum(map(len, rows)) == 4 * len(key) and max(map(len, rows)) == 4 * suffix_tree.BLOCK
    blocks = suffix_tree._filled(
        {"row": "bigint"} | suffix_tree._BLOBS, len(part), {"row": np.full(len(part), 1000), "steps": steps, "times": times, "rows": rows}
    )
    n, found = suffix_tree._block_answers(blocks, model, value, None)
    assert n == 40 and dict(zip(found["row"].tolist(), found["longer"])) == pytest.approx(dict(expected))


def test_many_parts_and_small_blocks_give_the_same(docs_of, monkeypatch):
    docs = docs_of([*chain(9, 120), (None, "a b"), (7, None), (8, "never seen a b c")])
    tree, counts = fit_suffix_tree(docs, dictionary_share=1e-2, head_keys=0)
    scored = lambda: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in score_texts(docs, tree, counts).collect())
    before = scored()
    assert len(before) == 123
    for name, most in (("LOOKUP_PARTS", 3), ("PART_KEYS", 5), ("BLOCK", 2), ("LOOKUPS", 10)):
        monkeypatch.setattr(suffix_tree, name, most)
    for a, b in zip(before, scored()):
        assert a == pytest.approx(b)


def test_model_keys_are_stored_in_blocks(docs_of):
    """What the tree keeps is a few rows that hold many keys each, not a row per state and entry, and the counts of words are, too."""
    tree, counts = fit_suffix_tree(docs_of([*chain(10, 300), *((1000 + i, f"single{i} word{i}") for i in range(3000))]))
    rows, keys = tree.kept[0].count(), tree.kept[0].selectExpr("sum(n)").first()[0]
    assert keys == sum(s.count() for s in tree.states[:1]) + tree.kept[0].where(f"kind = {suffix_tree._ENTRY}").selectExpr("sum(n)").first()[0]
    assert rows <= 8 < keys and tree.held == sum(k.selectExpr("sum(n)").first()[0] for k in tree.kept)
    assert counts.selectExpr("sum(n)", "sum(total)").first() == (tree.distinct, tree.tokens) and counts.count() < tree.distinct / 10


def test_deep_contexts_are_counted_in_few_passes(docs_of, monkeypatch):
    """Several depths share a pass over the texts, and the states are the same as with a pass for each."""
    random.seed(11)
    rows = []
    for i in range(200):
        text = random.choices("abc", k=5)
        for _ in range(80):
            last = text[-random.choice((1, 2, 3, 4, 5)) :]
            text.append("abc"[zlib.crc32(" ".join(last).encode()) % 3])
        rows.append((i, " ".join(text)))
    passes, once = [], suffix_tree._context_counts
    monkeypatch.setattr(suffix_tree, "_context_counts", lambda texts, shared, depths, *rest: passes.append(depths) or once(texts, shared, depths, *rest))
    found = []
    for share in (0.0, 100.0):
        monkeypatch.setattr(suffix_tree, "DEPTHS_SHARE", share)
        passes.clear()
        tree, _ = fit_suffix_tree(docs_of(rows))
        found.append([sorted((r["ctx"], r["pctx"], r["whole"]) for r in s.collect()) for s in tree.states])
        assert [d for p in passes for d in p][: len(tree.states)] == list(range(1, len(tree.states) + 1))
        assert len(passes) == (3 if share else len(tree.states) + 1)
    assert found[0] == found[1] and 4 <= len(found[0]) <= 9


def test_keys_are_found_by_their_first_bits():
    rng = np.random.default_rng(12)
    for keys in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), np.arange(50, dtype=np.uint64), rng.integers(0, 2**64, 5_000, np.uint64)):
        keys = np.unique(keys)
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 1_000, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
        place = {int(k): i for i, k in enumerate(keys)}
        assert suffix_tree.Lookup(keys).find(wanted).tolist() == [place.get(int(w), -1) for w in wanted]
    # the last bits, in which the places are, count where the others agree
    key = np.repeat(np.array([7, 5, 6, 5], np.uint64), 3) + (np.uint64(1) << np.uint64(60))
    assert suffix_tree._order(key).tolist() == np.argsort(key, kind="stable").tolist()
