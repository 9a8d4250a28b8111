import random

import numpy as np
import pyarrow as pa

from cohortlens.llm import toxicity
from cohortlens.llm.toxicity import PENALTY, calibrated_cut, fit_ordinal, fit_severity, keep_clean, with_severity, word_features

LABELS = "doc_id bigint, quality int, toxic int, text string"
BAD = ["vile", "nasty", "awful", "rotten"]


def corpus(seed, count):
    random.seed(seed)
    rows, labels = [], []
    for d in range(count):
        words = [f"w{random.randint(0, 300)}" for _ in range(random.randint(1, 60))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(random.randint(1, 6)):
                words.insert(random.randrange(len(words) + 1), random.choice(BAD) + random.choice(["", ",", "ness", "!"]))
        rows.append((d, " ".join(words)))
        labels.append((d, None, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(1, 1500)
    docs = docs_of(rows)
    model = fit_severity(docs.select("doc_id", "text"), spark.createDataFrame(labels[:700], LABELS))
    out = {r["doc_id"]: r for r in with_severity(docs, model).collect()}
    held = range(700, 1500)
    assert np.mean([out[d]["rejected"] == (d % 5 == 0) for d in held]) > 0.98
    toxic = [out[d]["expected_severity"] for d in held if d % 5 == 0]
    clean = [out[d]["expected_severity"] for d in held if d % 5]
    assert min(toxic) > np.median(clean) and np.mean(toxic) > 10 * np.mean(clean)
    # the expected severity follows the number of telling words
    hits = [sum(w.startswith(tuple(BAD)) for w in rows[d][1].split()) for d in held if d % 5 == 0]
    assert np.corrcoef(hits, toxic)[0, 1] > 0.6


def test_expected_severity_is_the_sum_of_exceedances(spark, docs_of):
    rows, labels = corpus(2, 300)
    docs = docs_of(rows)
    model = fit_severity(docs.select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    assert (np.diff(model.thresholds) >= 0).all()
    p, _ = model.at_least(pa.array([t for _, t in rows]))
    assert (np.diff(p, axis=1) <= 1e-12).all()
    got = {r["doc_id"]: r["expected_severity"] for r in with_severity(docs, model).collect()}
    assert np.allclose([got[d] for d, _ in rows], p.sum(axis=1))


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(3)
    texts, grade = [], []
    for _ in range(2000):
        k = rng.integers(0, 4)
        texts.append(" ".join([f"w{i}" for i in rng.integers(0, 200, 20)] + ["mark%d" % i for i in range(3) if i < k]))
        grade.append(k)
    feature, first = word_features(pa.array(texts))
    model = fit_ordinal(feature, first, np.array(grade))
    p, _ = model.at_least(pa.array(texts))
    assert np.corrcoef(p.sum(axis=1), grade)[0, 1] > 0.97


def test_cut_falls_between_scores():
    assert 0.2 < calibrated_cut(np.array([0.9, 0.1, 0.3, 0.2]), np.array([1, 0, 1, 0], bool)) < 0.3


def test_long_texts_and_rare_labels(spark, docs_of):
    rows, labels = corpus(4, 600)
    long_clean = " ".join(f"w{random.randint(0, 300)}" for _ in range(50_000))
    docs = docs_of(rows + [(9000, long_clean), (9001, long_clean + " vile nasty")])
    model = fit_severity(docs.select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    out = {r["doc_id"]: r["rejected"] for r in with_severity(docs, model).collect()}
    assert not out[9000] and out[9001]


def test_awkward_rows(spark, docs_of, awkward, nothing):
    rows, labels = corpus(5, 200)
    label_frame = spark.createDataFrame(labels + [(None, 1, 1, ""), (3, 1, None, ""), (0, 1, 1, ""), (99_999, 0, 1, "")], LABELS)
    mixed = docs_of([(d + 1000, t) for d, t in rows]).unionByName(awkward)
    shifted = label_frame.withColumn("doc_id", label_frame.doc_id + 1000)
    kept = keep_clean(mixed, shifted)
    assert kept.columns == mixed.columns
    assert kept.where("doc_id < 1000 or doc_id is null").count() == awkward.count()
    assert keep_clean(nothing, label_frame).count() == 0
    # nothing to learn from: nothing goes
    for none in (label_frame.where("doc_id < 0"), shifted.where("toxic = 1"), shifted.where("toxic = 0")):
        assert keep_clean(mixed, none).count() == mixed.count()


def test_labels_of_absent_documents_take_no_place(spark, docs_of):
    rows, labels = corpus(6, 100)
    absent = [(100_000 + i, None, i % 2, "x") for i in range(10_000)]
    model = fit_severity(docs_of(rows).select("doc_id", "text"), spark.createDataFrame(labels + absent, LABELS), max_rows=200)
    assert model.weights.any()


def test_ordinal_fit_against_a_dense_one():
    """Two thresholds and few words: the penalized likelihood is as high as any that random steps from the solution reach."""
    rng = np.random.default_rng(8)
    texts, grade = [], []
    for _ in range(800):
        k = int(rng.integers(0, 3))
        texts.append(" ".join(["alpha"] * (rng.random() < 0.2 + 0.35 * k) + ["beta"] * (rng.random() < 0.1 + 0.2 * k) + ["gamma"]))
        grade.append(k)
    grade = np.array(grade)
    feature, first = word_features(pa.array(texts))
    model = fit_ordinal(feature, first, grade)
    row = np.repeat(np.arange(len(grade)), np.diff(first))

    def criterion(weights, thresholds):
        score = np.bincount(row, weights[feature], len(grade))
        tails = [np.ones(len(grade)), *(1 / (1 + np.exp(t - score)) for t in thresholds), np.zeros(len(grade))]
        p = np.array([tails[g][i] - tails[g + 1][i] for i, g in enumerate(grade)])
        return np.log(np.maximum(p, 1e-12)).mean() - PENALTY * weights.sum()

    best = criterion(model.weights.astype(float), model.thresholds)
    used = np.flatnonzero(model.weights)
    assert len(used)
    for _ in range(200):
        weights, thresholds = model.weights.astype(float), model.thresholds + rng.normal(0, 0.1, len(model.thresholds))
        weights[used] = np.maximum(weights[used] + rng.normal(0, 0.1, len(used)), 0)
        assert criterion(weights, np.sort(thresholds)) < best + 2e-3


def test_driver_gives_back_what_the_fit_took(spark, docs_of, monkeypatch):
    calls, give_back = [], toxicity.release_memory
    monkeypatch.setattr(toxicity, "release_memory", lambda: calls.append(1) or give_back())
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    toxicity.fit_severity(docs_of([(1, "bad words"), (2, "good words")]).select("doc_id", "text"), labels)
    assert calls
