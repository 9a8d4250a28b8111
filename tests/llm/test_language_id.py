import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm.language_id import fit_languages, kneser_ney, reduced, with_languages
from cohortlens.llm.tokens import buffers


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where("crc32(cast(doc_id AS string)) % 5 != 0")
    model = fit_languages(learn)
    held = with_languages(docs.where("crc32(cast(doc_id AS string)) % 5 = 0"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["accepted"] for r in held]) > 0.75
    assert all(0 <= r["score"] <= 1 for r in held)
    # text of another kind is rejected
    foreign = spark.createDataFrame([(1, "zzkq xxwv qqjz vvkx zzqx jjkw " * 30)], "doc_id bigint, text string")
    assert not with_languages(foreign, model).first()["accepted"]


def test_probabilities_sum_to_one():
    points = np.array([[32, 32, ord(a)] for a in "abca"] + [[32, ord(a), ord(b)] for a, b in ("ab", "ba", "ca")]
                      + [[ord(a), ord(b), ord(c)] for a, b, c in ("abc", "aba", "bab")], np.uint32)
    kinds, counts = np.unique(points, axis=0, return_counts=True)
    model = kneser_ney(kinds, np.zeros(len(kinds), np.int64), counts, ["x"])
    for history in ([32, 32], [32, ord("a")], [ord("a"), ord("b")], [ord("z"), ord("z")]):
        grams = np.array([[*history, ord(c)] for c in "abcq"], np.uint32)
        assert np.exp(model.log_probabilities(grams)).sum() == pytest.approx(1)


def test_reduced_texts():
    codes, first = reduced(*buffers(pa.array(["  Ab,,c 1 D\n", "", None, "!!", "ÄÖ中😀x"])))
    texts = ["".join(map(chr, codes[a:b])) for a, b in zip(first, first[1:])]
    assert texts == ["ab c d ", "", "", "", "äö中 x"]


def test_awkward_rows(awkward, nothing, docs_of):
    train = docs_of([(i, "the cat and the dog " * 3, "en") for i in range(30)] + [(i + 50, "der hund und die katze " * 3, "de") for i in range(30)]
                    + [(100, "null lang", None), (101, None, "fr"), (None, "x", "it")])
    model = fit_languages(train)
    assert model.languages == ["de", "en"]
    out = with_languages(awkward, model)
    assert out.columns[: len(awkward.columns)] == awkward.columns and out.count() == awkward.count()
    blank = [r for r in out.collect() if r["doc_id"] in (1, 2, 3)]
    assert all((r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False) for r in blank)
    assert with_languages(nothing, model).count() == 0
    assert fit_languages(nothing) is None
    assert {r["lang_pred"] for r in with_languages(awkward, None).collect()} == {"und"}


def test_rows_that_share_an_id_keep_their_languages(docs_of):
    train = docs_of([(i, "the cat and the dog " * 3, "en") for i in range(30)] + [(i, "der hund und die katze " * 3, "de") for i in range(30)])
    model = fit_languages(train)
    out = with_languages(docs_of([(1, "the dog and the cat"), (2, "die katze und der hund")]), model, score_chars=10).collect()
    assert [r["lang_pred"] for r in sorted(out, key=lambda r: r["doc_id"])] == ["en", "de"]
    assert max(r["cross_entropy"] for r in out) < 1.5


def test_kneser_ney_by_its_definition():
    """Trigrams of two small languages: discounted counts, then numbers of different characters in front, order by order."""
    rng = np.random.default_rng(3)
    texts = {"x": "".join(rng.choice(list("aab "), 400)), "y": "".join(rng.choice(list("bcc "), 300))}
    points, langs = [], []
    for k, name in enumerate("xy"):
        text = "  " + texts[name]
        grams = [[ord(c) for c in text[i : i + 3]] for i in range(len(text) - 2)]
        points += grams
        langs += [k] * len(grams)
    kinds, which = np.unique(np.column_stack([langs, points]), axis=0, return_inverse=True)
    counts = np.bincount(which.ravel())
    model = kneser_ney(kinds[:, 1:].astype(np.uint32), kinds[:, 0], counts, ["x", "y"])
    for history in ("ab", "  ", "bc", "zz", "ca"):
        probabilities = np.exp(model.log_probabilities(np.array([[ord(history[0]), ord(history[1]), ord(c)] for c in "abc z"], np.uint32)))
        # more of a language's own continuations, and never nothing for any other
        assert (probabilities > 0).all()
        seen = {c for a, b, c in zip("  " + texts["x"], " " + texts["x"], texts["x"]) if a + b == history}
        if seen:
            unseen = [probabilities[i, 0] for i, c in enumerate("abc z") if c not in seen]
            assert all(max(probabilities[i, 0] for i, c in enumerate("abc z") if c in seen) > u for u in unseen)
