import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortlens.llm import sentencepieces
from cohortlens.llm.arrow import with_arrow_columns
from cohortlens.llm.sentencepieces import MODEL, PieceModel, decode, encode, with_decoded, with_pieces


@pytest.fixture(scope="module")
def model():
    return PieceModel()


def texts(seed, count):
    random.seed(seed)
    kinds = ["abcdefghij klmn", "aabtthheerrinn ", "  \n\tab.,-0123456789", "éßñ中文😀​ x"]
    return ["".join(random.choice(random.choice(kinds)) for _ in range(random.randint(0, 70))) for _ in range(count)]


def split(ids, first):
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_ids_are_those_of_the_library(model):
    rows = texts(1, 1500) + ["", " ", "   a   b  ", "a\n\n b", "x" * 3000, "The quick brown fox"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert split(*encode(model, pa.array(rows))) == library.encode(rows)


def test_unigram_ids_are_those_of_the_library(model, tmp_path):
    """The same vocabulary read as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece in proto.pieces:
        piece.score = -5 - np.log1p(-min(piece.score, 0)) / 3 if piece.score > -1e8 else -30.0
    file = tmp_path / "unigram.model"
    file.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(file))
    own = PieceModel(str(file))
    assert not own.bpe
    rows = [t for t in texts(2, 800)]
    mine, theirs = split(*encode(own, pa.array(rows))), library.encode(rows)
    score = lambda ids: sum(library.get_score(i) for i in ids if not library.is_byte(i))
    # equal but for ties
    assert all(a == b or (len(a) and abs(score(a) - score(b)) < 1e-3) for a, b in zip(mine, theirs))
    assert np.mean([a == b for a, b in zip(mine, theirs)]) > 0.95


def test_round_trip(model):
    rows = texts(3, 500) + ["literal ▁ mark ▁▁", "\x00\x7f", "a" * 10_000]
    data, offsets = decode(model, *encode(model, pa.array(rows)))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == rows


def test_states_of_common_prefixes_are_kept(model):
    words = sorted({"▁" + w for t in texts(4, 300) for w in t.split()})
    one_by_one = [next(iter(model.encode_words([w]))) for w in words]
    assert list(model.encode_words(words)) == one_by_one


def test_pieces_that_stay_apart(model):
    """The test along the edges of two pieces against merging their characters."""
    random.seed(8)
    pieces = [p for p in sorted(model.whole) if not p.startswith("▁▁")]
    for _ in range(20_000):
        a, b = random.choice(pieces), random.choice(pieces).lstrip("▁")
        if b in model.whole or len(b) == 1:
            assert model.apart(a, b) == (model.merge(a + b) == [a, b])


def test_awkward_rows(awkward, nothing):
    out = with_decoded(with_pieces(awkward))
    assert out.columns[: len(awkward.columns)] == awkward.columns
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["decoded"] == r["text"]
        assert (r["token_ids"] is None) == (r["text"] is None)
        assert r["text"] is None or r["n_tokens"] == len(r["token_ids"])
    assert with_decoded(with_pieces(nothing)).count() == 0


def test_batches_are_taken_in_pieces(spark):
    """10,000 rows make an Arrow batch, however long they are."""
    docs = spark.range(0, 1000, 1, 1).select("id", F.repeat(F.lit("words "), 5000).alias("text"))
    out = with_arrow_columns(docs, "text", "n int", lambda texts: [pa.array([len(texts)] * len(texts), pa.int32())])
    assert out.count() == 1000 and out.agg(F.max("n")).first()[0] * 30_000 < 5 << 20


def test_a_model_forgets(model):
    rows = texts(9, 50)
    before = split(*encode(model, pa.array(rows)))
    model.forget()
    assert not model._apart and not model._words and not model._spines
    assert split(*encode(model, pa.array(rows))) == before


def test_words_that_come_again_stay_remembered(model, monkeypatch):
    """When too many words are held, those of the next slice that were known are not walked again."""
    monkeypatch.setattr(sentencepieces, "CACHED_WORDS", 3)
    model.forget()
    walked = []
    walk = model._pieces
    monkeypatch.setattr(model, "_pieces", lambda words: (walked.extend(words), walk(words))[1])
    often = ["▁again", "▁and", "▁common"]
    for k in range(4):
        words = [*often, f"▁rare{k}", f"▁other{k}"]
        assert [np.frombuffer(x, np.int32).tolist() for x in model.encode_cached(words)] == [
            next(iter(model.encode_words([w]))) for w in words
        ]
        assert len(model._words) <= 5
    assert walked.count("▁again") == 1 + 4  # once, and by the comparison
    model.forget()


class Counted(str):
    """A word that counts how often it is looked up."""

    asked = 0

    def __hash__(self):
        Counted.asked += 1
        return str.__hash__(self)


def test_a_known_word_is_looked_up_once(model):
    words = ["▁known", "▁words", "▁" + "kn" * 40, "▁" + "kn" * 40 + "own", "▁▁"]
    model.forget()
    expected = model.encode_cached(words)
    assert [np.frombuffer(x, np.int32).tolist() for x in expected] == [next(iter(model.encode_words([w]))) for w in words]
    Counted.asked = 0
    assert model.encode_cached([Counted(w) for w in words[:2]]) == expected[:2]
    assert Counted.asked == 2
    model.forget()


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_words_are_decoded_many_at_a_time(monkeypatch, size):
    monkeypatch.setattr(sentencepieces, "SLICE_BYTES", size)
    spans = [b" one", b"  two", "é▁".encode(), b" cut \xe2\x96", b"x" * 60, b" \xff", b""]
    for more in ([], [b" zero\x00byte"]):
        all_spans = spans + more + [b" last"]
        data = np.frombuffer(b"".join(all_spans), np.uint8)
        ends = np.cumsum([len(x) for x in all_spans])
        assert sentencepieces._marked_words(data, ends - [len(x) for x in all_spans], ends) == [
            x.decode("utf-8", "replace").replace("▁", "\udc81").replace(" ", "▁") for x in all_spans
        ]
