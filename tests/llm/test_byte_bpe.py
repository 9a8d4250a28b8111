"""Byte-level BPE by a tree of joins against the tokenizer's own library."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe
from cohortlens.llm.byte_bpe import Merges, encoded, read_ranks, with_decoded, with_round_trip, with_token_ids

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    some = "aaabbcde  \n\t'sé中😀0123ǅ՘" + chr(0x11DE0) + chr(0x558) + chr(0xC5C)
    out = ["".join(rng.choice(some) for _ in range(rng.randrange(200))) for _ in range(300)]
    out += ["a" * n for n in (1, 31, 32, 33, 100, 1000, 5001)] + [" " * n for n in (1, 5, 77, 1000)]
    out += ["ab" * 777, "abc" * 999, "".join(map(chr, rng.choices(range(1, 0xD800), k=3000))), "", "<|endoftext|>"]
    return out


@pytest.mark.parametrize("leaf", [1, 2, 7, 32])
def test_ids_are_those_of_the_library(library, leaf):
    given = texts()
    ids, starts = encoded(pa.array(given), PATH, PATTERN, leaf)
    for i, text in enumerate(given):
        assert ids[starts[i] : starts[i + 1]].tolist() == library.encode_ordinary(text)


def test_joining_is_associative_and_cuts_do_not_matter(ranks):
    merges = Merges(ranks, 4)
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice(" aabehinorst中") for _ in range(60)).encode()
        i, j = sorted(rng.sample(range(len(data) + 1), 2))
        a, b, c = (merges.merged(part) for part in (data[:i], data[i:j], data[j:]))
        whole = merges.merged(data)
        assert merges.join(merges.join(a, b), c) == merges.join(a, merges.join(b, c)) == whole


def test_scan_and_heap_merge_alike(ranks):
    merges = Merges(ranks)
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"aaab helnot\xe4\xb8\xad") for _ in range(rng.randrange(1, 90)))
        assert merges._scanned(data) == merges._heaped(data)


def test_remembered_words_are_bounded(ranks, library):
    words = byte_bpe._Words(Merges(ranks), most=2000)
    for i in range(200):
        assert len(words[f"word{i}"]) == 4 * len(library.encode_ordinary(f"word{i}"))
        assert words.held <= 2000 and len(words) <= 10
    assert words["y" * 300] and "y" * 300 not in words


def test_whole_table_with_awkward_rows(awkward, library):
    rows = with_round_trip(awkward, PATH, PATTERN).collect()
    assert len(rows) == awkward.count() and "h1" in rows[0].asDict()
    for row in rows:
        text = row["text"] or ""
        assert list(row["token_ids"]) == library.encode_ordinary(text)
        assert row["n_tokens"] == len(row["token_ids"]) and bytes(row["decoded"]) == text.encode()


def test_decoding_other_lists(spark):
    given = spark.createDataFrame(
        [(1, [31373, None, 995]), (2, None), (3, []), (4, [0])], "k int, ids array<bigint>"
    ).withColumn("decoded", F.lit("replaced"))
    found = {row["k"]: bytes(row["decoded"]) for row in with_decoded(given, PATH, "ids").collect()}
    assert found == {1: b"hello world", 2: b"", 3: b"", 4: b"!"}
    with pytest.raises(Exception, match="vocabulary does not have"):
        with_decoded(spark.createDataFrame([(1, [50256, 5])], "k int, ids array<int>").withColumn(
            "ids", F.array(F.lit(50256 + 999))), PATH, "ids").collect()


def test_empty_table(nothing):
    assert with_token_ids(nothing, PATH, PATTERN).count() == 0
