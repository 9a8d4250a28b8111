import base64
import hashlib
import pathlib

import pytest

from cohortlens.llm.warc import index_archive, lookup, read_archive, record_urls, scan_records, url_key, write_archive

PAGES = "page_id bigint, url string, html string, digest string, bytes int"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    tricky = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n<p>ü中😀</p>\r\n\r\n"
    out = [(i, f"http://www.example{i % 7}.com/a/{i}?Q={i}", f"<html>{i % 20} text</html>") for i in range(150)]
    out += [(200, None, None), (201, "http://x.org/", ""), (202, "http://x.org/", tricky), (203, "not a url\r\n\t x", tricky)]
    out += [(204, "http://x.org/", "same url"), (205, "http://X.org/", "z" * 300_000), (None, "http://no.id/", "orphan")]
    out += [(None, "http://no.id/2", tricky), (204, "http://x.org/", "same url")]
    return [(*r, "d", 1) for r in out]


@pytest.fixture(scope="module")
def archive(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    return index_archive(spark, write_archive(pages, records_per_file=40), block_lines=10)


def expected(rows, min_bytes=0):
    largest = {}
    for i, _, html, *_ in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        n = len((html or "").encode())
        keeper = largest.get(html or "")
        revisit = keeper is not None and keeper != i and n >= min_bytes
        out.append((i, n, b32(html), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, rows, archive):
    records = read_archive(spark, archive, with_payload=True).collect()
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records]
    assert sorted(mine, key=str) == expected(rows)
    payloads = {r["page_id"]: r["payload"] for r in records if r["record_type"] == "response"}
    assert all(payloads[i] == (html or "") for i, _, html, *_ in rows if i in payloads and i is not None)


def test_small_payloads_are_no_revisits(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    found = read_archive(spark, index_archive(spark, write_archive(pages, min_bytes=1)))
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()]
    assert sorted(mine, key=str) == expected(rows, 1)


def test_files_are_valid_records(archive):
    files = sorted(pathlib.Path(archive.records.removeprefix("file:")).glob("part-*"))
    assert len(files) > 3
    for file in files:
        data = file.read_bytes()
        for read_bytes in (64, 1 << 20):
            at = 0
            for offset, length, headers in scan_records(str(file), read_bytes):
                assert offset == at and data[at:].startswith(b"WARC/1.1\r\nWARC-Type: ")
                at = offset + length + 4
                assert data[at - 4 : at] == b"\r\n\r\n"
            assert at == len(data)


def test_index_is_sorted_and_lookup_finds_all_captures(spark, rows, archive):
    blocks = spark.read.parquet(archive.blocks).orderBy("block").collect()
    assert all(a["last_key"] <= b["first_key"] for a, b in zip(blocks, blocks[1:]))
    wanted = spark.createDataFrame([("http://x.org/", 1), ("http://example3.com/a/3?q=3", 1), ("http://absent.net/", 1)], "url string, slot int")
    found = lookup(spark, archive, wanted).collect()
    assert sorted(str(r["page_id"]) for r in found) == ["201", "202", "204", "204", "205", "3"]
    every = lookup(spark, archive, spark.createDataFrame(rows, PAGES), with_payload=False)
    assert every.count() == len(rows) - 1  # a null URL can't be asked for


def test_thinned_directory(spark, rows, archive, monkeypatch):
    import cohortlens.llm.warc as warc

    monkeypatch.setattr(warc, "DIRECTORY_ENTRIES", 3)
    assert lookup(spark, archive, spark.createDataFrame(rows, PAGES), with_payload=False).count() == len(rows) - 1


def test_url_keys():
    assert url_key("http://www.Example.com:80/A?b=C") == "com,example)/a?b=c"
    assert url_key("https://sub.example.com:8443") == "com,example,sub:8443)/"
    assert url_key("urn:page:5") == "urn:page:5"


def test_empty_table(spark):
    empty = spark.createDataFrame([], PAGES)
    archive = index_archive(spark, write_archive(empty))
    assert read_archive(spark, archive).count() == 0
    assert lookup(spark, archive, spark.createDataFrame([("http://a/",)], "url string")).count() == 0


def test_an_id_with_two_payloads_loses_none(spark):
    # the first payload of 5 is a revisit of 9, its second one stays a response; so do both of an id that is null
    rows = [(5, "http://a/1", "A"), (5, "http://a/2", "B"), (9, "http://a/3", "A"), (3, "http://a/4", "B"), (None, "http://a/5", "A"), (None, "http://a/6", "C")]
    rows = [(*r, "d", 1) for r in rows]
    records = read_archive(spark, index_archive(spark, write_archive(spark.createDataFrame(rows, PAGES))), with_payload=True).collect()
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records]
    assert sorted(mine, key=str) == expected(rows)
    assert sorted((str(r["page_id"]), r["payload"]) for r in records if r["record_type"] == "response") == [("5", "B"), ("9", "A"), ("None", "C")]


def test_urls_of_all_records_find_all_records_once(spark, rows, archive):
    pages = spark.createDataFrame(rows, PAGES)
    found = lookup(spark, archive, record_urls(pages), with_payload=False).collect()
    mine = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(mine, key=str) == expected(rows)


def test_null_urls_find_nothing(spark, archive):
    assert lookup(spark, archive, spark.createDataFrame([(None,)], "url string")).count() == 0
