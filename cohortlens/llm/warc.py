"""WARC archives with a two-level capture index.

Writing: one record per page, by Spark's own text writer (so its commit protocol covers lost executors), with the end mark of
a WARC record as line separator. Of pages with equal payloads the one with the largest id is a response record with the
payload, the others are revisit records that refer to it and hold headers only; payloads are compared by SHA-1 and length.

Index: a task scans an archive file record by record and lists its captures: reversed-host URL key, time, file, offset,
length. Captures are sorted by key over all files and packed in compressed blocks of ``block_lines`` lines; the directory
keeps the first key of every block.

Lookup: a key is binary-searched in the directory, its blocks are opened, and the records are fetched by range reads.

Defined results: a null or empty page has an empty payload; a null URL becomes ``urn:page:<id>``; control characters and
spaces in a URL are percent-encoded; rows that share an id are records of their own, and all of them are responses if that
id is the largest of their payload; a null id is a response if its payload has no other id, else a revisit.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.idfilter import marked
from cohortlens.llm.shared import scratch_path, ship_package, stored

# Fixed values of the format.
END_OF_RECORD = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 2000
BLOCK_LINES = 1000
# Directory entries that a lookup broadcasts at most; a larger directory is thinned to that and joined.
DIRECTORY_ENTRIES = 100_000
CAPTURE = (
    "urlkey string, captured string, page_id bigint, url string, record_type string, digest string, refers_to bigint, "
    "file string, offset bigint, length bigint"
)
RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in upper-case base32: 160 bits are four times eight digits."""
    hexed = F.sha1(text.cast("binary"))
    digits = []
    for part in range(4):
        value = F.conv(F.substring(hexed, part * 10 + 1, 10), 16, 10).cast("bigint")
        for k in range(7, -1, -1):
            digit = F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            digits.append(F.substring(F.lit(BASE32), digit, F.lit(1)))
    return F.concat(*digits)


@dataclass
class Archive:
    """Paths of an archive: record files, index blocks, directory."""

    records: str
    blocks: str = ""
    directory: str = ""


def _clean_url(url: Column, page_id: Column) -> Column:
    bare = F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        bare = F.replace(bare, F.lit(char), F.lit(code))
    return bare


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, captured: str) -> Column:
    """The text of a record up to its end mark, from page_id, url, digest, bytes, refers_to and (for a response) html."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    some = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), some("bytes"), F.lit("\r\n\r\n")
    )
    length = F.octet_length(http) + (F.col("bytes") if kind == "response" else F.lit(0))
    lines = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), line("WARC-Record-ID", _uuid(some("page_id"), F.col("url"), F.col("digest"))),
        F.lit(f"WARC-Date: {captured}"), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Page-ID", some("page_id")),
    ]
    if kind == "revisit":
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), line("X-Refers-To-Page-ID", some("refers_to"))]
    lines += [F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", length.cast("string"))]
    body = [F.coalesce(F.col("html"), F.lit(""))] if kind == "response" else []
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http, *body)


def write_archive(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, captured: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE,
) -> Archive:
    """Write the pages as records below ``path`` (default: the shared folder). Payloads of fewer than ``min_bytes`` bytes are
    never revisits."""
    path = path or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    own = own.withColumns({
        "url": _clean_url(F.col("url"), F.col("page_id")),
        "bytes": F.octet_length("html").cast("bigint"), "digest": base32_sha1(F.col("html")),
    })
    thin = stored(own.drop("html"), "warc-digests")
    kept = thin.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1 and refers_to is not null")
    revisits = stored(
        thin.join(kept, ["digest", "bytes"]).where("NOT (page_id <=> refers_to)"), "warc-revisits"
    )
    # The payloads of revisits aren't written, so that only records with an id of revisits are looked up; an id may have other
    # payloads, which stay.
    named = marked(own.where("page_id is not null"), "page_id", revisits.select("page_id").where("page_id is not null"))
    sure = named.where("NOT _hit").drop("_hit")
    asked = named.where("_hit").drop("_hit").unionByName(own.where("page_id is null"))
    known = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes")).distinct()
    responses = sure.unionByName(asked.join(known, F.expr("page_id <=> _id AND digest = _digest AND bytes = _bytes"), "left_anti"))
    records = (
        responses.select(_record("response", captured).alias("value"))
        .unionAll(revisits.select(_record("revisit", captured).alias("value")))
    )
    records.write.option("lineSep", END_OF_RECORD).option("maxRecordsPerFile", records_per_file).text(path)
    return Archive(path)


def record_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``url``: the URLs that the records of the pages are written under; a page without one has a name from its id."""
    page_id = F.col(id_col).cast("bigint")
    return pages.select(_clean_url(F.col(url_col).cast("string"), page_id).alias("url"))


def url_key(url: str) -> str:
    """Reversed host first, so that pages of a host and its subdomains sort together."""
    parts = urlsplit(url)
    try:
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        host, port = "", None
    if not host:
        return url.lower()
    host = host[4:] if host.startswith("www.") else host
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def _open(file: str):
    """Random access to a file of the shared store, by its Hadoop path."""
    from pyarrow import fs

    uri = file if "://" in file else file.replace("file:/", "file:///", 1) if file.startswith("file:/") else f"file://{file}"
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def scan_records(file: str, read_bytes: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and headers of every record of a file; blocks are skipped, not held."""
    with _open(file) as source:
        size, at = source.size(), 0
        held, held_at = b"", 0
        while at < size:
            step = read_bytes
            while True:
                if at < held_at or at + 1 > held_at + len(held) or (end := held.find(b"\r\n\r\n", at - held_at)) < 0:
                    held, held_at = source.read_at(min(step, size - at), at), at
                    end = held.find(b"\r\n\r\n")
                    if end < 0:
                        if step >= size - at:
                            raise ValueError(f"{file}: no record at {at}")
                        step *= 2
                        continue
                    end_at = at + end
                else:
                    end_at = held_at + end
                break
            headers = _headers(held[at - held_at : end_at - held_at])
            whole = end_at + 4 + int(headers["content-length"]) - at
            yield at, whole, headers
            at += whole + 4


def index_archive(spark: SparkSession, archive: Archive, path: str | None = None, block_lines: int = BLOCK_LINES) -> Archive:
    """Sort the captures of all record files by key, in compressed blocks with a directory of their first keys."""
    ship_package(spark)
    path = path or scratch_path(spark, "warc-index")
    files = spark.read.format("binaryFile").load(archive.records).select("path").where("length > 0")
    files = files.repartition("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for offset, length, h in scan_records(file):
                    stamp = "".join(c for c in h["warc-date"] if c.isdigit())
                    rows.append((
                        url_key(h["warc-target-uri"]), stamp, _number(h["x-page-id"]), h["warc-target-uri"], h["warc-type"],
                        h["warc-payload-digest"].removeprefix("sha1:"), _number(h.get("x-refers-to-page-id")), file, offset, length,
                    ))
                yield _batch(rows, CAPTURE)

    captures = files.mapInArrow(scan, CAPTURE)
    captures = stored(captures, "warc-captures")
    order = ["urlkey", "captured", "page_id", "file", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[list] = []
        for batch in batches:
            held += [list(row.values()) for row in batch.to_pylist()]
            while len(held) >= block_lines:
                yield _block(number, held[:block_lines])
                held, number = held[block_lines:], number + 1
        if held:
            yield _block(number, held)

    blocks = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, "block bigint, first_key string, last_key string, lines int, packed binary"
    )
    blocks.write.parquet(f"{path}/blocks")
    packed = spark.read.parquet(f"{path}/blocks")
    packed.select("block", "first_key", "last_key").write.parquet(f"{path}/directory")
    return Archive(archive.records, f"{path}/blocks", f"{path}/directory")


def _block(number: int, rows: list[list]) -> pa.RecordBatch:
    packed = zlib.compress("\n".join(json.dumps(row) for row in rows).encode())
    return _batch([(number, rows[0][0], rows[-1][0], len(rows), packed)], "block bigint, first_key string, last_key string, lines int, packed binary")


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [part.split() for part in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def captures_of(blocks: DataFrame, keys: str | None = None) -> DataFrame:
    """The captures in the blocks; with ``keys`` (a column of key lists) only those of the keys."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist() if keys else [None] * batch.num_rows
            for packed, only in zip(batch.column(0), wanted):
                rows = [json.loads(line) for line in zlib.decompress(packed.as_py()).decode().split("\n")]
                if only is not None:
                    low = [row[0] for row in rows]
                    rows = [row for key in sorted(set(only)) for row in rows[bisect.bisect_left(low, key) : bisect.bisect_right(low, key)]]
                yield _batch(rows, CAPTURE)

    return blocks.select("packed", *([keys] if keys else [])).mapInArrow(unpack, CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Fetch the records of the captures by range reads, in the order of files and offsets."""
    ship_package(captures.sparkSession)
    ddl = RECORD + (", payload string" if with_payload else "")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, _open(file)
                head, _, block = source.read_at(length, offset).partition(b"\r\n\r\n")
                h = _headers(head)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                n = int(_headers(http)["content-length"])
                if h["warc-type"] == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n:
                        raise ValueError(f"{file}: damaged record at {offset}")
                row = (_number(h["x-page-id"]), h["warc-target-uri"], h["warc-type"], digest, n, _number(h.get("x-refers-to-page-id")))
                rows.append(row + ((payload.decode("utf-8", "replace"),) if with_payload else ()))
                held += length if with_payload else 0
                if held > 8 << 20:
                    yield _batch(rows, ddl)
                    rows, held = [], 0
            yield _batch(rows, ddl)
        if source is not None:
            source.close()

    placed = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(fetch, ddl)


def read_archive(spark: SparkSession, archive: Archive, with_payload: bool = False) -> DataFrame:
    """All records, by way of the index."""
    ship_package(spark)
    return read_records(captures_of(spark.read.parquet(archive.blocks)), with_payload)


def lookup(spark: SparkSession, archive: Archive, urls: DataFrame, url_col: str = "url", with_payload: bool = True) -> DataFrame:
    """The records of the URLs in a table: their keys are binary-searched in the directory, the blocks that may hold them are
    opened, and the records are read by range. The directory is broadcast if it is small; a larger one is thinned to
    ``DIRECTORY_ENTRIES`` and the rest of the search is a join with the entries in between."""
    ship_package(spark)
    directory = spark.read.parquet(archive.directory)
    entries = directory.count()
    every = max(1, -(-entries // DIRECTORY_ENTRIES))
    coarse = sorted(tuple(r) for r in directory.where(F.col("block") % every == 0).select("first_key", "block").collect())
    firsts = [key for key, _ in coarse]
    shared = spark.sparkContext.broadcast(firsts)

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted({url_key(u) for u in batch.column(0).to_pylist()})
            # an equal first key may continue from the entry before
            rows = [(key, k) for key in keys for k in range(
                max(0, bisect.bisect_left(shared.value, key) - 1), max(1, bisect.bisect_right(shared.value, key)))]
            yield _batch(rows, "key string, slot bigint")

    asked = urls.where(F.col(url_col).isNotNull())
    clean = asked.select(_clean_url(F.col(url_col).cast("string"), F.lit(None).cast("bigint")).alias("url"))
    slots = clean.mapInArrow(sought, "key string, slot bigint").distinct()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                low = max(0, bisect.bisect_left(shared.value, first) - 1)
                rows += [(block, first, last, k) for k in range(low, max(low + 1, bisect.bisect_right(shared.value, first)))]
            yield _batch(rows, "block bigint, first_key string, last_key string, slot bigint")

    between = directory.select("block", "first_key", "last_key").mapInArrow(
        placed, "block bigint, first_key string, last_key string, slot bigint"
    )
    needed = slots.join(between, "slot").where("first_key <= key and key <= last_key")
    needed = needed.groupBy("block").agg(F.collect_set("key").alias("keys"))
    blocks = spark.read.parquet(archive.blocks).join(needed, "block")
    return read_records(captures_of(blocks, "keys"), with_payload)
