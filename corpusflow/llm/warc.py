"""WARC archives of pages, with a two-level capture index.

Each task writes one archive, a gzip member for each record. A payload that several pages share is stored once, as a
response; the others are revisits that refer to it. The index has a line for each record, sorted by the
URL's key (host labels in reverse order, then the rest), in compressed blocks of bounded length; a sparse
directory beside each index file has the first key of each of its blocks. A search finds the index file by its first
key, then the block by binary search in the file's directory, and reads just the block and the records' ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import attempt_name, filesystem, materialise, write_once
from corpusflow.session import scratch_dir

CAPTURE = "key string, page_id long, file string, offset long, length long"
#: Payloads shorter than this are stored each time.
SHARED_FROM = 100


def url_key(url: Column) -> Column:
    """``https://www.example.org/a?b`` becomes ``org,example,www)/a?b``; without ``://`` the text itself, null the empty text."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1))
    return F.when(url.contains("://"), key).otherwise(F.coalesce(url, F.lit("")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record of an HTTP response; a revisit keeps the header block alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {safe}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """``page_id``, ``payload`` (null for a revisit), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: None if (m := re.search(r"page:(-?\d+)", fields.get(name, ""))) is None else int(m[1])
    out = {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    if out["record_type"] == "revisit":
        stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return out | {"payload": None, "payload_bytes": stated, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def _decided(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with their payload's digest and size and, if an earlier one has the same payload, whom they refer to."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"), F.monotonically_increasing_id().alias("place")
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # of one payload the smallest page, and of its rows the first, is the response; null ids refer but are not referred to
    shared = rows.where((F.col("size") >= SHARED_FROM) & F.col("page_id").isNotNull()).select("digest", F.struct("page_id", "place").alias("who"))
    firsts = shared.groupBy("digest").agg(F.min("who").alias("first"))
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= SHARED_FROM) & ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("place") == F.col("first.place")))
    # in a fixed order, so that a task that is run again writes the same archive
    joined = joined.sortWithinPartitions("place")
    return joined.select("page_id", "url", "digest", "size", revisit.alias("revisit"), F.col("first.page_id").alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"), url_key(F.col("url")).alias("key"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row; returns the captures (``key``, ``page_id``, ``file``, ``offset``, ``length``), written as a table.

    A null html is an empty payload, a null url has no target and an empty key, a null page_id is
    kept as such. Of rows with equal payloads of 100 bytes or more the smallest page_id is the response
    (the first of repeated rows), all others revisit it. An empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, rows = f"{folder}/archive-{TaskContext.get().partitionId():05d}.warc.gz", []

        def fill(out) -> None:
            at = 0
            for batch in batches:
                for r in batch.to_pylist():
                    raw = record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["refers_to"], r["revisit"])
                    packed = gzip.compress(raw, 4, mtime=0)
                    out.write(packed)
                    rows.append((r["key"], r["page_id"], name, at, len(packed)))
                    at += len(packed)

        write_once(name, attempt_name(), fill)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    return materialise(_decided(pages, id_col, url_col, html_col).mapInArrow(write, CAPTURE), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """The index files, in order of their first keys, and these keys."""

    files: tuple[str, ...]
    firsts: tuple[str, ...]


def build_capture_index(captures: DataFrame, folder: str, block_lines: int = 1024) -> CaptureIndex:
    """Sort the captures by key into index files of blocks of ``block_lines`` lines, a directory beside each.

    Captures are dealt by ranges of (key, file, offset), so a key with a third of all captures is many blocks and files.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, attempt, directory = f"{folder}/index-{TaskContext.get().partitionId():05d}", attempt_name(), []

        def fill(out) -> None:
            at, lines = 0, []

            def close() -> None:
                nonlocal at
                packed = zlib.compress("\n".join(json.dumps(line) for line in lines).encode(), 6)
                out.write(packed)
                directory.append([lines[0][0], at, len(packed)])
                at += len(packed)
                lines.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    lines.append([r["key"], r["page_id"], r["file"], r["offset"], r["length"]])
                    if len(lines) == block_lines:
                        close()
            if lines:
                close()

        write_once(f"{name}.blocks", attempt, fill)
        write_once(f"{name}.directory", attempt, lambda out: out.write(zlib.compress(json.dumps(directory).encode(), 6)))
        if directory:
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "name": [name]})

    rows = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, "first string, name string").collect()  # a row for each file
    rows.sort(key=lambda r: (r["first"], r["name"]))
    return CaptureIndex(tuple(r["name"] for r in rows), tuple(r["first"] for r in rows))


class _Files:
    """Ranges of files, the few last used kept open."""

    def __init__(self, most: int = 16):
        self.open, self.most = {}, most

    def read(self, uri: str, offset: int = 0, length: int | None = None) -> bytes:
        if uri not in self.open:
            if len(self.open) == self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = filesystem(uri)
            self.open[uri] = system.open_input_file(path)
        source = self.open[uri]
        return source.read_at(source.size() if length is None else length, offset)


def find_captures(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """All captures of the distinct keys in ``keys.key``. A key goes to the index files that may have it (few,
    unless it has many captures), and each file's keys are looked up in order, so a block is read once."""
    files, firsts = index.files, index.firsts

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, own = [], []
            for key in batch.column("key").to_pylist():
                for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    numbers.append(i)
                    own.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(own, pa.string())], names=["number", "key"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, number, block = _Files(), None, None
        for batch in batches:
            found = []
            for i, key in zip(batch.column("number").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if i != number:
                    number, block = i, None
                    directory = json.loads(zlib.decompress(source.read(f"{files[i]}.directory")))
                    starts = [entry[0] for entry in directory]
                for b in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                    if b != block:
                        block = b
                        lines = [json.loads(line) for line in zlib.decompress(source.read(f"{files[i]}.blocks", *directory[b][1:])).decode().split("\n")]
                        own = [line[0] for line in lines]
                    found += lines[bisect_left(own, key) : bisect_right(own, key)]
            if found:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    asked = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct().mapInArrow(to_files, "number int, key string")
    parts = max(1, min(len(files), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return asked.repartition(parts, "number").sortWithinPartitions("number", "key").mapInArrow(look_up, CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the captures' ranges: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``payload``."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Files()
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 64):
                found = [parse_record(gzip.decompress(source.read(r["file"], r["offset"], r["length"]))) for r in rows[at : at + 64]]
                yield pa.RecordBatch.from_pylist(found if with_payload else [f | {"payload": None} for f in found], schema=schema)

    out = captures.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")


def archive_and_read_back(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and index below the shared folder, then find every page's address in the index and read its records."""
    folder = scratch_dir(pages.sparkSession, "archives")
    index = build_capture_index(write_archives(pages, folder, id_col, url_col, html_col), folder)
    found = find_captures(index, pages.select(url_key(F.col(f"`{url_col}`")).alias("key")))
    return read_records(found, with_payload=False)
