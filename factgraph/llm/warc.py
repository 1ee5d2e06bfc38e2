"""WARC archives: write records with an index first, then read selected records by coalesced byte ranges.

Archives are gzip files with one member per record, so that any record can be read alone. Each writing task makes its own
file in the shared folder under a fresh name; the index (file, offset, length, URL, digest per record) is written as a Spark
table, whose commit protocol keeps only the rows of tasks that succeeded. A lost executor's half-written files are never
referred to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, stage_table

#: Byte ranges at most this far apart are read as one.
GAP = 64 << 10
#: A coalesced read is closed once it holds this many bytes.
READ_BYTES = 8 << 20
#: Tables of repeated payloads up to this many rows are broadcast to the writers; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Records carry this date unless another is given; a fixed one makes archives reproducible.
DATE = "2024-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":/" in uri else "file://" + uri)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}')}>"


def _header_value(text: str) -> str:
    """Controls would end a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), text)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[bytes, str, str]:
    """A record as a gzip member, its digest and type. ``refers_to``: the response whose payload equals this one's."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, None, digest)}"]
    lines.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush(), digest, kind


def info_record(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that an archive begins with, as a gzip member."""
    fields = b"software: factgraph\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + fields + b"\r\n\r\n") + press.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member; raises ValueError where lengths don't agree."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    n = int(warc["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {warc.get('WARC-Record-ID')}: length {n} doesn't fit")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index.

    Payload: html in UTF-8, a null one is empty. Of records with equal payloads of at least ``min_bytes`` bytes, the one
    with the smallest page_id is the response and the others revisit it; a row that repeats that page_id is a response
    too, so is every row of a group that has null ids only, and a null id elsewhere revisits. Only digests are shuffled
    to find repeats; the html itself is read by the writers. Other columns are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    repeats = stage_table(
        rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select("sha1", "first_id"),
        "warc-repeats",
    )
    if repeats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeats = F.broadcast(repeats)
    joined = rows.join(repeats, "sha1", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    root = shared_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(root)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            first = info_record(name, date)
            out.write(first)
            at = len(first)
            for b in slices(batches):
                index = []
                for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    member, digest, kind = build_record(page_id, url, text.encode(), refers_to, date)
                    out.write(member)
                    index.append((page_id, url, f"{root}/{name}", at, len(member), digest, kind))
                    at += len(member)
                out.flush()
                yield _batch(index, _INDEX)

    return stage_table(joined.mapInArrow(write, _INDEX), "warc-index")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(*x) for x in ((n, types[t]) for n, t in (c.split() for c in ddl.split(", ")))]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))


def coalesce_ranges(ranges: Iterator[tuple], gap: int = GAP, limit: int = READ_BYTES) -> Iterator[list[tuple]]:
    """Runs of (file, offset, length, ...) rows, sorted by file and offset, that one read can serve."""
    run: list[tuple] = []
    for r in ranges:
        if run and (r[0] != run[-1][0] or r[1] - (run[-1][1] + run[-1][2]) > gap or r[1] + r[2] - run[0][1] > limit):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows ``selected``: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload (null for revisits, or for all if ``payloads`` is false).

    Rows are dealt by range of (file, offset) and sorted, and neighbouring byte ranges are read at once. A response's
    digest is computed from its payload; a record that fails its digest or lengths, or names another page or URL than the
    index does, raises an error.
    """
    rows = selected.select("file", "offset", "length", "page_id", "url", "digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for run in coalesce_ranges(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            file, start = run[0][:2]
            if file not in opened:
                for f in opened.values():
                    f.close()
                files, path = _filesystem(file)
                opened = {file: files.open_input_file(path)}
            data = opened[file].read_at(run[-1][1] + run[-1][2] - start, start)
            out = []
            for _, offset, length, page_id, url, digest in run:
                warc, http, payload = parse_record(data[offset - start : offset - start + length])
                kind = warc["WARC-Type"]
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if found != digest or kind == "response" and len(payload) != int(http["Content-Length"]):
                    raise ValueError(f"{file}, offset {offset}: the payload doesn't fit its digest or length")
                if warc["WARC-Record-ID"] != _record_id(page_id, url, digest) or warc.get("WARC-Target-URI") != (None if url is None else _header_value(url)):
                    raise ValueError(f"{file}, offset {offset}: the record is not that of page {page_id}")
                refers = re.fullmatch(r"<urn:page:(-?\d+)>", warc.get("WARC-Refers-To", ""))
                out.append((page_id, url, int(http["Content-Length"]), found, kind, int(refers[1]) if refers else None, payload if payloads and kind == "response" else None))
            yield _batch(out, _RECORD)

    return rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, _RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` row written to an archive and read back."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN g USING (h)
"""
