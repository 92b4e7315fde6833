"""WARC archives of gzip members, written by Spark's own committer and read back in byte ranges.

Writing: each record is one gzip member, and goes out as a line of Spark's text writer, whose line separator is the zero byte that the member ends
with anyway (the top byte of its length; members of 16 MB and more get an empty member behind them). So lost tasks and
retries are the committer's business, and any store that Spark writes to will do.

Reading: every file is cut into byte ranges. A task looks for gzip magic in its range, validates each candidate by decoding the member's WARC
header, and owns the records that start inside, reading on past its end to complete the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_filter, shared_path, write_shared

_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
_MAGIC = b"\x1f\x8b\x08"
_STEP = 256 << 10
#: Tasks of a read; beyond it, a task has several ranges, one after another.
MAX_TASKS = 100_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and length but not the payload."""
    revisit = refers_to is not None
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Date: {date}", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row of pages (page_id, url, html) below path.

    Of rows with equal payloads of least_bytes or more, those with the smallest page_id (nulls: only if all are null) are responses and the
    others revisits; equal smallest ids are all responses. Null html is an empty payload, a null url or id has no value in the header. Repeated rows are
    records each, an empty table gives an empty archive, other columns are ignored. Only payloads that may repeat are shuffled. date is every record's
    WARC-Date, a parameter so that a task that runs twice writes the same bytes.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha1("payload"))
    again = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = write_shared(again.select("key", "first", F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint").alias("number")), "repeated")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    # payloads that occur once, most of them, are not shuffled; a frequent one's rows are split by Spark's skewed joins
    repeated = hash_filter(again, "number")(F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint"))
    rows = rows.withColumn("repeated", repeated)
    marked = rows.filter("repeated").join(again.select("key", "first"), "key", "left").select("page_id", "url", "payload", refers_to)
    marked = rows.filter("not repeated").select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("refers_to")).union(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                member(record(i, u, p.as_buffer().to_pybytes(), r, date))[:-1]
                for i, u, p, r in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["payload"], b["refers_to"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    marked.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(_uri(path))
    return store.open_input_file(name)


def _decoded(f, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, payload and end of the WARC record in the gzip member at a place, or None if there is no such member."""
    z, out, header, need, pos, sought = zlib.decompressobj(31), bytearray(), None, None, at, 0
    while True:
        f.seek(pos)
        block = f.read(_STEP if header or sought > 1 << 16 else 4096)
        if not block:
            return None
        try:
            out += z.decompress(block)
        except zlib.error:
            return None
        pos += len(block)
        if header is None:
            if len(out) >= 5 and out[:5] != b"WARC/":
                return None
            end = out.find(b"\r\n\r\n", max(0, sought - 3))
            sought = len(out)
            if end >= 0:
                lines = out[:end].decode("utf-8", "replace").split("\r\n")
                header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not header.get("content-length", "").isdigit():
                    return None
                need = end + 4 + int(header["content-length"])
        if z.eof:
            if header is None or len(out) < need:
                return None
            return header, bytes(out[need - int(header["content-length"]) : need]), pos - len(z.unused_data)


def records(path: str, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose gzip member starts in [start, stop) of a file."""
    with _open(path) as f:
        size, at, tail, base = f.size(), start, b"", start
        while at < stop:
            if not (base <= at and at + 2 < base + len(tail)):
                f.seek(at)
                base, tail = at, f.read(min(_STEP, size - at))
                if len(tail) < 3:
                    return
            found = tail.find(_MAGIC, at - base)
            if found < 0:
                at = base + len(tail) - 2
                if at + 3 > size:
                    return
                continue
            at = base + found
            if at >= stop:
                return
            if (got := _decoded(f, at, size)) is None:
                at += 1
            else:
                yield got[0], got[1]
                at = got[2]


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records below path.

    Files are cut into ranges of split_bytes, each a task's of its own. A folder without records gives an empty table; null ids and urls come back null,
    repeated records each. A payload that doesn't match its digest raises ValueError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"), "length").select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    # ranges are tiny rows: without a number, Spark would merge them into one task. Tasks are as many as ranges, up to a bound
    tasks = min(max(ranges.count(), 1), MAX_TASKS)

    def number(value: str | None) -> int | None:
        m = re.search(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, start, stop in zip(*(b[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                rows, held = [], 0
                for header, payload in records(p, start, stop):
                    revisit = header["warc-type"] == "revisit"
                    said = header["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != said:
                        raise ValueError(f"{p}: payload of {header['warc-record-id']} does not match its digest")
                    rows.append((number(header["warc-record-id"]), header.get("warc-target-uri"), header["warc-type"], payload if not revisit else None, int(header["warc-payload-length"]) if revisit else len(payload), said, number(header.get("warc-refers-to"))))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and returns what reading them gives, without payloads."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
