"""WARC files, read in byte ranges: read_warc(spark, path), or spark.read.format("warc").load(path) after register(spark).

A task owns the records of every gzip member, or of plain text every record, that starts in its range; it validates candidates by decoding their first bytes and
reads on past its end to complete the last one. So the archive's size, not its number of files, decides how many tasks read it, and no task holds a whole file.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once, and tasks of a read; beyond these a task has several ranges.
STEP = 256 << 10
MAX_TASKS = 100_000
SCHEMA = "docid string, headers map<string,string>, content binary"


def parse(stream: io.BufferedIOBase, most: int | None = None) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """The first `most` records (all by default) of a decompressed stream: a WARC/x.y line, headers up to Content-Length and the blank line, then that many bytes. Records without an id are passed over."""
    seen = 0
    while (most is None or seen < most) and (line := stream.readline()):
        if not re.match(rb"WARC/\d+\.\d+", line):
            continue
        seen += 1
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        content = stream.read(int(headers.get("Content-Length", "0") or 0))
        docid = headers.get("WARC-TREC-ID") or headers.get("WARC-Record-ID")
        if docid:
            yield docid, headers, content


class _Member(io.RawIOBase):
    """One gzip member of an open file as a stream; `end` is where it ends, once it is read."""

    def __init__(self, f, at: int):
        self.f, self.at, self.end = f, at, None
        self.z, self.held = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held and not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                self.f.seek(self.at)
                data = self.f.read(STEP)
                self.at += len(data)
                if not data:
                    self.end = self.at
                    return 0
            self.held = self.z.decompress(data, STEP)
            if self.z.eof:
                self.end = self.at - len(self.z.unused_data)
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


class _Plain(io.RawIOBase):
    """An open file from a place on."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        self.f.seek(self.at)
        data = self.f.read(len(out))
        self.at += len(data)
        out[: len(data)] = data
        return len(data)


def file_system(path: str):
    """The file system of a path or URI, and the path's name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"[\w+.-]+:/", path) else f"file://{path}")


def _open(path: str):
    store, name = file_system(path)
    return store.open_input_file(name)


def _candidates(f, start: int, stop: int, mark: bytes) -> Iterator[int]:
    """Places of a mark that starts in [start, stop)."""
    at = start
    while at < stop:
        f.seek(at)
        data = f.read(min(STEP, stop - at) + len(mark) - 1)
        if len(data) < len(mark):
            return
        found = data.find(mark)
        while found >= 0:
            yield at + found
            found = data.find(mark, found + 1)
        at += max(len(data) - len(mark) + 1, 1)


def records(path: str, start: int, stop: int) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """The records of a file that a range [start, stop) owns."""
    with _open(path) as f:
        packed = f.read(2) == b"\x1f\x8b"
        done = start
        for at in _candidates(f, start if packed or not start else start - 1, stop, b"\x1f\x8b\x08" if packed else b"WARC/" if not start else b"\nWARC/"):
            begin = at if packed or not start else at + 1
            if begin < done:
                continue  # inside a member or record that was read
            if packed:
                member = _Member(f, at)
                stream = io.BufferedReader(member, STEP)
                try:
                    if not re.match(rb"\s*WARC/\d", stream.peek(64)[:64]):
                        continue
                    yield from parse(stream)
                except zlib.error:
                    continue
                done = member.end or done
            else:
                if begin >= stop or not start and at and not _after_newline(f, at):
                    continue
                plain = io.BufferedReader(_Plain(f, begin), STEP)
                if not re.match(rb"WARC/\d+\.\d+\r?\n", plain.peek(64)[:64]):
                    continue
                yield from parse(plain, 1)
                done = begin + plain_length(f, begin)


def _after_newline(f, at: int) -> bool:
    f.seek(at - 1)
    return f.read(1) == b"\n"


def plain_length(f, at: int) -> int:
    """Bytes of the record at a place of a plain file, its header and content."""
    stream = io.BufferedReader(_Plain(f, at), STEP)
    n, length = 0, 0
    while line := stream.readline():
        n += len(line)
        if not line.strip():
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value.strip() or 0)
    return n + length


def ranges(spark: SparkSession, path: str, split_bytes: int, glob: str = "*") -> tuple[DataFrame, int]:
    """(path, start, stop) of all files below path, and the number of tasks they are to be read in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length").filter("length > 0")
    found = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"), "length").select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    return found, min(max(found.count(), 1), MAX_TASKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, headers, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string())), pa.array(contents, pa.binary())], names=["docid", "headers", "content"])


def _batches(found: Iterator[tuple[str, dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in found:
        rows.append(row)
        held += len(row[2])
        if len(rows) >= 500 or held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def read_warc(spark: SparkSession, path: str, glob: str = "*.warc*", split_bytes: int = 64 << 20) -> DataFrame:
    """(docid, headers, content) of all WARC files below path, gzipped or not."""
    found, tasks = ranges(spark, path, split_bytes, glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop in zip(*(b[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                yield from _batches(records(name, start, stop))

    return found.repartition(tasks).mapInArrow(run, SCHEMA)


def file_ranges(path: str, step: int, wanted: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    """(path, start, stop) of a file, or of all files below a folder whose names are wanted."""
    from pyarrow import fs

    store, name = file_system(path)
    info = store.get_file_info(name)
    files = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file and wanted(x.base_name)]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return [(f"{scheme}{x.path}", a, min(a + step, x.size)) for x in files for a in range(0, x.size, step)]


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("warc").option("splitBytes", n).load(path) read the files that pyarrow's file systems find under path."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.step = options["path"], int(options.get("splitBytes", 64 << 20))

        def partitions(self):
            from rankloom.sources import warc

            return [InputPartition(r) for r in warc.file_ranges(self.path, self.step, lambda name: ".warc" in name)]

        def read(self, partition):
            from rankloom.sources import warc

            yield from warc._batches(warc.records(*partition.value))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "warc"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def target_urls(records: DataFrame) -> DataFrame:
    """(docid, url) of the records that name one."""
    return records.select("docid", F.col("headers")["WARC-Target-URI"].alias("url")).filter("url is not null")


def for_topics(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records beside each topic that asks for them, by (docid, qid); topics of 0 or less are none."""
    return records.join(wanted.filter("qid is null or qid > 0"), "docid")
