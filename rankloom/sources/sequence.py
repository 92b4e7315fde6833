"""SequenceFiles, read in byte ranges: read_sequence(spark, path), or spark.read.format("sequencefile").load(path) after register(spark).

A run of records begins behind the header or at a sync mark, and belongs to the range its mark starts in; the range's task reads on past its end to the next mark.
So a file's size decides how many tasks read it, and a task holds one record, or one block where blocks are compressed (1 MB as Hadoop writes them).
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc

SCHEMA = "key string, value binary"
_ESCAPE = b"\xff\xff\xff\xff"


class _Cursor:
    """Reads an open file onwards from a place; `at` is the place of the next byte."""

    def __init__(self, f, at: int):
        self.at = at
        self._stream = io.BufferedReader(warc._Plain(f, at), warc.STEP)

    def ended(self) -> bool:
        return not self._stream.peek(1)

    def take(self, n: int) -> bytes:
        data = self._stream.read(n)
        if n < 0 or len(data) < n:
            raise ValueError(f"file ends inside a record at {self.at}")
        self.at += n
        return data

    def int32(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def vint(self) -> int:
        """Hadoop's variable-length integer: small ones are their own byte, others a byte with sign and length before the digits."""
        first = struct.unpack("b", self.take(1))[0]
        if first >= -112:
            return first
        negative = first < -120
        n = int.from_bytes(self.take(-120 - first if negative else -112 - first), "big")
        return ~n if negative else n

    def text(self) -> str:
        return self.take(self.vint()).decode("utf-8", "replace")


@dataclass
class _Header:
    key: str
    value: str
    codec: str | None
    blocks: bool
    mark: bytes
    end: int


def _header(f) -> _Header:
    c = _Cursor(f, 0)
    magic, version = c.take(3), c.take(1)[0]
    if magic != b"SEQ" or version not in (5, 6):
        raise ValueError("not a SequenceFile of version 5 or 6")
    key, value = c.text(), c.text()
    packed, blocks = (b != 0 for b in c.take(2))
    codec = c.text() if packed else None
    for _ in range(2 * c.int32() if version == 6 else 0):
        c.text()
    return _Header(key.rsplit(".", 1)[-1], value.rsplit(".", 1)[-1], codec and codec.rsplit(".", 1)[-1], blocks, _ESCAPE + c.take(16), c.at)


def _inflated(data: bytes) -> bytes:
    """zlib or gzip data, all members."""
    out = b""
    while data:
        z = zlib.decompressobj(47)
        out += z.decompress(data) + z.flush()
        data = z.unused_data
    return out


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


_CODECS: dict[str | None, Callable[[bytes], bytes]] = {None: bytes, "DefaultCodec": _inflated, "DeflateCodec": _inflated, "GzipCodec": _inflated, "BZip2Codec": bz2.decompress, "ZStandardCodec": _zstd}


def _payload(kind: str, data: bytes) -> bytes | None:
    """What a serialised Text or BytesWritable holds; null for NullWritable, other classes as they are serialised."""
    if kind == "NullWritable":
        return None
    if kind == "BytesWritable":
        return data[4 : 4 + struct.unpack(">i", data[:4])[0]]
    if kind == "Text":
        c = _Cursor(pa.BufferReader(data), 0)
        return c.take(c.vint())
    return data


#: Numbers that a key may be, as struct formats; variable-length ones apart.
_NUMBERS = {"IntWritable": ">i", "LongWritable": ">q", "ShortWritable": ">h", "FloatWritable": ">f", "DoubleWritable": ">d"}


def _key(kind: str, data: bytes) -> str | None:
    if kind in _NUMBERS:
        return str(struct.unpack(_NUMBERS[kind], data)[0])
    if kind in ("VIntWritable", "VLongWritable"):
        return str(_Cursor(pa.BufferReader(data), 0).vint())
    found = _payload(kind, data)
    return None if found is None else found.decode("utf-8", "replace")


def _block(c: _Cursor, unpack: Callable[[bytes], bytes]) -> Iterator[tuple[bytes, bytes]]:
    """The records of a compressed block: lengths of keys, keys, lengths of values, values, each compressed by itself."""
    n = c.vint()
    sizes_k, keys, sizes_v, values = (pa.BufferReader(unpack(c.take(c.vint()))) for _ in range(4))
    lengths_k, keys, lengths_v, values = (_Cursor(x, 0) for x in (sizes_k, keys, sizes_v, values))
    for _ in range(n):
        yield keys.take(lengths_k.vint()), values.take(lengths_v.vint())


def records(path: str, start: int, stop: int) -> Iterator[tuple[str | None, bytes | None]]:
    """The (key, value) records of a file that a range [start, stop) owns; the range at 0 owns those behind the header as well."""
    with warc._open(path) as f:
        head = _header(f)
        if head.codec not in _CODECS:
            raise ValueError(f"{path}: codec {head.codec} isn't read")
        unpack = _CODECS[head.codec]
        first = head.end if start == 0 else next(warc._candidates(f, max(start, head.end), stop, head.mark), None)
        if first is None:
            return
        c = _Cursor(f, first)
        while not c.ended():
            place, length = c.at, c.int32()
            if length == -1:
                if place >= stop:
                    return
                if c.take(16) != head.mark[4:]:
                    raise ValueError(f"{path}: no sync mark at {place}")
                if head.blocks:
                    yield from ((_key(head.key, k), _payload(head.value, v)) for k, v in _block(c, unpack))
                continue
            n = c.int32()
            key, value = c.take(n), c.take(length - n)
            yield _key(head.key, key), _payload(head.value, unpack(value))


def _batches(found: Iterator[tuple[str | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
    keys, values, held = [], [], 0
    for key, value in found:
        keys.append(key)
        values.append(value)
        held += len(value or b"") + len(key or "")
        if len(keys) >= 10_000 or held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["key", "value"])
            keys, values, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["key", "value"])


def read_sequence(spark: SparkSession, path: str, glob: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """(key, value) of all SequenceFiles below path, plain, with compressed records or with compressed blocks.

    Keys are text, numbers in decimal, or null for NullWritable; a value is what Text or BytesWritable holds, else its serialised bytes. Empty files and folders give
    no rows; a truncated file or a codec other than zlib, gzip, bzip2 and zstandard raises ValueError.
    """
    found, tasks = warc.ranges(spark, path, split_bytes, glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop in zip(*(b[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                yield from _batches(records(name, start, stop))

    return found.repartition(tasks).mapInArrow(run, SCHEMA)


#: Codecs that are written, by the names of Hadoop's classes.
_PACK: dict[str, tuple[str, Callable[[bytes], bytes]]] = {"zlib": ("DefaultCodec", zlib.compress), "gzip": ("GzipCodec", gzip.compress), "bzip2": ("BZip2Codec", bz2.compress)}
#: Bytes of keys and values that a block of records is closed at.
BLOCK_BYTES = 1 << 20


def _vint(n: int) -> bytes:
    if n <= 127:
        return bytes([n])
    digits = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return struct.pack("b", -112 - len(digits)) + digits


def _write(out, rows: Iterator[tuple[bytes, bytes]], codec: str, mark: bytes) -> None:
    """A file of compressed blocks, keys as Text and values as BytesWritable."""
    name, pack = _PACK[codec]

    def text(s: str) -> bytes:
        return _vint(len(s)) + s.encode()

    hadoop = "org.apache.hadoop.io."
    out.write(b"SEQ\x06" + text(f"{hadoop}Text") + text(f"{hadoop}BytesWritable") + b"\x01\x01" + text(f"{hadoop}compress.{name}") + bytes(4) + mark)
    keys, values, held = [], [], 0

    def close() -> None:
        parts = (b"".join(_vint(len(x)) for x in keys), b"".join(keys), b"".join(_vint(len(x)) for x in values), b"".join(values))
        out.write(_ESCAPE + mark + _vint(len(keys)))
        for part in map(pack, parts):
            out.write(_vint(len(part)) + part)

    for key, value in rows:
        keys.append(_vint(len(key)) + key)
        values.append(struct.pack(">i", len(value)) + value)
        held += len(key) + len(value)
        if held >= BLOCK_BYTES:
            close()
            keys, values, held = [], [], 0
    if keys:
        close()


def write_sequence(df: DataFrame, path: str, key: str | Column, value: str | Column, codec: str = "zlib") -> None:
    """Writes keys as Text and values as BytesWritable in compressed blocks (zlib, gzip or bzip2), a file for each partition that has rows; a null key or value becomes empty.

    Attempts write below a hidden folder, and only files of tasks that succeeded are moved into path, so a retried or lost task leaves no row twice.
    """
    register(df.sparkSession)
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    rows = df.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.coalesce(value.cast("binary"), F.lit("").cast("binary")).alias("value"))
    rows.write.format("sequencefile").mode("append").option("codec", codec).save(path)


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("sequencefile").option("splitBytes", n).load(path) read the files that pyarrow's file systems find under path, and
    df.write.format("sequencefile").mode("append").option("codec", c).save(path) add (key, value) rows to them."""
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.step = options["path"], int(options.get("splitBytes", 64 << 20))

        def partitions(self):
            from rankloom.sources import warc

            return [InputPartition(r) for r in warc.file_ranges(self.path, self.step, lambda name: name[0] not in "_.")]

        def read(self, partition):
            from rankloom.sources import sequence

            yield from sequence._batches(sequence.records(*partition.value))

    @dataclass
    class Written(WriterCommitMessage):
        name: str | None

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            self.path, self.codec = options["path"].rstrip("/"), options.get("codec", "zlib")
            self.job = uuid.uuid4().hex[:12]
            if self.codec not in _PACK:
                raise ValueError(f"codec {self.codec} isn't written; one of {', '.join(_PACK)} is")

        def _folder(self):
            from rankloom.sources import warc

            store, name = warc.file_system(self.path)
            return store, name, f"{name}/_writing-{self.job}"

        def write(self, iterator):
            from rankloom.sources import sequence

            rows = ((k.encode(), v) for b in iterator for k, v in zip(b["key"].to_pylist(), b["value"].to_pylist(), strict=True))
            if (first := next(rows, None)) is None:
                return Written(None)
            store, _, hidden = self._folder()
            store.create_dir(hidden, recursive=True)
            mark = uuid.uuid4()
            with store.open_output_stream(f"{hidden}/{mark.hex}") as out:
                sequence._write(out, itertools.chain([first], rows), self.codec, mark.bytes)
            return Written(mark.hex)

        def commit(self, messages):
            store, name, hidden = self._folder()
            store.create_dir(hidden, recursive=True)
            for i, m in enumerate(messages):
                if m is not None and m.name:
                    store.move(f"{hidden}/{m.name}", f"{name}/part-{i:06d}-{m.name}.seq")
            store.delete_dir(hidden)

        def abort(self, messages):
            from pyarrow import fs

            store, _, hidden = self._folder()
            if store.get_file_info(hidden).type == fs.FileType.Directory:
                store.delete_dir(hidden)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "sequencefile"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

        def writer(self, schema, overwrite):
            if overwrite:
                raise ValueError("SequenceFiles are added to a folder (mode append), never replaced")
            return Writer(self.options)

    spark.dataSource.register(Source)
