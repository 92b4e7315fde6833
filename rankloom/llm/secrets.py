"""Secret scanning with a recursive decoding worklist.

Each text is scanned as it stands. Then its encoded layers (percent encoding, Unicode and character escapes, base64, compressed data)
are unwrapped one after another until nothing new comes up; every layer is scanned again, and what is found is mapped back to
the code points of the original text that encode it. A layer that was seen before at the same place is not opened twice, so cycles end;
equal layers at several places are each mapped. Compressed data is read whole, all its members, in pieces; base64 that is wrapped over lines is
joined first. A run that as a whole is no text is decoded from each of its first four characters, for text behind other letters or bytes, and in UTF-16.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|%u([0-9A-Fa-f]{4})|&([A-Za-z][A-Za-z0-9]{1,31};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: base64 over several lines; each line is a _RUN.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Stretches of bytes that may hold a secret, the shortest of which has 12 characters: ASCII, or UTF-16 of either byte order.
_STRETCH = re.compile(rb"[\t\n\r -~]{12,}|(?:[\t\n\r -~]\0){12,}|(?:\0[\t\n\r -~]){12,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: Behind these no match and no encoded run goes on: a character that none of them has, or a blank between two words.
_CUT = re.compile(r"[^A-Za-z0-9+/_.=:\"'%\\&#;{}\s-]|(?<=[A-Za-z0-9.]) (?=[A-Za-z])")
#: Inflated text without such a place is held back up to so many characters, then parted with an overlap of _OVERLAP.
_HELD, _OVERLAP = 16 << 20, 1 << 16

Span = tuple[int, int, int]


def matches(text: str) -> list[Span]:
    """(start, kind, end) of one layer's secrets: the base rules, each leftmost and without overlap."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and, for each of its characters, the range of the original text that encodes it (None: the original itself)."""

    __slots__ = ("text", "start", "stop")

    def __init__(self, text: str, start: np.ndarray | None = None, stop: np.ndarray | None = None):
        self.text, self.start, self.stop = text, start, stop

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.stop[b - 1]))

    def ranges(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(a, b), np.arange(a + 1, b + 1)) if self.start is None else (self.start[a:b], self.stop[a:b])

    def key(self) -> bytes:
        """A digest of the text and of the place of each character."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in self.ranges(0, len(self.text)):
            h.update(np.ascontiguousarray(places, np.int64))
        return h.digest()


def _opener(data: bytes):
    """A decompressor for the stream that data begins with, if it begins with one."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(47)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(data: bytes, limit: int) -> Iterator[bytes]:
    """The whole of the compressed streams that data begins with, in pieces of up to limit bytes; a broken stream up to where it breaks."""
    while (stream := _opener(data)) is not None:
        try:
            while True:
                piece = stream.decompress(data, limit)
                if piece:
                    yield piece
                data = getattr(stream, "unconsumed_tail", b"")
                if stream.eof or not piece and not data:
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        if not stream.eof:
            return
        data = stream.unused_data.lstrip(b"\0")  # xz and gzip files may be padded


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """The pieces' text, cut only where nothing that is looked for goes on."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        old, held = len(held), held + decoder.decode(piece)
        # what was held back before has no place to cut but maybe at its end
        cuts = [m.end() for m in _CUT.finditer(held, max(0, old - 1))]
        if cuts:
            yield held[: cuts[-1]]
            held = held[cuts[-1] :]
        elif len(held) > _HELD:
            yield held
            held = held[-_OVERLAP:]
    held += decoder.decode(b"", True)
    if held:
        yield held


def _whole(layer: Layer, a: int, b: int, data: bytes, limit: int) -> Iterator[Layer]:
    """Inflated data, if data is compressed: every character stands for the whole range."""
    x, y = layer.place(a, b)
    for text in _texts(_inflated(data, limit)):
        yield Layer(text, np.broadcast_to(np.int64(x), len(text)), np.broadcast_to(np.int64(y), len(text)))


def _replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """layer with ranges replaced; the new characters of a piece share its range."""
    texts, starts, stops, at = [], [], [], 0
    for a, b, new in [*pieces, (len(layer.text), len(layer.text), "")]:
        texts += [layer.text[at:a], new]
        s, e = layer.ranges(at, a)
        starts.append(s)
        stops.append(e)
        if new:
            x, y = layer.place(a, b)
            starts.append(np.full(len(new), x))
            stops.append(np.full(len(new), y))
        at = b
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(stops))


def _unpercent(layer: Layer, limit: int) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        yield from _whole(layer, m.start(), m.end(), data, limit)
        at = m.start()
        for c in data.decode("utf-8", "replace"):  # one piece for each character keeps places exact
            n = 3 * (len(c.encode()) if c != "\ufffd" else 1)
            pieces.append((at, min(at + n, m.end()), c))
            at = min(at + n, m.end())
    if pieces:
        yield _replaced(layer, [p for p in pieces if p[1] > p[0]])


def _unescape(layer: Layer) -> Iterator[Layer]:
    if not any(mark in layer.text for mark in ("\\", "&", "%u")):
        return
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        if m[8]:
            if m[8] in html5:
                pieces.append((m.start(), m.end(), html5[m[8]]))
            continue
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((m.start(), m.end(), chr(code)))
    if pieces:
        yield _replaced(layer, pieces)


def _lines(text: str) -> Iterator[list[tuple[int, int]]]:
    """Ranges of the lines of each base64 block that is wrapped: a first line, lines of one length, and a last one that may be shorter.

    The first line may be longer or shorter than the others, so where lengths change, blocks begin with either line.
    """
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        runs = [r.span() for r in _RUN.finditer(text, m.start(), m.end())]
        size = [b - a for a, b in runs]
        for i in range(len(runs) - 1):
            if i and size[i] == size[i - 1]:
                continue
            j = i + 1
            while j < len(runs) and size[j] == size[i + 1]:
                j += 1
            full = j
            if j < len(runs) and size[j] < size[i + 1]:
                j += 1
            yield [*runs[i : j - 1], (runs[j - 1][0], m.end() if j == len(runs) else runs[j - 1][1])]
            if j > full and full > i + 1:  # the short line may be a word that follows
                yield runs[i:full]


def _unbase64(layer: Layer, limit: int) -> Iterator[Layer]:
    inside: list[tuple[int, int]] = []
    for lines in _lines(layer.text):
        data = _bytes("".join(layer.text[a:b] for a, b in lines))
        if data is None or inside and inside[-1][0] == lines[0][0] and inside[-1][1] >= lines[-1][1]:
            continue
        s, e = (np.concatenate(x) for x in zip(*(layer.ranges(a, b) for a, b in lines), strict=True))
        if _opener(data) is None:
            text = _plain(data, s, e)
            yield from [text] if text else _stretches(data, s, e)
            continue
        first = True
        for inner in _whole(layer, lines[0][0], lines[-1][1], data, limit):
            if first:
                first = False
                inside.append((lines[0][0], lines[-1][1]))
            yield inner
    at = 0
    inside.sort()
    for m in _BASE64.finditer(layer.text):
        while at < len(inside) and inside[at][1] <= m.start():
            at += 1
        if at < len(inside) and inside[at][0] <= m.start():  # a line of compressed data is no layer by itself
            continue
        if (data := _bytes(m[0])) is not None:
            opened = False
            for inner in _whole(layer, m.start(), m.end(), data, limit):
                opened = True
                yield inner
            if opened:
                continue
            if text := _plain(data, *layer.ranges(m.start(), m.end())):
                yield text
                continue
        yield from _realigned(layer, m.start(), m.end(), limit)


def _realigned(layer: Layer, a: int, b: int, limit: int) -> Iterator[Layer]:
    """The run from a to b decoded from each of its first four characters, since what stands before the encoded part may be of the same letters."""
    for k in range(a, min(a + 4, b)):
        run = layer.text[k:b].rstrip("=")
        data = _bytes(run[: len(run) - (len(run) % 4 == 1)])
        opened = False
        for m in _MAGIC.finditer(data):
            for inner in _whole(layer, k + m.start() * 4 // 3, b, data[m.start() :], limit):
                opened = True
                yield inner
            if opened:  # the streams behind it are read with it
                break
        if not opened:
            yield from _stretches(data, *layer.ranges(k, b))


def _stretches(data: bytes, s: np.ndarray, e: np.ndarray) -> Iterator[Layer]:
    """The stretches of ASCII or UTF-16 in bytes that as a whole are no text; s and e are the places of the base64 characters."""
    for m in _STRETCH.finditer(data):
        wide = 0 in m[0][:2]
        at = np.arange(m.start(), m.end() + 1, 1 + wide)
        last = np.minimum(-(-at[1:] * 4 // 3), len(s)) - 1
        yield Layer(m[0].replace(b"\0", b"").decode("ascii"), s[at[:-1] * 4 // 3], e[last])


def _bytes(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    return None if len(body) % 4 == 1 else base64.b64decode(body + "=" * (-len(body) % 4))


def _plain(data: bytes, s: np.ndarray, e: np.ndarray) -> Layer | None:
    """Decoded base64 as a text, if it is one; s and e are the places of the base64 characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not text or sum(c.isprintable() or c in "\t\r\n" for c in text) < 0.9 * len(text):
        return None
    at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))) if not text.isascii() else np.arange(len(text) + 1)
    first = at[:-1] * 4 // 3
    last = np.minimum(-(-at[1:] * 4 // 3), len(s)) - 1
    return Layer(text, s[first], e[last])


def _layers(layer: Layer, limit: int) -> Iterator[Layer]:
    yield from _unpercent(layer, limit)
    yield from _unescape(layer)
    yield from _unbase64(layer, limit)


def find(text: str, limit: int = 1 << 20) -> tuple[list[Span], list[Span]]:
    """(spans of the base rules on the text itself, spans of all layers), both sorted; inflated data is read whole, in pieces of limit bytes."""
    base = matches(text)
    found, seen = set(base), set()
    work = [_layers(Layer(text), limit)]  # depth first, so that only a piece of each level is held
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if not inner.text or (key := inner.key()) in seen:
            continue
        seen.add(key)
        for a, kind, b in matches(inner.text):
            x, y = inner.place(a, b)
            found.add((x, kind, y))
        work.append(_layers(inner, limit))
    return base, sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with every span, overlapping ones merged, replaced by a mark of the first one's kind."""
    out, at, merged = [], 0, []
    for a, kind, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        out += [text[at:a], f"[{KINDS[kind]}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) for every row of docs (doc_id, text).

    The counts and the digest are of the base rules on the text itself; spans has those of all layers as kind:start:end in code
    points of the original, by start and kind. Null texts are empty, repeated rows are scanned each, other columns are ignored. with_text adds redacted, the text
    with all spans replaced.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint" + ", redacted string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, n, texts = [], [], [], [], []
            for text in b["text"].to_pylist():
                base, found = find(text or "")
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
                n.append(len(found))
                if with_text:
                    texts.append(text if not found else redacted(text, found))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            cols = [b["doc_id"], *(pa.array(counts[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n, pa.int64())]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"] + ["redacted"] * with_text)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (if there is one) to match; the other columns, whatever their names, and all rows stay."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(place).to_pylist():
                found = find(text)[1] if text else []
                texts.append(redacted(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(texts, pa.string()), *b.columns[place + 1 :]], names=names)

    # mapInArrow looks columns up by name, which fails for names with a dot
    out = docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
