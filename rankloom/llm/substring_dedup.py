"""Removal of every byte covered by a 200-byte string that also starts anywhere else.

Prefix doubling ranks positions by growing prefixes, sorting pairs of ranks and dropping what is unique. Here names are hashes of
the prefixes, and the positions that are sorted are thinned out beforehand: of every 200-byte window only its minimizer (the
position whose 32-byte string has the smallest hash) is kept, which falls on the same place in each occurrence of the window.
An anchor stands for the run of consecutive windows that choose it. The rounds:

1. 32 bytes: anchors are sorted by the name of their first 32 bytes; unique ones are dropped with all their windows.
2. the span of all the anchor's windows (200 to 368 bytes), ranked within the name: where it occurs twice, all its windows repeat; one anchor of each such span goes on to stand for it, if the name has other spans.
3. 200 bytes: the windows of the anchors that are left are ranked within the name, and those that are not unique repeat.

Names are 64-bit hashes, compared within 64-bit classes. Each text takes part once, however many rows have it. Whether rows have one text is
told by their SHA-256, so no two texts are taken for copies; their number in the rounds, tid, is a 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import id_filter, write_shared
from .streams import sorted_runs

GRAM = 32
#: Longest piece of a text whose windows are chosen at once, and contexts of a name that one task ranks.
PIECE = 2 << 20
CLASS = 20_000
#: Anchors of a task among which equal spans are settled before the shuffle.
HELD = 500_000
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, name, span name, first and last window start within the row) of every anchor."""
    width = length - GRAM + 1
    n = len(data)
    sums = H.prefix_sums(data)
    starts = np.arange(n - GRAM + 1)
    name = H.span_hash(sums, starts, starts + GRAM)
    packed = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(name)] = (name & ~_LOW) | starts.astype(np.uint64)  # ties: the leftmost
    blocks = packed.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    p = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0)) - np.maximum(np.diff(offsets) - length + 1, 0), np.maximum(np.diff(offsets) - length + 1, 0)) + offsets[row]
    at = (np.minimum(after[p], before[p + width - 1]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    lo, hi = p[first], p[last]
    return row[first], name[at[first]].view(np.int64), H.span_hash(sums, lo, hi + length).view(np.int64), lo - offsets[row[first]], hi - offsets[row[first]]


def _all_anchors(column: pa.Array, length: int):
    for row0, data, offsets in H.chunks(column, PIECE):
        if len(data) <= PIECE:
            if (np.diff(offsets) >= length).any():
                row, *rest = anchors(data, offsets, length)
                yield row + row0, *rest
            continue
        for a in range(0, len(data) - length + 1, PIECE - length):
            piece = data[a : a + PIECE]
            if len(piece) < length or a and a + length - 1 >= len(data):
                break
            stop = min(len(piece), PIECE - length + length - 1) if a + PIECE < len(data) else len(piece)
            row, name, span, lo, hi = anchors(piece[:stop], np.array([0, stop]), length)
            yield row + row0, name, span, lo + a, hi + a


def _ranked_spans(texts: DataFrame, length: int) -> DataFrame:
    """(tid, lo, hi, name, kind, parts): kind 1: its windows all repeat; 2: to be ranked; 3: stands for a settled span."""
    kinds = "name bigint, span bigint, tid bigint, lo int, hi int, kind byte"

    def settle(name, span, tid, lo, hi):
        """Where a (name, span) has two anchors or more, all are settled and the first goes on as kind 3; else kind 2."""
        order = np.lexsort((lo, tid, span, name))
        name, span, tid, lo, hi = (x[order] for x in (name, span, tid, lo, hi))
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (span[1:] != span[:-1])))
        more = np.repeat(np.diff(np.append(np.flatnonzero(new), len(name))) > 1, np.diff(np.append(np.flatnonzero(new), len(name))))
        kind = np.where(more, 3, 2).astype(np.int8)
        return name, span, tid, lo, hi, kind, new, more

    def scan(batches):
        held, n, seen = [], 0, set()

        def flush():
            name, span, tid, lo, hi, kind, new, more = settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            on, done = new, more
            cols = [np.concatenate([x[on], x[done]]) for x in (name, span, tid, lo, hi)]
            kind = np.concatenate([kind[on], np.ones(int(done.sum()), np.int8)])
            # what is settled only passes through the shuffle, spread evenly
            cols[0][int(on.sum()) :] = H.mix(cols[2][int(on.sum()) :].view(np.uint64) + cols[3][int(on.sum()) :].astype(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cols[0], cols[1], cols[2], cols[3].astype(np.int32), cols[4].astype(np.int32), kind)], names=["name", "span", "tid", "lo", "hi", "kind"])

        for b in batches:
            tids = b["tid"].to_numpy()
            new = np.array([t not in seen and not seen.add(t) for t in tids.tolist()], dtype=bool)
            for row, name, span, lo, hi in _all_anchors(b["text"], length):
                keep = new[row]
                if keep.any():
                    held.append((name[keep], span[keep], tids[row[keep]], lo[keep], hi[keep]))
                    n += int(keep.sum())
            if n > HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def rank(batches):
        for starts, c in sorted_runs(batches, "name"):
            done = c["kind"] == 1
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(c["tid"][done]), pa.array(c["lo"][done]), pa.array(c["hi"][done]), pa.array(c["name"][done]), pa.array(c["kind"][done]), pa.array(np.ones(int(done.sum()), np.int32))], names=["tid", "lo", "hi", "name", "kind", "parts"])
            open_ = ~done
            name, span, tid, lo, hi, kind = (c[x][open_] for x in ("name", "span", "tid", "lo", "hi", "kind"))
            if not len(name):
                continue
            order = np.lexsort((kind, lo, tid, span, name))
            name, span, tid, lo, hi, kind = (x[order] for x in (name, span, tid, lo, hi, kind))
            keep = np.ones(len(name), bool)  # tasks may have seen the same text; what one has settled is settled
            same = (name[1:] == name[:-1]) & (span[1:] == span[:-1]) & (tid[1:] == tid[:-1]) & (lo[1:] == lo[:-1])
            keep[:-1] &= ~same
            name, span, tid, lo, hi, kind = (x[keep] for x in (name, span, tid, lo, hi, kind))
            newspan = np.concatenate(([True], (name[1:] != name[:-1]) | (span[1:] != span[:-1])))
            counts = np.diff(np.append(np.flatnonzero(newspan), len(name)))
            more = np.repeat(counts > 1, counts) & (kind == 2)
            kind = np.where(np.repeat(counts > 1, counts), 3, kind).astype(np.int8)
            # of each span one goes on, if its name has another span
            newname = np.concatenate(([True], name[newspan][1:] != name[newspan][:-1])) if newspan.any() else np.zeros(0, bool)
            spans = np.diff(np.append(np.flatnonzero(newname), int(newspan.sum())))
            on = np.flatnonzero(newspan)[np.repeat(spans > 1, spans)]
            parts = -(-np.repeat(spans, spans)[np.repeat(spans > 1, spans)] // CLASS)
            cols = [np.concatenate([x[on], x[more]]) for x in (tid, lo, hi, name)]
            kinds_ = np.concatenate([kind[on], np.ones(int(more.sum()), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, kinds_, np.concatenate([parts, np.ones(int(more.sum()), np.int64)]).astype(np.int32))], names=["tid", "lo", "hi", "name", "kind", "parts"])

    found = texts.mapInArrow(scan, kinds)
    return found.repartition("name").sortWithinPartitions("name").mapInArrow(rank, "tid bigint, lo int, hi int, name bigint, kind byte, parts int")


def _texts_of(docs: DataFrame, chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's rows (by tid) beside the text, read from one row of docs for each tid."""
    picked = write_shared(wanted.join(chosen, "tid").withColumnRenamed("doc_id", "pick"), "picked")
    present = id_filter(picked.select("pick").distinct(), "pick")
    texts = docs.filter(present(F.col("doc_id")))
    return texts.join(picked.withColumnRenamed("tid", "wtid"), (F.col("tid") == F.col("wtid")) & F.col("doc_id").eqNullSafe(F.col("pick"))).drop("wtid", "pick")


def _ranked_windows(docs: DataFrame, chosen: DataFrame, open_spans: DataFrame, length: int) -> DataFrame:
    """(tid, start, stop): byte ranges made up of windows that repeat."""

    def cut(batches):
        for b in batches:
            names, parts_, kinds, tids, los, payload = [], [], [], [], [], []
            for text, tid, spans in zip(b["text"], b["tid"].to_pylist(), b["spans"].to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for s in spans:
                    piece = raw[s["lo"] : s["hi"] + length]
                    if s["parts"] == 1:
                        rows = [(0, piece.tobytes())]
                    else:
                        w = np.arange(len(piece) - length + 1)
                        h = H.span_hash(H.prefix_sums(piece), w, w + length)
                        part = h % np.uint64(s["parts"])
                        rows = [(q + 1, h[part == q].tobytes() + w[part == q].astype(np.uint8).tobytes()) for q in range(s["parts"]) if (part == q).any()]
                    for q, data in rows:
                        names.append(s["name"])
                        parts_.append(q)
                        kinds.append(s["kind"])
                        tids.append(tid)
                        los.append(s["lo"])
                        payload.append(data)
                    if len(names) > 20_000:
                        yield batch(names, parts_, kinds, tids, los, payload)
                        names, parts_, kinds, tids, los, payload = [], [], [], [], [], []
            if names:
                yield batch(names, parts_, kinds, tids, los, payload)

    def batch(names, parts_, kinds, tids, los, payload):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts_, pa.int32()), pa.array(kinds, pa.int8()), pa.array(tids, pa.int64()), pa.array(los, pa.int32()), pa.array(payload, pa.binary())], names=["name", "part", "kind", "tid", "lo", "payload"])

    def windows(name, part, tid, lo, payload):
        """Flat arrays of the windows of contexts: index of the context, start within the text, hash."""
        text = part == 0
        sizes = np.array([len(x) - length + 1 if t else len(x) // 9 for x, t in zip(payload, text, strict=True)], np.int64)
        ctx = np.repeat(np.arange(len(name)), sizes)
        hashes, start = np.zeros(len(ctx), np.uint64), np.zeros(len(ctx), np.int64)
        begin = np.cumsum(sizes) - sizes
        if text.any():
            which = np.flatnonzero(text)
            data = np.frombuffer(b"".join(payload[i] for i in which), np.uint8)
            at = np.concatenate(([0], np.cumsum(sizes[which] + length - 1)))[:-1]
            inner = np.arange(int(sizes[which].sum())) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which])
            p = np.repeat(at, sizes[which]) + inner
            to = np.repeat(begin[which], sizes[which]) + inner
            hashes[to] = H.span_hash(H.prefix_sums(data), p, p + length)
            start[to] = inner + np.repeat(lo[which], sizes[which])
        for i in np.flatnonzero(~text):
            m = sizes[i]
            hashes[begin[i] : begin[i] + m] = np.frombuffer(payload[i][: 8 * m], np.uint64)
            start[begin[i] : begin[i] + m] = np.frombuffer(payload[i][8 * m :], np.uint8).astype(np.int64) + lo[i]
        return ctx, start, hashes

    def rank(batches):
        for _, c in sorted_runs(batches, "name"):
            new = np.ones(len(c["name"]), bool)
            new[1:] = (c["name"][1:] != c["name"][:-1]) | (c["part"][1:] != c["part"][:-1]) | (c["tid"][1:] != c["tid"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
            name, part, kind, tid, lo, payload = (c[x][new] for x in ("name", "part", "kind", "tid", "lo", "payload"))
            ctx, start, hashes = windows(name, part, tid, lo, payload)
            order = np.lexsort((hashes, name[ctx]))
            h, m = hashes[order], name[ctx][order]
            same = (h[1:] == h[:-1]) & (m[1:] == m[:-1])
            twice = np.zeros(len(h), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = order[twice]
            hit = np.sort(hit[kind[ctx[hit]] == 2])
            if not len(hit):
                continue
            t, s = tid[ctx[hit]], start[hit]
            o = np.lexsort((s, t))
            t, s = t[o], s[o]
            first = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)))
            last = np.append(np.flatnonzero(first)[1:], len(s)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], names=["tid", "start", "stop"])

    spans = open_spans.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi", "name", "kind", "parts")).alias("spans"))
    pieces = _texts_of(docs, chosen, spans).select("tid", "text", "spans").mapInArrow(cut, "name bigint, part int, kind byte, tid bigint, lo int, payload binary")
    return pieces.repartition("name", "part").sortWithinPartitions("name", "part", "tid", "lo").mapInArrow(rank, "tid bigint, start int, stop int")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every row of docs (doc_id, text).

    Removes each byte covered by a string of length bytes that also starts elsewhere, in the same text or another, all
    occurrences alike. removed lists the removed ranges [start, stop). Null texts are empty, and texts under length bytes stay.
    Rows with equal texts are each other's copies and go altogether, be their doc_id equal, null or different. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    rows = write_shared(source.select("doc_id", "tid", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "rows")
    chosen = rows.filter(F.col("n_bytes") >= length).groupBy("tid", "sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    texts = source.filter(F.octet_length("text") >= length)
    marks = write_shared(_ranked_spans(texts.select("tid", "text"), length), "marks")
    windows = _ranked_windows(texts, chosen.select("tid", "doc_id"), marks.filter("kind > 1"), length)
    settled = marks.filter("kind = 1").select("tid", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    ranges = settled.union(windows).groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
    ranges = ranges.join(chosen.filter("copies = 1").select("tid"), "tid", "left_semi")

    def remove(batches):
        for b in batches:
            tids, texts_, removed, spans, shas, lists = [], [], [], [], [], []
            for tid, text, ranges in zip(b["tid"].to_pylist(), b["text"], b["ranges"].to_pylist(), strict=True):
                raw, kept, at, merged = memoryview(text.as_buffer()), hashlib.sha256(), 0, []
                for r in ranges:
                    if merged and r["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["stop"])
                    else:
                        merged.append([r["start"], r["stop"]])
                for start, stop in merged:
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                tids.append(tid)
                texts_.append(hashlib.sha256(raw).hexdigest())
                removed.append(sum(y - x for x, y in merged))
                spans.append(len(merged))
                shas.append(kept.hexdigest())
                lists.append([{"start": x, "stop": y} for x, y in merged])
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(texts_, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["tid", "sha", "n_removed", "n_spans", "kept_sha", "removed"])

    shape = "tid bigint, sha string, n_removed bigint, n_spans bigint, kept_sha string, removed array<struct<start:int,stop:int>>"
    partly = _texts_of(texts, chosen.select("tid", "doc_id"), ranges).select("tid", "text", "ranges").mapInArrow(remove, shape).dropDuplicates(["tid", "sha"])
    whole = F.col("copies") > 1
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        rows.join(chosen.filter("copies > 1").select("tid", "sha", "copies"), ["tid", "sha"], "left")
        .join(partly, ["tid", "sha"], "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
            F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:int,stop:int>>"))).alias("removed"),
        )
    )
