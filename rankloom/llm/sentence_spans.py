"""Removal of sentences in spans that repeat an earlier one, over sliding runs of sentences.

A text is cut into sentence parts: a part ends with a word that closes with . ! ? , ; or : and with a line. From every part on, the
shortest run of consecutive parts with enough words is hashed; as its cuts hang on the run's own words only, a repeated passage gives equal
runs whatever it is glued to. Each task keeps the first place of each of its hashes, so a run that a third of all documents
share is one row a task when hashes meet. The hashes that repeat then mark every run that isn't the first, and the sentence parts of marked
runs go. Only texts with a mark are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_bitmap, key_bitmap, write_shared
from .streams import sorted_runs

#: Runs of a task whose first places are found at once.
HELD = 250_000
#: Bytes of a word that count as one word more: a text without blanks has its words, too.
LONG_WORD = 16
#: The place of a null doc_id.
NULL_ID = -(1 << 63)

_MARK = np.zeros(256, bool)
_MARK[list(b".!?,;:")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b"'\")]}")] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts and ends, words before each row, and the sentence parts as ranges [first, last) of words."""
    starts, ends, before = H.word_spans(data, offsets)
    if not len(starts):
        return starts, ends, before, starts, starts
    last = data[ends - 1]
    closed = _MARK[last] | _CLOSING[last] & (ends - starts > 1) & _MARK[data[np.maximum(ends - 2, 0)]]
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    closed[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    closed[before[1:][before[1:] > 0] - 1] = True
    stop = np.flatnonzero(closed) + 1
    return starts, ends, before, np.concatenate(([0], stop[:-1])), stop


def _hash(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs [a, b) of word hashes."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * H._table(len(words), H.BASE), out=sums[1:])
    return H.span_hash(sums, a, b)


def runs(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first part, parts, h1, h2) of the shortest run of parts from each part on that has enough words."""
    for row0, data, offsets in H.chunks(column):
        starts, ends, before, first, stop = parts(data, offsets)
        if not len(first):
            continue
        weight = np.concatenate(([0], np.cumsum(1 + (ends - starts) // LONG_WORD)))
        to = np.searchsorted(weight[stop], weight[first] + words)
        row = np.searchsorted(before, first, side="right") - 1
        ok = to < len(stop)
        ok[ok] = stop[to[ok]] <= before[row[ok] + 1]
        if not ok.any():
            continue
        u, to, row = np.flatnonzero(ok), to[ok], row[ok]
        w = H.word_hashes(data, starts, ends)
        h1 = _hash(w, first[u], stop[to]).view(np.int64)
        h2 = (_hash(H.mix(w + H.BASE), first[u], stop[to]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield row + row0, (u - np.searchsorted(first, before[row])).astype(np.int32), (to - u + 1).astype(np.int32), h1, h2


def _firsts(h1, h2, doc, tid, at) -> tuple[list[np.ndarray], np.ndarray]:
    """The first place of each (h1, h2) and whether there are more."""
    order = np.lexsort((h2, h1))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    often = same[:-1] | same[1:]
    alone, group = order[~often], order[often]
    group = group[np.lexsort((at[group], tid[group], doc[group], h2[group], h1[group]))]
    head = np.ones(len(group), bool)
    head[1:] = (h1[group][1:] != h1[group][:-1]) | (h2[group][1:] != h2[group][:-1])
    rows = np.concatenate((alone, group[head]))
    # the same place twice (a repeated row) is one
    k, o = np.cumsum(head) - 1, group[head]
    other = (doc[group] != doc[o][k]) | (tid[group] != tid[o][k]) | (at[group] != at[o][k]) if len(group) else head
    more = np.bincount(k, weights=other, minlength=len(o)) > 0 if len(group) else np.zeros(0, bool)
    return [x[rows] for x in (h1, h2, doc, tid, at)], np.concatenate((np.zeros(len(alone), bool), more))


def _first_places(source: DataFrame, words: int) -> DataFrame:
    """(h1, h2, doc, tid, at): the first place of every run that has others."""
    names = ["h1", "h2", "doc", "tid", "at", "more"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            cols, more = _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(more)], names=names)

        for b in batches:
            docs, tids = b["doc"].to_numpy(), b["tid"].to_numpy()
            for row, at, _, h1, h2 in runs(b["text"], words):
                held.append((h1, h2, docs[row], tids[row], at))
                n += len(row)
                if n > HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in sorted_runs(batches, "h1"):
            cols, more = _firsts(c["h1"], c["h2"], c["doc"], c["tid"], c["at"])
            known = np.zeros(0, bool)
            if c["more"].any():  # what one task has seen twice
                key = np.rec.fromarrays([c["h1"][c["more"]], c["h2"][c["more"]]])
                known = np.isin(np.rec.fromarrays(cols[:2]), key)
            more = more | known if len(known) else more
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in cols], names=names[:-1])

    found = source.select("doc", "tid", "text").mapInArrow(scan, "h1 bigint, h2 int, doc bigint, tid bigint, at int, more boolean")
    return found.repartition("h1").sortWithinPartitions("h1").mapInArrow(merge, "h1 bigint, h2 int, doc bigint, tid bigint, at int")


def _later(source: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """(doc, tid, at, n): the runs that aren't the first of their kind."""
    shared, mask = key_bitmap(first, "h1")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tids = b["doc"].to_numpy(), b["tid"].to_numpy()
            for row, at, n, h1, h2 in runs(b["text"], words):
                hit = in_bitmap(shared.value, h1 & mask)
                if hit.any():
                    row = row[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[hit], h2[hit], docs[row], tids[row], at[hit], n[hit])], names=["h1", "h2", "doc", "tid", "at", "n"])

    found = source.select("doc", "tid", "text").mapInArrow(scan, "h1 bigint, h2 int, doc bigint, tid bigint, at int, n int")
    first = first.select("h1", "h2", F.struct("doc", "tid", "at").alias("first"))
    return found.join(first, ["h1", "h2"]).filter(F.struct("doc", "tid", "at") != F.col("first")).select("doc", "tid", "at", "n")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, total, removed = [], [], []
        marks = b["marks"].to_pylist()
        for i, text in enumerate(b["text"]):
            raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer().size else np.zeros(0, np.uint8)
            starts, _, _, first, _ = parts(raw, np.array([0, len(raw)]))
            gone = np.zeros(len(first) + 1, np.int64)
            for m in marks[i] or ():
                gone[m["at"]] += 1
                gone[m["at"] + m["n"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            total.append(len(first))
            removed.append(int(gone.sum()))
            if not removed[-1]:
                texts.append(text.as_py())
                continue
            begin = np.append(starts[first], len(raw))
            begin[0] = 0
            texts.append(b"".join(raw[begin[k] : begin[k + 1]].tobytes() for k in np.flatnonzero(~gone)).decode().rstrip())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed"])


def remove_repeats(docs: DataFrame, words: int = 30) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of docs (doc_id, text): text without the sentence parts of any run that occurs
    earlier, in a smaller doc_id (nulls first, then by the text's hash) or before in the same text.

    n_sentences and n_removed count sentence parts. A run is the shortest sequence of consecutive parts with `words` words or more (a word counts once more for every
    16 bytes), so a repeated passage is found if, from its first cut on, it holds that many words up to another cut; shorter repeats stay. Words are
    compared with A-Z lower-cased, white space doesn't count. A text from which nothing is removed stays as it is; otherwise what is left keeps its own white space,
    but for the end. Null texts stay null, empty and blank ones have no parts. Rows that repeat both doc_id and text count as one place, so none of them is the
    other's copy, and all lose the same. Other columns are ignored, an empty table gives an empty one. Runs are compared by 96 bits of hashes.
    """
    doc_id = F.col("doc_id").cast("bigint")
    source = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.col("text").cast("string").alias("text"))
    first = write_shared(_first_places(source, words), "first")
    marks = _later(source, first, words).groupBy("doc", "tid").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    marks = write_shared(marks, "marks")
    shared, mask = key_bitmap(marks, "tid")
    shape = "doc_id bigint, text string, n_sentences bigint, n_removed bigint"

    # the test is made where the texts are cut: one in the plan would cost each task a second Python process
    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~in_bitmap(shared.value, b["tid"].to_numpy() & mask)))
            none = pa.nulls(b.num_rows, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
            yield from _cut(iter([pa.RecordBatch.from_arrays([b["doc_id"], b["text"], none], names=["doc_id", "text", "marks"])]))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, b["tid"].to_numpy() & mask)))

    # texts without a mark, all but few of them, are not shuffled
    clean = source.select("doc_id", "tid", "text").mapInArrow(unmarked, shape)
    hit = source.mapInArrow(marked, source.schema).join(marks, ["doc", "tid"], "left").select("doc_id", "text", "marks")
    return clean.union(hit.mapInArrow(_cut, shape))
