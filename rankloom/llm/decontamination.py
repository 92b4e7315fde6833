"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

Items are the indexed documents, in blocks of similar ids; for each term the index keeps its impact in each item and the largest impact in each block
that has it, both as sorted (term, item) and (term, block) keys. Impacts are divided by the item's score against itself, so one threshold fits all items.
Passages are overlapping windows of each text, long enough that an item fits into one whole. Items are indexed in classes of length, each with windows of its own
width, so what is found of an item depends neither on the other items nor on how they are sharded. Retrieval is block-max WAND: a passage's terms are ordered by
their largest impact anywhere; up to the pivot they can't reach the threshold together, so only blocks with a term from the pivot on are looked at. Of
these the sum of block maxima bounds the score of any item inside, blocks under the threshold are skipped, and the items of the others are scored. All items
above the threshold are retrieved; each is then verified by the share of its question's and its answer's word n-grams that the passage holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import hash_filter, write_shared

K1, B = 1.2, 0.75
#: Items of a block.
BLOCK = 8
#: Bytes of an index that is broadcast at once; a larger benchmark is indexed in shards of that size, one after another.
INDEX_BYTES = 32 << 20
#: Bytes of index for each word of an item, at most: 8 for the term, 8 for its largest impact, 8 for where its blocks begin, 20 for a block, 16 for an item, and 8 for the n-grams of question or answer.
WORD_BYTES = 68
#: Least width of a class of lengths, in words.
LEAST_WIDTH = 16
_PIECE = 256 << 10
#: Passages whose blocks are bounded at once.
PORTION = 500
#: Words of the n-grams that an answer is compared by; a shorter answer is compared whole.
ANSWER_GRAM = 3
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"'()*,-.:;<>?[]_`{}")] = True


@dataclass
class Index:
    """terms: sorted hashes, numbered in that order; keys of blocks and items are term * number + block or item, sorted."""

    ids: list[int]
    terms: np.ndarray
    top: np.ndarray
    block_keys: np.ndarray
    block_first: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    item_keys: np.ndarray
    impact: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    words: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.top, self.block_keys, self.block_first, self.block_of, self.block_max, self.item_keys, self.impact, *self.question, *self.answer))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words without punctuation around them, and the number of words before each row."""
    starts, ends, before = H.word_spans(data, offsets)
    some = np.arange(len(starts))
    for _ in range(3):
        some = some[_PUNCTUATION[data[ends[some] - 1]] & (ends[some] - starts[some] > 1)]
        ends[some] -= 1
    some = np.arange(len(starts))
    for _ in range(3):
        some = some[_PUNCTUATION[data[starts[some]]] & (ends[some] - starts[some] > 1)]
        starts[some] += 1
    return H.word_hashes(data, starts, ends), before


def _hashes(text: str) -> np.ndarray:
    for _, data, offsets in H.chunks(pa.array([text])):
        return _words(data, offsets)[0]
    return np.zeros(0, np.uint64)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at a line or mark that begins an answer if there is one, else the last sentence is the answer."""
    if m := re.search(r"(?:^|\s)(?:answer|a)\s*:\s*", text, re.I):
        if m.start() > 0:
            return text[: m.start()], text[m.end() :]
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(H.runs_hash(words, min(n, max(len(words), 1)))) if len(words) else np.zeros(0, np.uint64)


def frequencies(items: DataFrame) -> DataFrame:
    """(term, df) over items (text); term is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.unique(_hashes(t)) for t in b["text"].to_pylist()]
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms).view(np.int64))], names=["term"])

    return items.select("text").mapInArrow(run, "term bigint").groupBy("term").agg(F.count("*").alias("df"))


def build(items: list[tuple[int, str]], stats: tuple[int, float, dict[int, int]], n: int) -> Index:
    """Index of a shard of items; stats: number of items and mean length of the whole benchmark, and document frequencies there of the shard's terms."""
    total, mean, df = stats
    rows, ids, questions, answers, most = [], [], [], [], 0
    for item_id, text in items:
        words = _hashes(text)
        if not len(words):
            continue
        terms, tf = np.unique(words, return_counts=True)
        d = np.array([df[t] for t in terms.tolist()], float)
        idf = np.log(1 + (total - d + 0.5) / (d + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        question, answer = (_hashes(x) for x in split_item(text))
        rows.append((terms, impact / impact.sum()))
        questions.append(_grams(question if len(question) else words, n))
        answers.append(_grams(answer, min(n, ANSWER_GRAM)))
        ids.append(item_id)
        most = max(most, len(words))
    none = np.zeros(0, np.int64)
    terms = np.unique(np.concatenate([t for t, _ in rows])) if rows else np.zeros(0, np.uint64)
    at = np.concatenate([np.searchsorted(terms, t) for t, _ in rows]) if rows else none
    item = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]) if rows else none
    impact = np.concatenate([x for _, x in rows]) if rows else none.astype(float)
    order = np.lexsort((item, at))
    at, item, impact = at[order], item[order], impact[order]
    blocks = max(-(-len(rows) // BLOCK), 1)
    keys = at * blocks + item // BLOCK
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else none
    top = np.maximum.reduceat(impact, np.searchsorted(at, np.arange(len(terms)))) if len(terms) else impact
    block_first = np.searchsorted(keys[first], np.arange(len(terms) + 1) * blocks)
    return Index(ids, terms, top, keys[first], block_first, (keys[first] % blocks).astype(np.int32), np.maximum.reduceat(impact, first) if len(first) else impact, at * len(rows) + item, impact, questions, answers, most)


def width(words: int) -> int:
    """The class of an item by its number of words: the next power of two. Its windows are twice as wide and begin at every multiple of it, so each place that the item may take lies in one."""
    return max(LEAST_WIDTH, 1 << max(words - 1, 0).bit_length())


def build_classes(items: list[tuple[int, str]], stats: tuple[int, float, dict[int, int]], n: int) -> list[tuple[int, Index]]:
    """(width, index) of each class of lengths in a shard of items."""
    classes: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        if words := len(_hashes(item[1])):
            classes.setdefault(width(words), []).append(item)
    return [(w, build(classes[w], stats, n)) for w in sorted(classes)]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges given by their starts and sizes, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


def _summed(keys: np.ndarray, values: np.ndarray, terms: np.ndarray, size: int, which: np.ndarray) -> np.ndarray:
    """For each of which (blocks or items), the sum of the values under (term, it)."""
    out = np.zeros(len(which))
    for a in range(0, len(which), 4096):
        asked = terms[:, None] * size + which[None, a : a + 4096]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out[a : a + 4096] = np.where(keys[at] == asked, values[at], 0.0).sum(axis=0)
    return out


def retrieve(index: Index, words: np.ndarray, starts: np.ndarray, stops: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of all pairs at or above the threshold; passages are ranges of words."""
    if not len(index.terms):
        return
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    before = np.concatenate(([0], np.cumsum(known)))
    term = at[known]
    # a passage's distinct known words
    n = before[stops] - before[starts]
    owner = np.repeat(np.arange(len(starts)), n)
    which = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before[starts], n)
    pair = np.unique(owner.astype(np.int64) << 32 | term[which])
    owner, term = pair >> 32, pair & 0xFFFFFFFF
    if not len(pair):
        return
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(owner))
    # most passages end here: all their terms together can't reach the threshold in any item
    low = threshold - 1e-9
    open_ = np.add.reduceat(index.top[term], first) >= low
    keep = np.repeat(open_, last - first)
    owner, term = owner[keep], term[keep]
    starts_at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    for i in range(0, len(starts_at), PORTION):
        part = slice(starts_at[i], starts_at[i + PORTION] if i + PORTION < len(starts_at) else len(owner))
        yield from _portion(index, owner[part], term[part], low)


def _portion(index: Index, owner: np.ndarray, term: np.ndarray, low: float) -> Iterator[tuple[int, int, float]]:
    """retrieve for some passages at once: owner is the passage of each of the distinct terms, ascending."""
    blocks = index.blocks
    top = index.top[term]
    order = np.lexsort((top, owner))
    owner, term, top = owner[order], term[order], top[order]
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    number = np.cumsum(first) - 1
    sums = np.cumsum(top)
    sums -= (sums - top)[first][number]
    sizes = index.block_first[term + 1] - index.block_first[term]
    # from the pivot on: a block without any of these terms can't reach the threshold
    rare = sums >= low
    near = np.unique(np.repeat(number[rare], sizes[rare]) * blocks + index.block_of[_ranges(index.block_first[term[rare]], sizes[rare])])
    lists = _ranges(index.block_first[term], sizes)
    keys = np.repeat(number, sizes) * blocks + index.block_of[lists]
    if (number[-1] + 1) * blocks <= 1 << 22:
        bound = np.bincount(keys, index.block_max[lists], (number[-1] + 1) * blocks)[near]
    else:
        at = np.minimum(np.searchsorted(near, keys), len(near) - 1)
        hit = near[at] == keys
        bound = np.bincount(at[hit], index.block_max[lists[hit]], len(near))
    near = near[bound >= low]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(owner))
    passages = near // blocks
    for n in np.unique(passages):
        own = term[begin[n] : end[n]]
        items = ((near[passages == n] % blocks)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        items = items[items < len(index.ids)]
        score = _summed(index.item_keys, index.impact, own, len(index.ids), items)
        for i in np.flatnonzero(score >= low):
            yield int(owner[begin[n]]), int(items[i]), float(score[i])


def _share(part: np.ndarray, grams: np.ndarray) -> float:
    return float(np.isin(part, grams, assume_unique=False).mean()) if len(part) else 1.0


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, n: int = 5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row for each row of docs and item that its text leaks.

    score is the item's BM25 score against the best passage, as a share of its score against itself, and reaches threshold; the passage holds at least overlap of
    the item's question n-grams and of its answer's (an answer of one or two words must be there as it is; an item without a separate answer has only a question). Words are compared with A-Z
    lower-cased and without punctuation around them. Of passages of a text that leak an item the best by (score, overlaps) counts; ties give one row. Null or blank texts match nothing, null, blank or
    repeated items are indexed once or not at all. Repeated rows of docs give repeated results. Empty tables give an empty one. Other columns of either table are ignored. The benchmark is
    indexed in shards of bounded size; each is broadcast by itself.
    """
    spark = docs.sparkSession
    shape = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and trim(text) <> ''").distinct()
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    counted = items.agg(F.count("*"), F.sum(words), F.avg(words)).first()
    if not counted[0]:
        return spark.createDataFrame([], shape)
    shards = max(1, -(-counted[1] * WORD_BYTES // INDEX_BYTES))
    items = write_shared(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    df = write_shared(frequencies(items), "frequencies") if shards > 1 else frequencies(items)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for s in range(shards):  # the driver holds one shard's items and their terms' frequencies at a time
        part = items.filter(F.col("shard") == s)
        own = {np.uint64(t & (2**64 - 1)).item(): n for t, n in (df if shards == 1 else df.join(frequencies(part).select("term"), "term", "left_semi")).collect()}
        shared = spark.sparkContext.broadcast(build_classes([tuple(r) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()], (counted[0], counted[2], own), n))
        found = texts.mapInArrow(_searcher(shared, threshold, n, overlap), shape)
        if shards > 1:
            found = write_shared(found, "found")
            shared.unpersist()
        out = found if out is None else out.union(found)
    return out


def _leaks(index: Index, step: int, words: np.ndarray, before: np.ndarray, threshold: float, n: int, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, overlaps) of what the rows of words leak of an index, by their windows [i * step, (i + 2) * step); the best window of each."""
    count = np.diff(before)
    windows = np.where(count > 0, np.maximum(1, -(-(count - step) // step)), 0)
    owner = np.repeat(np.arange(len(count)), windows)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = before[owner] + i * step
    stops = np.minimum(starts + 2 * step, before[owner + 1])
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    held, grams = -1, None
    for p, item, score in retrieve(index, words, starts, stops, threshold):
        if p != held:
            held, window = p, words[starts[p] : stops[p]]
            grams = np.concatenate([H.runs_hash(window, k) for k in range(1, n + 1) if k <= len(window)])
        q, a = _share(index.question[item], grams), _share(index.answer[item], grams)
        key = (int(owner[p]), item)
        if q >= overlap and a >= overlap and (score, q, a) > best.get(key, (0.0, 0.0, 0.0)):
            best[key] = (score, q, a)
    for (row, item), found in best.items():
        yield row, index.ids[item], *found


def _searcher(shared, threshold: float, n: int, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids = b["doc_id"].to_pylist()
            for row0, data, offsets in H.chunks(b["text"], _PIECE):
                words, before = _words(data, offsets)
                if not len(words):
                    continue
                found = [x for step, index in shared.value for x in _leaks(index, step, words, before, threshold, n, overlap)]
                rows += [(ids[row0 + r], *x) for r, *x in sorted(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no leak, with all their columns, whatever their names.

    Every row is told by its text, whatever its doc_id: rows with equal texts stay or go together, and null texts stay. Only texts that may have to go are
    shuffled.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    leaks = write_shared(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leak_key")).distinct(), "leaks")
    present = hash_filter(leaks, "leak_key")
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("row_key"))
    maybe = source.filter(present(F.col("row_key"))).join(leaks, F.col("row_key") == F.col("leak_key"), "left_anti")
    return source.filter(~present(F.col("row_key"))).select("row").union(maybe.select("row")).select("row.*")
