"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 64-bit hashes. Counts, continuation counts, context totals and probabilities are tables
sharded by hash, made and joined by Spark, and grow with the trusted text. The logarithm of a text's probability is a sum over keys of its words:

* for each word ln P(w), above that of a word never seen,
* for each context that was seen ln gamma, the weight of the next lower order,
* for each n-gram that was seen ln P(w | context) less ln gamma and the lower order's ln P(w).

What is not in the model adds nothing, so scoring is one join of (text, key, count) with the model's (key, value). The HOT most used keys, a fixed
number, are broadcast and added up in the scan, so that no key is hot in the join; a bounded bitmap keeps most keys that the model lacks out of it.
Fold by fold a model is trained, its texts are scored in SLICES parts, and what a step took on disk is deleted, so that the tables of one fold and the
shuffles of one step lie there at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import dense_bitmap, id_filter, in_bitmap, released_shuffles, scratch, write_shared

ORDER = 2
#: Most keys whose values are broadcast (12 MB), whatever the size of the model.
HOT = 1 << 20
#: Most rows of a table of words or contexts that are broadcast in training, the most used first; the others are joined.
MOST_USED = 1 << 19
#: Languages whose thresholds are broadcast at most; with more, they are joined by language.
MAX_LANGUAGES = 10_000
#: N-grams of a task that are counted at once.
HELD = 2_000_000
#: The word that stands in front of every text.
START = np.uint64(0x5EED)
#: Parts of the documents. Each is scored by a model of the trusted texts of all others, so no text by a model that was trained on it.
FOLDS = 2
#: Parts of a fold's texts that are scored one after the other: all are, but the keys of one part only are on disk at a time.
SLICES = 2

# The primes of XXH64 and the seed of Spark's xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def keys(*columns: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for bigint columns, as unsigned numbers."""
    out = np.full(len(columns[0]), _SEED, np.uint64)
    for c in columns:
        out = out + _P5 + np.uint64(8)
        out ^= _turned(c * _P2, 31) * _P1
        out = _turned(out, 27) * _P1 + _P4
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out


def _windows(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row, the order words up to and with it) of every word, by portions; START stands before a text's first word."""
    for row0, data, offsets in H.chunks(column):
        starts, ends, before = H.word_spans(data, offsets)
        if not len(starts):
            continue
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        at = np.arange(len(starts)) + (row + 1) * (order - 1)
        line = np.full(len(starts) + (len(offsets) - 1) * (order - 1), START, np.uint64)
        line[at] = H.word_hashes(data, starts, ends)
        yield row + row0, [line[at - j] for j in range(order - 1, -1, -1)]


def _names(order: int) -> list[str]:
    return [f"w{j}" for j in range(1, order + 1)]


def count(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(w1 .. wn, c) of all texts; each task adds up before the shuffle."""
    names = _names(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            _, first, c = np.unique(keys(*words), return_index=True, return_counts=True)
            order_ = np.argsort(words[0][first], kind="stable")  # equal words side by side take less in the shuffle's files
            first, c = first[order_], c[order_]
            return pa.RecordBatch.from_arrays([*(pa.array(w[first].view(np.int64)) for w in words), pa.array(c)], names=[*names, "c"])

        for b in batches:
            for _, words in _windows(b["text"], order):
                held.append(words)
                n += len(words[0])
                if n > HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return texts.select("text").mapInArrow(run, ", ".join(f"{x} bigint" for x in names) + ", c bigint").groupBy(*names).agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """The three discounts of a table of counts c, from its counts of counts; fixed ones where these are missing."""
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    found = (1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 0.75), (3, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return [min(max(v, 0.05), i) for i, v in found]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _heat(uses: Column) -> Column:
    return F.floor(F.log2(uses) * 8).cast("int")


def _hot(model: DataFrame, most: int) -> int:
    """The lowest heat from which on the model has at most so many keys. There are some 500 heats, whatever its size."""
    known, cut = 0, None
    for heat, n in sorted(((r[0], r[1]) for r in model.groupBy(_heat(F.col("uses"))).count().collect()), reverse=True):
        if known + n > most:
            break
        known, cut = known + n, heat
    return cut if cut is not None else 1 << 20


def _looked_up(rows: DataFrame, side: DataFrame, on: list[str], most: int) -> DataFrame:
    """rows joined with side, which has one row for each value of on and how much it is used.

    The most used rows of side, of a bounded number, are broadcast; only what they miss is shuffled, so no key is hot. rows is read twice.
    """
    cut = _hot(side, most)
    heat, plain = _heat(F.col("uses")), side.drop("uses")
    hot = F.broadcast(side.filter(heat >= cut).drop("uses"))
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(side.filter(heat < cut).select(*plain.columns), on))


def train(texts: DataFrame, order: int = ORDER, most_used: int = MOST_USED, folder: str | None = None) -> tuple[DataFrame, float]:
    """The model of (text) rows: a table (key, value, uses), written to the shared folder or that given, and ln P of a word never seen.

    Of texts without any word, or no texts, the table is empty and ln P is 0.
    """
    with released_shuffles(texts.sparkSession), scratch(texts.sparkSession) as own:
        return _trained(texts, order, most_used, own, folder)


def _trained(texts: DataFrame, order: int, most_used: int, own: str, folder: str | None) -> tuple[DataFrame, float]:
    names = _names(order)
    counts = {order: write_shared(count(texts, order), "grams", own)}
    for k in range(order - 1, 0, -1):
        # in how many contexts, one word longer to the left, does it stand
        lower = counts[k + 1].groupBy(*(F.col(names[j]).alias(names[j - 1]) for j in range(1, k + 1))).agg(F.count("*").alias("c"))
        counts[k] = write_shared(lower, "grams", own)
    d = discounts(counts[1])
    types, total, held = counts[1].agg(F.count("*"), F.sum("c"), F.sum(_discount(d))).first()
    unseen = held / total / (types + 1) if types else 1.0  # the lowest order: all words known, and one unknown, alike
    p = counts[1].select("w1", F.col("c").alias("uses"), ((F.col("c") - _discount(d)) / F.lit(float(total or 1)) + F.lit(unseen)).alias("p"))
    parts = [p.select(F.xxhash64("w1").alias("key"), F.log(F.col("p") / F.lit(unseen)).alias("value"), "uses")]
    for k in range(2, order + 1):
        d = discounts(counts[k])
        context = names[: k - 1]
        contexts = write_shared(counts[k].groupBy(*context).agg(F.sum("c").alias("total"), (F.sum(_discount(d)) / F.sum("c")).alias("gamma")), "contexts", own)
        shorter = p.select(*(F.col(names[j - 1]).alias(names[j]) for j in range(1, k)), F.col("p").alias("q"), "uses")
        rows = _looked_up(counts[k], contexts.withColumn("uses", F.col("total")), context, most_used)
        rows = _looked_up(rows, shorter, names[1:k], most_used)
        p = rows.select(*names[:k], F.col("c").alias("uses"), "gamma", "q", ((F.col("c") - _discount(d)) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
        if k < order:
            p = write_shared(p, "probabilities", own)
        parts.append(p.select(F.xxhash64(*names[:k]), F.log(F.col("p") / F.col("gamma") / F.col("q")), "uses"))
        parts.append(contexts.select(F.xxhash64(F.lit(-1).cast("bigint"), *context), F.log("gamma"), "total"))
    model = parts[0]
    for part in parts[1:]:
        model = model.union(part)
    return write_shared(model.select("key", F.col("value").cast("float").alias("value"), "uses"), "model", folder), float(np.log(unseen))


def _finder(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Where each key stands in known, all different, which is sorted by the lowest bits of its keys (_slots); -1 if nowhere."""
    if not len(known):
        return lambda key: np.full(len(key), -1)
    first = np.zeros(_slots(len(known)) + 1, np.int32)
    np.cumsum(np.bincount((known & np.uint64(len(first) - 2)).view(np.int64), minlength=len(first) - 1), out=first[1:])

    def find(key: np.ndarray) -> np.ndarray:
        slot = (key & np.uint64(len(first) - 2)).view(np.int64)
        at, end = first[slot], first[slot + 1]
        found, open_ = np.full(len(key), -1), np.flatnonzero(at < end)
        at, end, key = at[open_], end[open_], key[open_]
        while len(open_):
            hit = known[at] == key
            found[open_[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            open_, at, end, key = open_[on], at[on] + 1, end[on], key[on]
        return found

    return find


def _slots(n: int) -> int:
    return 1 << max(2 * n - 1, 1).bit_length()


def _scorer(model: DataFrame, least: float, order: int, most_hot: int) -> tuple[Callable[[DataFrame], DataFrame], list[Broadcast]]:
    """What makes (tid, n_words, ln), a row for each text with the logarithm of its probability, of rows (tid, text), and what is broadcast for it."""
    cut = _hot(model, most_hot)
    hot = model.filter(_heat(F.col("uses")) >= cut).select("key", "value").toArrow()
    cold = model.filter(_heat(F.col("uses")) < cut).select("key", "value")
    known = hot["key"].to_numpy().view(np.uint64)
    ranks = np.argsort(known & np.uint64(_slots(len(known)) - 1), kind="stable")
    shared = model.sparkSession.sparkContext.broadcast((known[ranks], hot["value"].to_numpy().astype(np.float32)[ranks]))
    bitmap, mask = dense_bitmap(cold, "key")

    def asked(batches):
        """A row (c words, sum of the hot keys' values) for each text, and (key, c) without a sum for other keys that the model may have."""
        known, values = shared.value
        bits, find = bitmap.value, _finder(known)
        for at, b in enumerate(batches):
            tids = b["tid"].to_numpy()
            n, local = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for row, words in _windows(b["text"], order):
                m = np.bincount(row, minlength=b.num_rows)
                n += m
                local += m * least
                rows, rest = [], []
                ahead = [np.full(len(row), -1, np.int64).view(np.uint64)]
                for parts in [words[order - k :] for k in range(1, order + 1)] + [ahead + words[order - k : order - 1] for k in range(2, order + 1)]:
                    key = keys(*parts)
                    found = find(key)
                    hit = found >= 0
                    local += np.bincount(row[hit], weights=values[found[hit]], minlength=b.num_rows)
                    maybe = np.flatnonzero(~hit)
                    maybe = maybe[in_bitmap(bits, key[maybe].view(np.int64) & mask)]
                    rows.append(row[maybe])
                    rest.append(key[maybe])
                row, key = np.concatenate(rows), np.concatenate(rest)
                order_ = np.lexsort((key, row))
                row, key = row[order_], key[order_]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else np.zeros(0, np.int64)
                c = np.diff(np.append(first, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(tids[row[first]]), pa.array(key[first].view(np.int64)), pa.array(c.astype(np.int32)), pa.nulls(len(first), pa.float64())], names=names)
            # keys of their own deal these rows out evenly, whatever number of texts is empty
            apart = H.mix(tids.view(np.uint64) + np.arange(b.num_rows, dtype=np.uint64) + np.uint64(at << 32))
            yield pa.RecordBatch.from_arrays([pa.array(tids), pa.array(apart.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(local)], names=names)

    names = ["tid", "key", "c", "local"]

    def score(texts: DataFrame) -> DataFrame:
        found = texts.mapInArrow(asked, "tid bigint, key bigint, c int, local double").join(cold, "key", "left")
        own = F.col("local").isNotNull()
        joined = F.sum(F.when(~own, F.col("c") * F.col("value").cast("double")))
        # each row of a text has added its keys to the sum
        ln = F.coalesce(joined, F.lit(0.0)) / F.count("local") + F.max("local")
        return found.groupBy("tid").agg(F.max(F.when(own, F.col("c").cast("bigint"))).alias("n_words"), ln.alias("ln"))

    return score, [shared, bitmap]


def perplexities(docs: DataFrame, models: list[tuple[DataFrame, float]], order: int = ORDER, most_hot: int = HOT) -> DataFrame:
    """(doc_id, lang, n_words, perplexity) of every row of docs (doc_id, lang, text, fold) under the model of number fold.

    Texts without a word have no perplexity. Scores belong to texts (of a fold), told apart by 64-bit hashes: rows of one text share theirs, be
    their doc_id null, equal or different. Each fold's scores are written before those of the next are begun.
    """
    return _all(_fold_scores(docs.filter(F.col("fold") == fold), model, order, most_hot) for fold, model in enumerate(models))


def _fold_scores(docs: DataFrame, model: tuple[DataFrame, float], order: int, most_hot: int = HOT) -> DataFrame:
    """perplexities of all docs under one model."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("tid"), "text")
    with released_shuffles(docs.sparkSession), scratch(docs.sparkSession) as own:
        score, held = _scorer(*model, order, most_hot)
        texts = rows.select("tid", "text")
        found = _all(write_shared(score(texts.filter(F.pmod("tid", F.lit(SLICES)) == i)), "sums", own) for i in range(SLICES))
        scores = rows.drop("text").join(found, "tid").select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("ln") / F.col("n_words"))).alias("perplexity"))
        scores = write_shared(scores, "scores")
    for broadcast in held:
        broadcast.destroy()
    return scores


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 30, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) for every row of docs (doc_id, text, lang).

    Trusted are all documents with quality 1 and not toxic on each of their rows of labels. All documents are parted in two folds by a hash of the doc_id,
    and each fold is scored by the model of all trusted texts of the other one. A language's threshold is the quantile of its trusted documents'
    perplexities. Languages with fewer than `least` trusted documents, and null ones, take the largest of the quantile of all and those of the languages
    that have one. Without any trusted document all with a word are kept. Ties with the threshold are kept. Null and empty texts have no perplexity and are not
    kept. Repeated rows are judged each; other columns are ignored; an empty table gives an empty one.
    """
    with released_shuffles(docs.sparkSession), scratch(docs.sparkSession) as folder:
        scores, cuts, overall = _judged(docs, labels, quantile, least, order, folder)
        few = cuts.count() <= MAX_LANGUAGES
    by_lang = cuts.filter("whole = 0").select("lang", "threshold")
    by_lang = F.broadcast(by_lang) if few else by_lang
    threshold = F.coalesce("threshold", F.lit(overall if overall is not None else float("inf")))
    return scores.join(by_lang, "lang", "left").select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, least: int, order: int, folder: str) -> tuple[DataFrame, DataFrame, float | None]:
    """classify's scores, its thresholds (lang, threshold, whole) and the largest of these."""
    good = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    good = write_shared(good.select("doc_id"), "trusted", folder)
    fold = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FOLDS)).cast("int")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").withColumn("fold", fold)
    present = id_filter(good, "doc_id")
    parts = []
    for i in range(FOLDS):
        with scratch(docs.sparkSession) as own:
            with scratch(docs.sparkSession) as texts:
                others = source.filter(F.col("fold") != i).filter(present(F.col("doc_id"))).join(good, "doc_id")
                model = train(write_shared(others.select("text"), "trusted-texts", texts), order, folder=own)
            parts.append(_fold_scores(source.filter(F.col("fold") == i), model, order))
    scores = _all(parts)
    unseen = scores.filter("perplexity is not null").join(good, "doc_id")
    cuts = unseen.rollup("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold"), F.count("*").alias("n"), F.grouping("lang").alias("whole"))
    # a row for each language at most; the number is checked before they are sent to all
    cuts = write_shared(cuts.filter((F.col("whole") == 1) | (F.col("n") >= least) & F.col("lang").isNotNull()).select("lang", "threshold", "whole"), "cuts")
    return scores, cuts, cuts.agg(F.max("threshold")).first()[0]
