"""Word vectors by continuous bag of words with negative sampling, some of them frozen.

Texts are dealt into shards of a bounded number of tokens. In a pass each shard's task gets its texts and the vectors of its own words only, trains on copies of them,
and returns them; a word's new vectors are the means over its shards, weighted by how often each has it. So what a task holds and what is shuffled is
bounded by a shard's vocabulary, and no table of all words is ever in one place. Frozen words keep their input vector bit for bit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Tokens of a shard, about, and of a piece that a longer text is cut into; windows end at a piece's ends.
SHARD_TOKENS = 200_000
PIECE = 10_000
#: Places that are trained on at once, and the power of a word's count that it is drawn by as a negative.
BATCH = 64
POWER = 0.75
_VECTORS = "word string, c bigint, frozen boolean, vin array<float>, vout array<float>"
_NAMES = ["word", "c", "frozen", "vin", "vout"]


def first_vector(word: str, dim: int, seed: int) -> np.ndarray:
    return ((np.random.default_rng([seed, zlib.crc32(word.encode())]).random(dim) - 0.5) / dim).astype(np.float32)


def train_shard(tokens: list[np.ndarray], vin: np.ndarray, vout: np.ndarray, counts: np.ndarray, open_: np.ndarray, window: int, negative: int, alpha: float, rng: np.random.Generator) -> None:
    """Changes vin (only rows where open_) and vout by one pass over tokens, arrays of word numbers."""
    ids = np.concatenate(tokens)
    piece = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    share = np.cumsum(counts.astype(float) ** POWER)
    offsets = np.array([o for o in range(-window, window + 1) if o])
    for a in range(0, len(ids), BATCH):
        at = np.arange(a, min(a + BATCH, len(ids)))
        near = at[:, None] + offsets
        inside = (near >= 0) & (near < len(ids))
        near = np.where(inside, near, 0)
        inside &= (piece[near] == piece[at][:, None]) & (np.abs(offsets) <= rng.integers(1, window + 1, len(at))[:, None])
        some = inside.any(axis=1)
        at, near, inside = at[some], near[some], inside[some]
        if not len(at):
            continue
        context, n = ids[near], inside.sum(axis=1, keepdims=True)
        hidden = (vin[context] * inside[:, :, None]).sum(axis=1) / n
        drawn = np.searchsorted(share, rng.random((len(at), negative)) * share[-1], side="right")
        target = np.concatenate([ids[at][:, None], np.minimum(drawn, len(share) - 1)], axis=1)
        label = np.zeros(target.shape)
        label[:, 0] = 1
        valid = (target != target[:, :1]) | (label == 1)  # a negative that is the word itself counts as none
        out = vout[target]
        score = 1 / (1 + np.exp(-np.clip((out * hidden[:, None]).sum(axis=2), -30, 30)))
        g = (label - score) * valid * alpha
        back = (g[:, :, None] * out).sum(axis=1) / n
        np.add.at(vout, target, (g[:, :, None] * hidden[:, None]).astype(np.float32))
        np.add.at(vin, context, (back[:, None] * (inside & open_[context])[:, :, None]).astype(np.float32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.float32()), pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _trainer(dim: int, window: int, negative: int, alpha: float, seed: int, number: int):
    def trained(shard: int, words: list[tuple], texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        place = {w[0]: i for i, w in enumerate(words)}
        vin, vout = (np.array([w[k] for w in words], np.float32).reshape(len(words), dim) for k in (3, 4))
        tokens = [np.array([place[t] for t in text]) for text in texts]
        counts, locked = np.array([w[1] for w in words]), np.array([w[2] for w in words])
        train_shard(tokens, vin, vout, counts, ~locked, window, negative, alpha, np.random.default_rng([seed, number, shard]))
        for a in range(0, len(words), 5_000):
            yield _batch([(*w[:3], i, o) for w, i, o in zip(words[a : a + 5_000], vin[a : a + 5_000], vout[a : a + 5_000], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, texts = None, [], []
        for b in batches:
            for shard, kind, word, c, frozen, vin, vout, tokens in zip(*(b[n].to_pylist() for n in ("shard", "kind", *_NAMES, "tokens")), strict=True):
                if shard != held:
                    if texts:
                        yield from trained(held, words, texts)
                    held, words, texts = shard, [], []
                if kind:
                    texts.append(tokens)
                else:
                    words.append((word, c, frozen, vin, vout))
        if texts:
            yield from trained(held, words, texts)

    return run


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one word follow each other: its vectors' means by count; a frozen input vector stays as it is."""
    held, total, frozen, vin, vout, done = None, 0, False, None, None, []

    def row() -> tuple:
        return held, total, frozen, vin if frozen else (vin / total).astype(np.float32), (vout / total).astype(np.float32)

    for b in batches:
        for word, c, lock, i, o in zip(*(b[n].to_pylist() for n in _NAMES), strict=True):
            i, o = np.asarray(i, np.float32 if lock else float), np.asarray(o, float) * c
            if word != held:
                if held is not None:
                    done.append(row())
                    if len(done) == 5_000:
                        yield _batch(done)
                        done = []
                held, total, frozen, vin, vout = word, c, lock, i if lock else i * c, o
            else:
                total, vout = total + c, vout + o
                vin = vin if lock else vin + i * c
    if held is not None:
        done.append(row())
        yield _batch(done)


def word_vectors(texts: DataFrame, dim: int = 300, window: int = 10, negative: int = 5, passes: int = 20, alpha: float = 0.025, min_alpha: float = 0.001, frozen: DataFrame | None = None, seed: int = 7541) -> DataFrame:
    """(word, n, vector) of all words of texts (tokens): n is how often a word occurs. The rate falls from alpha by equal steps towards min_alpha.

    frozen (word, vector) gives words of texts their input vectors, of width dim, which then stay. Null texts have no tokens, null and empty tokens are left out; texts over PIECE tokens are trained on in pieces. Repeated texts count
    each. No texts give no words. The same tables, as files, and seed give the same vectors.
    """
    pieces = texts.select(F.filter("tokens", lambda t: t.isNotNull() & (t != "")).alias("t")).filter("size(t) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(t) - 1) div {PIECE} as int)")), lambda i: F.slice("t", i * PIECE + 1, PIECE))
    pieces = stored(pieces.select(F.explode(cut).alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = pieces.agg(F.sum(F.size("tokens"))).first()[0] or 0
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // SHARD_TOKENS)))))
    need = stored(pieces.select("shard", F.explode("tokens").alias("word")).groupBy("shard", "word").agg(F.count("*").alias("c")), "shard-words")

    @F.pandas_udf("array<float>")
    def begin(words):
        return words.map(lambda w: first_vector(w, dim, seed))

    known = need.groupBy("word").agg(F.sum("c").alias("n"))
    if frozen is None:
        vectors = known.select("word", "n", F.lit(False).alias("frozen"), begin("word").alias("vin"))
    else:
        fixed = frozen.groupBy("word").agg(F.min("vector").cast("array<float>").alias("given"))
        vectors = known.join(fixed, "word", "left").select("word", "n", F.col("given").isNotNull().alias("frozen"), F.coalesce("given", begin("word")).alias("vin"))
    vectors = stored(vectors.withColumn("vout", F.array_repeat(F.lit(0.0).cast("float"), dim)), "vectors")
    for number in range(passes):
        rate = alpha - number * (alpha - min_alpha) / passes
        words = need.join(vectors.drop("n"), "word").select("shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("row"), *_NAMES, F.lit(None).cast("array<string>").alias("tokens"))
        rows = pieces.select("shard", F.lit(1).alias("kind"), "row", *(F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in _VECTORS.split(", ")), "tokens")
        dealt = words.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "kind", "word", "row")
        moved = dealt.select("shard", "kind", *_NAMES, "tokens").mapInArrow(_trainer(dim, window, negative, rate, seed, number), _VECTORS)
        mean = moved.repartition("word").sortWithinPartitions("word", "c", "vin", "vout").mapInArrow(_means, _VECTORS)
        vectors = stored(mean.withColumnRenamed("c", "n"), "vectors")
    return vectors.select("word", "n", F.col("vin").alias("vector"))
