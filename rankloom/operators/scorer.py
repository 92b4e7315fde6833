"""The matrix scorer over whole Arrow batches, and its training by gradients that Spark sums.

A document's matrix has a row for each query term. Filters of several shapes run over it (1 x 1 stands for the matrix itself); at each cell the largest filter counts.
Of every prefix in the cascade the k largest cells of a row are kept, with the context's values at the same places, and with the terms' softmax weights they
go into dense layers or an LSTM over the rows. Training draws pairs, scores both sides and lowers -log of the relevant document's softmax share. A step is one Spark job:
tasks return the gradients of their rows, a second round of tasks sums them, and the driver holds the weights and Adam's two moments, which don't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settings import cascade, filter_sizes
from .shared import stored

#: Bytes of filter windows that a task makes at once.
WINDOW_BYTES = 32 << 20
#: Blocks that the draws are dealt into; a block's gradient is summed in the order of its draws, and blocks in their own.
BLOCKS = 64
#: Adam's decay rates and its guard against division by zero.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7


@dataclass(frozen=True)
class Shape:
    """What the scorer is made of: rows x columns of its matrices, filters by winlen, proximity and extra shapes as in experiment settings, prefixes in percent, and the head (0: LSTM)."""

    rows: int = 16
    columns: int = 800
    winlen: int = 3
    proximity: int = 0
    extra: str = ""
    filters: int = 32
    kmax: int = 3
    prefixes: tuple[int, ...] = ()
    context: bool = False
    combine: int = 32
    sizes: tuple[tuple[int, int], ...] = field(init=False)
    cuts: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        if any(not 0 < p <= 100 for p in self.prefixes):
            raise ValueError("prefixes are percents from 1 to 100")
        if self.combine < 0:
            raise ValueError("combine is 0 for the LSTM, or the width of the dense layers")
        by_width = filter_sizes(self.winlen, self.rows, self.proximity, self.extra)
        object.__setattr__(self, "sizes", tuple(s for w in sorted(by_width) for s in by_width[w]))
        object.__setattr__(self, "cuts", tuple(cascade(list(self.prefixes), self.columns)))

    @property
    def width(self) -> int:
        """Signals of a row: its weight, and of each filter shape the k largest cells of each prefix, and as many of the context."""
        return 1 + len(self.sizes) * len(self.cuts) * self.kmax * (1 + self.context)

    def weights(self, seed: int = 7541) -> dict[str, np.ndarray]:
        """Uniform weights of Glorot's range, zero biases; the LSTM's forget gate begins at one."""
        rng = np.random.default_rng(seed)

        def uniform(fan_in: int, fan_out: int, *shape: int) -> np.ndarray:
            limit = np.sqrt(6 / (fan_in + fan_out))
            return rng.uniform(-limit, limit, shape)

        out = {}
        for a, b in self.sizes:
            if (a, b) != (1, 1):
                out |= {f"conv{a}x{b}": uniform(a * b, a * b * self.filters, a * b, self.filters), f"bias{a}x{b}": np.zeros(self.filters)}
        if self.combine:
            n, c = self.rows * self.width, self.combine
            return out | {"d1": uniform(n, c, n, c), "b1": np.zeros(c), "d2": uniform(c, c, c, c), "b2": np.zeros(c), "d3": uniform(c, 1, c, 1), "b3": np.zeros(1)}
        return out | {"input": uniform(self.width, 4, self.width, 4), "state": uniform(1, 4, 4), "bias": np.array([0.0, 1.0, 0.0, 0.0])}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _hard(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


def _windows(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A view (documents, rows, columns, a, b) of the cells around each cell, zeros outside; of an even size the larger part lies behind."""
    padded = np.pad(x, ((0, 0), ((a - 1) // 2, a // 2), ((b - 1) // 2, b // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, (a, b), axis=(1, 2))


def _cells(x: np.ndarray, w: dict, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest filter at each cell after the rectifier, and which it is; a few documents at a time."""
    n, rows, cols = x.shape
    out, which = np.empty(x.shape), np.empty(x.shape, np.int32)
    step = max(1, WINDOW_BYTES // (8 * rows * cols * (a * b + len(w[f"bias{a}x{b}"]))))
    for i in range(0, n, step):
        part = _windows(x[i : i + step], a, b).reshape(-1, a * b) @ w[f"conv{a}x{b}"] + w[f"bias{a}x{b}"]
        best = part.argmax(axis=1)
        which[i : i + step] = best.reshape(-1, rows, cols)
        out[i : i + step] = np.maximum(part[np.arange(len(part)), best], 0).reshape(-1, rows, cols)
    return out, which


def forward(x: np.ndarray, idf: np.ndarray, w: dict, shape: Shape, context: np.ndarray | None = None, order: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """Scores of matrices x (documents, rows, columns) with term weights idf (documents, rows); order puts a document's rows of signals into another order. keep receives what backward needs."""
    n = len(x)
    signals, taken = [_softmax(idf)[:, :, None]], []
    for a, b in shape.sizes:
        cells, which = (x, None) if (a, b) == (1, 1) else _cells(x, w, a, b)
        places = []
        for cut in shape.cuts:
            k = min(shape.kmax, cut)
            at = np.argsort(-cells[:, :, :cut], axis=2, kind="stable")[:, :, :k]
            places.append(at)
        at = np.concatenate([np.pad(p, ((0, 0), (0, 0), (0, shape.kmax - p.shape[2])), constant_values=-1) for p in places], axis=2)
        there = at >= 0
        signals.append(np.where(there, np.take_along_axis(cells, np.maximum(at, 0), 2), 0.0))
        if shape.context:
            signals.append(np.where(there, np.take_along_axis(context, np.maximum(at, 0), 2), 0.0))
        taken.append((at, which, signals[-1 - shape.context]))
    s = np.concatenate(signals, axis=2)
    if order is not None:
        s = np.take_along_axis(s, order[:, :, None], 1)
    if shape.combine:
        flat = s.reshape(n, -1)
        h1 = np.maximum(flat @ w["d1"] + w["b1"], 0)
        h2 = np.maximum(h1 @ w["d2"] + w["b2"], 0)
        out, head = (h2 @ w["d3"] + w["b3"])[:, 0], (flat, h1, h2)
    else:
        h = c = np.zeros(n)
        head = []
        for t in range(shape.rows):
            z = s[:, t] @ w["input"] + h[:, None] * w["state"] + w["bias"]
            i, f, o, g = _hard(z[:, 0]), _hard(z[:, 1]), _hard(z[:, 3]), np.tanh(z[:, 2])
            before = (h, c)
            c = f * c + i * g
            h = o * np.tanh(c)
            head.append((z, i, f, o, g, c, *before))
        out = h
    if keep is not None:
        keep.extend((x, s, taken, head, order))
    return out


def backward(keep: list, grad: np.ndarray, w: dict, shape: Shape) -> dict[str, np.ndarray]:
    """The weights' gradients, summed over documents whose scores have the gradients grad."""
    x, s, taken, head, order = keep
    out = {}
    if shape.combine:
        flat, h1, h2 = head
        g3 = grad[:, None]
        out |= {"d3": h2.T @ g3, "b3": g3.sum(axis=0)}
        g2 = (g3 @ w["d3"].T) * (h2 > 0)
        out |= {"d2": h1.T @ g2, "b2": g2.sum(axis=0)}
        g1 = (g2 @ w["d2"].T) * (h1 > 0)
        out |= {"d1": flat.T @ g1, "b1": g1.sum(axis=0)}
        ds = (g1 @ w["d1"].T).reshape(s.shape)
    else:
        ds, dh, dc = np.zeros_like(s), grad, np.zeros(len(grad))
        out = {"input": np.zeros_like(w["input"]), "state": np.zeros(4), "bias": np.zeros(4)}
        slope = lambda z: 0.2 * ((z > -2.5) & (z < 2.5))
        for t in range(shape.rows - 1, -1, -1):
            z, i, f, o, g, c, h0, c0 = head[t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th * th)
            dz = np.stack([dc * g * slope(z[:, 0]), dc * c0 * slope(z[:, 1]), dc * i * (1 - g * g), dh * th * slope(z[:, 3])], axis=1)
            out["input"] += s[:, t].T @ dz
            out["state"] += h0 @ dz
            out["bias"] += dz.sum(axis=0)
            ds[:, t] = dz @ w["input"].T
            dh, dc = dz @ w["state"], dc * f
    if order is not None:
        back = np.empty_like(ds)
        np.put_along_axis(back, order[:, :, None], ds, 1)
        ds = back
    per, at_signal = len(shape.cuts) * shape.kmax, 1
    for (a, b), (at, which, value) in zip(shape.sizes, taken, strict=True):
        d = ds[:, :, at_signal : at_signal + per]
        at_signal += per * (1 + shape.context)
        if which is None:
            continue
        doc, row, j = np.nonzero((at >= 0) & (value > 0) & (d != 0))  # nothing flows where the rectifier is shut
        cell = at[doc, row, j]
        one = np.zeros((len(doc), shape.filters))
        one[np.arange(len(doc)), which[doc, row, cell]] = d[doc, row, j]
        out[f"conv{a}x{b}"] = _windows(x, a, b)[doc, row, cell].reshape(len(doc), a * b).T @ one
        out[f"bias{a}x{b}"] = one.sum(axis=0)
    return out


def pair_gradients(x: list[np.ndarray], idf: np.ndarray, w: dict, shape: Shape, context: list[np.ndarray] | None = None, order: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Summed loss and gradients of draws: x has the relevant documents' matrices, then those of each other side."""
    kept = [[] for _ in x]
    scores = np.stack([forward(m, idf, w, shape, None if context is None else context[k], order, kept[k]) for k, m in enumerate(x)], axis=1)
    share = _softmax(scores)
    loss = float(-np.log(np.maximum(share[:, 0], 1e-300)).sum())
    total: dict[str, np.ndarray] = {}
    for k, kept_k in enumerate(kept):
        for name, g in backward(kept_k, share[:, k] - (k == 0), w, shape).items():
            total[name] = total.get(name, 0) + g
    return loss, total


def _array(column: pa.Array, *shape: int) -> np.ndarray:
    """Nested lists of one shape as an array; nulls inside count as 0."""
    values = column
    while not pa.types.is_floating(values.type) and not pa.types.is_integer(values.type):
        values = values.flatten()
    out = values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    if out.size != len(column) * int(np.prod(shape)):
        raise ValueError(f"matrices or weights aren't of the scorer's shape {shape}")
    return out.reshape(len(column), *shape)


def score(pairs: DataFrame, weights: dict[str, np.ndarray], shape: Shape) -> DataFrame:
    """(qid, docno, sim) of pairs (qid, docno, matrix, idf) and context where the shape asks for it, scored a batch at a time. Matrices are padded to the shape; others are an error. Empty pairs give no rows."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    names = ["matrix", "idf", *(["context"] if shape.context else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                context = _array(b["context"], shape.rows, shape.columns) if shape.context else None
                sim = forward(_array(b["matrix"], shape.rows, shape.columns), _array(b["idf"], shape.rows), shared.value, shape, context)
                yield pa.RecordBatch.from_arrays([b["qid"], b["docno"], pa.array(sim)], names=["qid", "docno", "sim"])

    kinds = dict(pairs.dtypes)
    return pairs.select("qid", "docno", *names).mapInArrow(run, f"qid {kinds['qid']}, docno {kinds['docno']}, sim double")


def examples(drawn: DataFrame, pairs: DataFrame, context: bool = False) -> DataFrame:
    """(draw, idf, m0, m1[, c0, c1]) of drawn (draw, qid, positive, negative) with the matrices of pairs (qid, docno, matrix, idf[, context])."""
    extra = ["context"] if context else []
    side = lambda k: pairs.select("qid", F.col("docno").alias(("positive", "negative")[k]), F.col("matrix").alias(f"m{k}"), *([F.col("context").alias(f"c{k}")] if extra else []), *(["idf"] if k == 0 else []))
    return drawn.join(side(0), ["qid", "positive"]).join(side(1), ["qid", "negative"]).select("draw", "idf", "m0", "m1", *(["c0", "c1"] if extra else []))


def _flat(gradients: dict[str, np.ndarray], names: list[str], w: dict) -> np.ndarray:
    return np.concatenate([np.ravel(gradients.get(n, np.zeros_like(w[n]))) for n in names])


def _block(draw: Column) -> Column:
    return F.pmod(F.xxhash64(draw), F.lit(BLOCKS)).cast("int")


def train(data: DataFrame, shape: Shape, steps: int = 20, rate: float = 0.001, seed: int = 7541, shuffle: bool = False, weights: dict | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after steps of Adam over data (examples), and each step's mean loss. Step s takes the draws whose hash is s modulo steps, so the steps together see each draw once.

    The same data and seed give the same weights: blocks of draws are written in order once, and their gradients are summed in the order of blocks. shuffle puts the rows of a draw's
    signals into an order that draw and seed decide. Empty data, or a step without a draw, changes nothing.
    """
    spark, w = data.sparkSession, dict(shape.weights(seed) if weights is None else weights)
    names = sorted(w)
    rows = data.withColumns({"block": _block(F.col("draw")), "step": F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(steps)).cast("int")})
    rows = stored(rows.repartition(BLOCKS, "block").sortWithinPartitions("step", "block", "draw"), "examples")
    moment, square, losses = np.zeros(sum(x.size for x in w.values())), np.zeros(sum(x.size for x in w.values())), []
    fields = "block int, draw bigint, loss double, n bigint, gradient array<double>"

    def gradients(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for b in batches:
                blocks = b["block"].to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [b.num_rows])) if b.num_rows else [0]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    part = b.slice(i, j - i)
                    draws = part["draw"].to_numpy()
                    order = np.stack([np.random.default_rng([seed, int(d) & 0xFFFFFFFF]).permutation(shape.rows) for d in draws]) if shuffle else None
                    context = [_array(part[c], shape.rows, shape.columns) for c in ("c0", "c1")] if shape.context else None
                    loss, grad = pair_gradients([_array(part[c], shape.rows, shape.columns) for c in ("m0", "m1")], _array(part["idf"], shape.rows), weights, shape, context, order)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(blocks[i])], pa.int32()), pa.array([int(draws[0])], pa.int64()), pa.array([loss]), pa.array([int(j - i)], pa.int64()), pa.array([_flat(grad, names, weights)])], names=["block", "draw", "loss", "n", "gradient"]
                    )

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key, loss, n = None, None, 0.0, 0
        for b in batches:
            for block, draw, x, m, g in zip(b["block"].to_pylist(), b["draw"].to_pylist(), b["loss"].to_pylist(), b["n"].to_pylist(), b["gradient"], strict=True):
                g = g.values.to_numpy()
                total, key, loss, n = (g.copy() if total is None else total + g), key or (block, draw), loss + x, n + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([loss]), pa.array([n], pa.int64()), pa.array([total])], names=["block", "draw", "loss", "n", "gradient"])

    for step in range(steps):
        shared = spark.sparkContext.broadcast(w)
        found = rows.filter(F.col("step") == step).drop("step").mapInArrow(gradients(shared), fields)
        # a second round of tasks sums an eighth of the blocks each, so the driver gets eight vectors whatever the number of rows
        parts = found.withColumn("of", F.col("block") % 8).repartition(8, "of").sortWithinPartitions("of", "block", "draw").drop("of").mapInArrow(summed, fields).collect()
        shared.unpersist()
        n = sum(r.n for r in parts)
        if not n:
            continue
        parts.sort(key=lambda r: (r.block % 8, r.block, r.draw))
        gradient = np.sum([np.asarray(r.gradient) for r in parts], axis=0) / n
        losses.append(sum(r.loss for r in parts) / n)
        t = len(losses)
        moment = BETA1 * moment + (1 - BETA1) * gradient
        square = BETA2 * square + (1 - BETA2) * gradient**2
        change = rate * np.sqrt(1 - BETA2**t) / (1 - BETA1**t) * moment / (np.sqrt(square) + EPSILON)
        at = 0
        for name in names:
            size = w[name].size
            w[name] = w[name] - change[at : at + size].reshape(w[name].shape)
            at += size
    return w, losses
