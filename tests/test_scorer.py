"""The scorer against plain loops, its gradients against differences, and training on planted matches."""

import math

import numpy as np
import pytest

from rankloom.operators import representatives, scorer

PAIRS = "qid bigint, docno string, matrix array<array<float>>, idf array<double>, context array<array<float>>"


def by_loops(x, idf, w, shape, context=None, order=None):
    """One document's score, cell by cell."""
    rows, cols = x.shape
    e = [math.exp(v - max(idf)) for v in idf]
    signals = [[v / sum(e)] for v in e]
    for a, b in shape.sizes:
        cells = [[0.0] * cols for _ in range(rows)]
        for i in range(rows):
            for j in range(cols):
                if (a, b) == (1, 1):
                    cells[i][j] = x[i][j]
                    continue
                best = 0.0
                for f in range(shape.filters):
                    v = w[f"bias{a}x{b}"][f]
                    for p in range(a):
                        for q in range(b):
                            y, z = i + p - (a - 1) // 2, j + q - (b - 1) // 2
                            if 0 <= y < rows and 0 <= z < cols:
                                v += x[y][z] * w[f"conv{a}x{b}"][p * b + q][f]
                    best = max(best, v)
                cells[i][j] = best
        for i in range(rows):
            places = [j for cut in shape.cuts for j in (sorted(range(cut), key=lambda j: (-cells[i][j], j))[: shape.kmax] + [None] * shape.kmax)[: shape.kmax]]
            signals[i] += [0.0 if j is None else cells[i][j] for j in places]
            if shape.context:
                signals[i] += [0.0 if j is None else context[i][j] for j in places]
    if order is not None:
        signals = [signals[i] for i in order]
    if shape.combine:
        v = np.array(sum(signals, []))
        h = np.maximum(v @ w["d1"] + w["b1"], 0)
        return ((np.maximum(h @ w["d2"] + w["b2"], 0)) @ w["d3"] + w["b3"])[0]
    h = c = 0.0
    hard = lambda z: min(1.0, max(0.0, 0.2 * z + 0.5))
    for row in signals:
        i, f, g, o = (np.dot(row, w["input"][:, k]) + h * w["state"][k] + w["bias"][k] for k in range(4))
        c = hard(f) * c + hard(i) * math.tanh(g)
        h = hard(o) * math.tanh(c)
    return h


SHAPES = [
    scorer.Shape(rows=4, columns=10, winlen=3, filters=3, kmax=2, combine=5),
    scorer.Shape(rows=4, columns=10, winlen=2, proximity=3, extra="1x4.3x1", filters=2, kmax=3, prefixes=(20, 50), context=True, combine=4),
    scorer.Shape(rows=5, columns=7, winlen=3, filters=2, kmax=2, prefixes=(50,), context=True, combine=0),
]


def inputs(shape, n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, shape.rows, shape.columns)), rng.random((n, shape.rows)), rng.random((n, shape.rows, shape.columns)), np.stack([rng.permutation(shape.rows) for _ in range(n)])


@pytest.mark.parametrize("shape", SHAPES)
def test_forward_against_loops(shape, monkeypatch):
    monkeypatch.setattr(scorer, "WINDOW_BYTES", 20_000)  # so that documents come in several portions
    w = shape.weights(3)
    x, idf, context, order = inputs(shape, 6)
    x[0] = 0  # ties everywhere
    for o in (None, order):
        got = scorer.forward(x, idf, w, shape, context, o)
        assert got == pytest.approx([by_loops(x[i], idf[i], w, shape, context[i], None if o is None else o[i]) for i in range(6)])


@pytest.mark.parametrize("shape", SHAPES)
def test_gradients_against_differences(shape):
    w = shape.weights(4)
    a, idf, context, order = inputs(shape, 5, 2)
    b, _, other, _ = inputs(shape, 5, 3)
    loss = lambda v: scorer.pair_gradients([a, b], idf, v, shape, [context, other], order)[0]
    _, grad = scorer.pair_gradients([a, b], idf, w, shape, [context, other], order)
    rng = np.random.default_rng(5)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert np.asarray(grad.get(name, np.zeros_like(w[name])))[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5), (name, at)


def planted(spark, shape, n=240):
    """Topics whose relevant documents hold a diagonal run of matches."""
    rng = np.random.default_rng(9)
    pairs, labels = [], []
    for i in range(n):
        m = rng.random((shape.rows, shape.columns)) * 0.4
        if i % 2:
            at = int(rng.integers(0, shape.columns - shape.rows))
            m[np.arange(shape.rows), at + np.arange(shape.rows)] = 1
        pairs.append((i % 6 // 2, f"d{i}", m.astype(np.float32).tolist(), [1.0] * shape.rows, m.astype(np.float32).tolist()))
        labels.append((i % 6 // 2, f"d{i}", i % 2))
    return spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(labels, "qid bigint, docno string, label int")


@pytest.mark.parametrize("shape", [scorer.Shape(rows=4, columns=12, winlen=3, filters=4, kmax=2, prefixes=(50,), context=True, combine=6), scorer.Shape(rows=4, columns=12, winlen=2, filters=4, kmax=2, combine=0)])
def test_training_learns_and_repeats(spark, shape):
    pairs, labels = planted(spark, shape)
    data = scorer.examples(representatives.training_pairs(labels, 2000), pairs, shape.context)
    w, losses = scorer.train(data, shape, steps=12, rate=0.03, shuffle=bool(shape.combine))
    again, _ = scorer.train(data.repartition(3), shape, steps=12, rate=0.03, shuffle=bool(shape.combine))
    assert losses[-1] < 0.8 * losses[0]
    assert all(np.array_equal(w[k], again[k]) for k in w)
    scored = {r.docno: r.sim for r in scorer.score(pairs, w, shape).collect()}
    good, bad = ([s for d, s in scored.items() if int(d[1:]) % 2 == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_scoring_in_spark_and_odd_input(spark):
    shape = SHAPES[1]
    x, idf, context, _ = inputs(shape, 9)
    w = shape.weights(3)
    rows = [(i, f"d{i}", x[i].tolist(), idf[i].tolist(), context[i].tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r.qid: r.sim for r in scorer.score(df, w, shape).collect()}
    want = scorer.forward(x.astype(np.float32).astype(float), idf, w, shape, context.astype(np.float32).astype(float))
    assert [got[i] for i in range(9)] == pytest.approx(list(want))
    assert scorer.score(df.limit(0), w, shape).count() == 0
    data = scorer.examples(spark.createDataFrame([], "draw bigint, qid bigint, positive string, negative string"), df, True)
    same, losses = scorer.train(data, shape, steps=2)
    assert losses == [] and all(np.array_equal(same[k], v) for k, v in shape.weights(7541).items())
    with pytest.raises(Exception, match="shape"):
        scorer.score(df.withColumn("idf", df.matrix[0].cast("array<double>")), w, shape).collect()
    for wrong in ({"prefixes": (0,)}, {"combine": -1}):
        with pytest.raises(ValueError):
            scorer.Shape(**wrong)
