"""Word vectors: planted topics, frozen rows, shards, a step against plain loops, odd input."""

import math
import random

import numpy as np
import pytest

from rankloom.operators import word_vectors as W
from rankloom.sources import matrices

TEXTS = "tokens array<string>"


def topics(n=600, seed=4):
    rnd = random.Random(seed)
    return [([f"{'abc'[i % 3]}{rnd.randrange(8)}" for _ in range(30)],) for i in range(n)]


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_neighbours_share_a_topic_over_shards(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_TOKENS", 5_000)  # some four shards
    got = {r.word: r.vector for r in W.word_vectors(spark.createDataFrame(topics(), TEXTS), dim=12, window=4, passes=4, alpha=0.1).collect()}
    assert len(got) == 24
    for w, v in got.items():
        near = sorted((x for x in got if x != w), key=lambda x: -cosine(got[x], v))[:5]
        assert sum(x[0] == w[0] for x in near) >= 4, (w, near)


def test_frozen_rows_stay_bit_for_bit_and_seeds_repeat(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_TOKENS", 4_000)
    rng = np.random.default_rng(2)
    fixed = {w: rng.normal(0, 1, 6).astype(np.float32).tolist() for w in ("a0", "a1", "b3", "unseen")}
    frozen = spark.createDataFrame(list(fixed.items()), "word string, vector array<float>")
    texts = spark.createDataFrame(topics(300), TEXTS).coalesce(2)
    one, two = ({r.word: (r.n, r.vector) for r in W.word_vectors(texts, dim=6, window=3, passes=2, frozen=frozen).collect()} for _ in range(2))
    assert one == two and "unseen" not in one and sum(n for n, _ in one.values()) == 9000
    for w in ("a0", "a1", "b3"):
        assert one[w][1] == fixed[w]
    assert all(one[w][1] != W.first_vector(w, 6, 7541).tolist() for w in one if w not in fixed)


def test_step_against_loops(monkeypatch):
    monkeypatch.setattr(W, "BATCH", 1)  # plain order: one place after another
    rng = np.random.default_rng(1)
    words, dim = 6, 4
    vin, vout = (rng.normal(0, 0.5, (words, dim)).astype(np.float32) for _ in range(2))
    tokens = [np.array([0, 1, 2, 3]), np.array([4]), np.array([5, 5, 1])]
    open_ = np.array([True, False, True, True, True, True])
    a, b = vin.astype(float), vout.astype(float)
    draws, alpha, counts = np.random.default_rng(9), 0.1, np.array([1, 2, 1, 1, 1, 2])
    flat = [(p, i, int(t)) for p, piece in enumerate(tokens) for i, t in enumerate(piece)]
    share = np.cumsum(counts**0.75)
    for p, i, t in flat:
        reach = draws.integers(1, 3, 1)[0]
        context = [int(tokens[p][j]) for j in range(max(0, i - reach), min(len(tokens[p]), i + reach + 1)) if j != i]
        if not context:
            continue
        hidden = sum(a[c] for c in context) / len(context)
        negatives = [int(np.searchsorted(share, x * share[-1], side="right")) for x in draws.random((1, 2))[0]]
        back, change = np.zeros(dim), []
        for target, label in [(t, 1.0), *((x, 0.0) for x in negatives if x != t)]:
            g = (label - 1 / (1 + math.exp(-float(hidden @ b[target])))) * alpha
            back += g * b[target]
            change.append((target, g * hidden))
        for target, d in change:
            b[target] += d
        for c in context:
            if open_[c]:
                a[c] += back / len(context)
    W.train_shard(tokens, vin, vout, counts, open_, 2, 2, alpha, np.random.default_rng(9))
    assert vin == pytest.approx(a, abs=1e-5) and vout == pytest.approx(b, abs=1e-5)


def test_odd_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "PIECE", 7)
    rows = [(None,), ([],), (["x", None, "", "y"],), (["lone"],), (["long", "text"] * 50,)]
    got = {r.word: r.n for r in W.word_vectors(spark.createDataFrame(rows, TEXTS), dim=3, passes=1).collect()}
    assert got == {"x": 1, "y": 1, "lone": 1, "long": 50, "text": 50}
    assert W.word_vectors(spark.createDataFrame(rows[:2], TEXTS), dim=3, passes=1).count() == 0
    (tmp_path / "of").mkdir()
    (tmp_path / "of" / "part-0").write_text("d1 a b  c\nd2\n\n d3\tx\n")
    (tmp_path / "of" / "other").write_text("d9 no\n")
    assert sorted(map(tuple, matrices.read_token_lines(spark, str(tmp_path)).collect())) == [("d1", ["a", "b", "c"]), ("d3", ["x"])]
