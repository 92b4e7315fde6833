"""Long lists are ranked in blocks of neighbours: no topic is held or sorted by one task, and the counts run on from block to block."""

import math
import random

import pytest

from rankloom.operators import graded, measures
from rankloom.operators import ranked as R


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BITS", 3)


def made(spark, n=300):
    rng = random.Random(5)
    rows = [(q, f"d{i:03}", float(rng.randrange(6))) for q in ("1", "2") for i in range(n if q == "1" else 5)]
    judged = [(q, d, rng.randrange(-1, 4)) for q, d, _ in rows if rng.random() < 0.6] + [("1", f"x{i}", 3) for i in range(40)]
    return rows, judged, spark.createDataFrame(rows, "qid string, docno string, sim double"), spark.createDataFrame(judged, "qid string, docno string, rel int")


def test_counts_run_on_over_blocks(spark, small_blocks):
    rows, judged, run, qrels = made(spark)
    rel = {(q, d): -2 if x < 0 else x for q, d, x in judged}
    found = R.ranked(run, qrels)
    assert found.groupBy("qid", "block").count().agg({"count": "max"}).first()[0] <= 8
    got = sorted(tuple(r) for r in found.select("qid", "rank", "docno", "rel", "cumrel", "cumnonrel", "cumunj", "num_ret").collect())
    want = []
    for q in ("1", "2"):
        line = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1]), reverse=True)
        codes = [rel.get((q, r[1]), -1) for r in line]
        for i, r in enumerate(line, 1):
            seen = codes[:i]
            want.append((q, i, r[1], codes[i - 1], sum(c >= 1 for c in seen), sum(c == 0 for c in seen), sum(c == -2 for c in seen), len(line)))
    assert got == want
    kept = [(q, d) for q, _, d, c, *_ in want if c >= 0]
    again = R.ranked(run, qrels, judged_only=True).orderBy("qid", "rank").select("qid", "docno", "rank").collect()
    assert [(r[0], r[1]) for r in again] == kept and [r[2] for r in again] == [sum(k[0] == x[0] for k in kept[: i + 1]) for i, x in enumerate(kept)]


def test_measures_do_not_depend_on_blocks(spark, monkeypatch):
    _, _, run, qrels = made(spark)
    found = []
    for bits in (3, 16):
        monkeypatch.setattr(R, "BLOCK_BITS", bits)
        found.append(sorted(tuple(r) for r in measures.evaluate(run, qrels, list(measures.FAMILIES)).collect()))
    assert len(found[0]) == 2
    for a, b in zip(*found, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)


def test_topics_without_pooled_documents_stay(spark, small_blocks):
    run = spark.createDataFrame([("1", f"d{i}", float(i)) for i in range(40)], "qid string, docno string, sim double")
    qrels = spark.createDataFrame([("1", "x", 1), ("2", "d1", 1)], "qid string, docno string, rel int")
    value = measures.evaluate(run, qrels, ["counts", "sets"]).collect()
    assert len(value) == 1 and value[0].num_ret == 40 and value[0].num_rel_ret == 0 and value[0].utility == -40


def test_first_documents_and_grades(spark):
    """The first documents come without sorting a topic, judgments aren't repeated for runs: ties, nulls, NaN, fewer documents than the depth."""
    rng = random.Random(3)
    rows = [(r, q, f"d{i:04}", rng.choice([0.1, 0.2, 0.3, None])) for r in ("a", "b") for q, n in ((1, 900), (2, 7)) for i in range(n)]
    rows += [("a", 3, f"d{i:04}", float("nan") if i % 40 == 0 else float(i % 50)) for i in range(700)]
    judged = [(q, f"d{i:04}", rng.randrange(-1, 5)) for q in (1, 2, 3) for i in range(900)]
    runs = spark.createDataFrame(rows, "run string, qid int, docno string, sim double")
    qrels = spark.createDataFrame(judged, "qid int, docno string, rel int")
    rel = {(q, d): x for q, d, x in judged}
    first = {(x.run, x.qid, x["rank"]): x.docno for x in graded._first(runs.selectExpr("struct(run, qid) as qid", "docno", "sim"), 20).select("qid.*", "docno", "rank").collect()}
    got = {(x.run, x.qid): (x.ndcg, x.err) for x in graded.graded_by(runs, qrels, ("run",)).collect()}
    assert got.keys() == {("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)}
    for r, q in got:
        key = lambda x: (x[3] is not None, math.inf if x[3] != x[3] else x[3] or 0, x[2])
        line = [x[2] for x in sorted((x for x in rows if x[:2] == (r, q)), key=key, reverse=True)][:20]
        assert [first[r, q, i] for i in range(1, len(line) + 1)] == line
        gains = [2 ** max(rel[q, d], 0) - 1 for d in line]
        best = sorted((2**x - 1 for (t, _), x in rel.items() if t == q and x > 0), reverse=True)[:20]
        dcg = lambda gs: sum(g / math.log2(i + 2) for i, g in enumerate(gs))
        err, left = 0.0, 1.0
        for i, g in enumerate(gains, 1):
            err, left = err + g / 16 * left / i, left * (1 - g / 16)
        assert got[r, q] == pytest.approx((dcg(gains) / dcg(best), err))


@pytest.mark.parametrize("top", [None, 100])
def test_groups_share_one_ranking(spark, small_blocks, top):
    _, judged, run, _ = made(spark)
    rng = random.Random(8)
    rows = [(q, f"g{g}", d, x) for q, d, x in judged for g in range(3) if rng.random() < 0.4] + [("1", "g4", "nowhere", 1), ("3", "g1", "d001", 1)]
    qrels_jg = spark.createDataFrame(rows, "qid string, jg string, docno string, rel int")
    families = ["average", "cutoffs", "multiples", "interpolated"]
    got = {r.qid: r.asDict() for r in measures.by_group(run, qrels_jg, families, top=top).collect()}
    each = {}
    for g in sorted({r[1] for r in rows}):
        for r in measures.evaluate(run, qrels_jg.filter(f"jg = '{g}'").select("qid", "docno", "rel"), families, top=top).collect():
            each.setdefault(r.qid, []).append(r.asDict())
    assert got.keys() == each.keys() == {"1", "2"} and len(each["1"]) == 4
    for q, values in each.items():
        assert got[q] == pytest.approx({"qid": q} | {f"{k}_avgjg": sum(v[k] for v in values) / len(values) for k in values[0] if k != "qid"})
    plan = R.ranked_groups(run, qrels_jg)
    assert plan.filter("rel = -1").count() == 7  # only the rows that close a group
