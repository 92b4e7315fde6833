import math

import pytest

from rankloom.operators import analytics, graded, measures, preferences
from rankloom.operators.ranked import rank_run, ranked


def runs(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, sim double")


def judged(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, rel int")


def only(df):
    return df.first().asDict()


def test_ties_and_float_scores(spark):
    run = runs(spark, [("1", "a", 1.00000001), ("1", "b", 1.0), ("1", "c", 0.5)])
    order = lambda t: [r.docno for r in rank_run(run, ties=t).orderBy("rank").collect()]
    assert order("desc") == ["b", "a", "c"] and order("asc") == ["a", "b", "c"]


def test_sentinels(spark):
    run = runs(spark, [("1", d, s) for d, s in (("out", 4.0), ("unjudged", 3.0), ("bad", 2.0), ("good", 1.0))])
    qrels = judged(spark, [("1", "unjudged", -1), ("1", "bad", 0), ("1", "good", 1)])
    assert [r.rel for r in ranked(run, qrels).orderBy("rank").collect()] == [-1, -2, 0, 1]
    assert measures.relevance_string(run, qrels).first().relstring == "-.01"
    assert [r["rank"] for r in ranked(run, qrels, judged_only=True).orderBy("rank").collect()] == [1, 2]


def test_gains_three_ways(spark):
    run = runs(spark, [("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 1.0)])
    qrels = judged(spark, [("1", "a", 3), ("1", "b", 0), ("1", "c", 2)])
    v = only(measures.evaluate(run, qrels, ["gains", "average", "interpolated"]))
    ideal = 3 + 2 / math.log2(3)
    assert v["ndcg"] == pytest.approx((3 + 2 / 2) / ideal)
    assert v["map"] == pytest.approx((1 + 2 / 3) / 2)
    g = only(graded.graded_measures(run, qrels))
    assert g["ndcg"] == pytest.approx((7 + 3 / 2) / (7 + 3 / math.log2(3)))
    assert g["err"] == pytest.approx(7 / 16 + (9 / 16) * (3 / 16) / 3)


def test_complete_and_geometric_mean(spark):
    run = runs(spark, [("1", "a", 1.0)])
    qrels = judged(spark, [("1", "a", 1), ("2", "x", 1)])
    values = {(r.measure, r.qid): r.value for r in measures.summarise(measures.evaluate(run, qrels, ["average"], complete=True)).collect()}
    assert values["map", "all"] == 0.5 and values["gm_map", "all"] == pytest.approx(math.sqrt(1e-5)) and values["num_q", "all"] == 2


def test_recall_cutoffs_as_doubles(spark):
    r = next(r for r in range(1, 500) if int(0.3 * r + 0.9) != (3 * r + 9) // 10)
    c = int(0.3 * r + 0.9)
    qrels = judged(spark, [("1", f"d{i:03}", 1) for i in range(r)])
    run = runs(spark, [("1", f"d{i:03}", 1000.0 - i) for i in range(c)] + [("1", "miss", 1.0), ("1", f"d{c:03}", 0.5)])
    assert only(measures.evaluate(run, qrels, ["interpolated"]))["iprec_at_recall_0_30"] == 1.0


def test_ranking_does_not_depend_on_row_order(spark):
    rows = [("1", f"d{i}", float(i % 3)) for i in range(30)]
    qrels = judged(spark, [("1", f"d{i}", i % 2) for i in range(30)])
    a, b = (only(measures.evaluate(runs(spark, r), qrels, ["average", "cutoffs"])) for r in (rows, rows[::-1]))
    assert a == b and a["recall_5"] <= a["recall_10"] <= a["recall_1000"]


def test_preferences_closure_and_cycle(spark):
    schema = "qid string, jg string, jsg string, docno string, level double"
    rows = [("1", "g", "s1", "a", 2.0), ("1", "g", "s1", "b", 1.0), ("1", "g", "s2", "b", 2.0), ("1", "g", "s2", "c", 1.0)]
    run = runs(spark, [("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 1.0)])
    v = only(preferences.preference_measures(run, spark.createDataFrame(rows, schema)))
    assert v["prefs_num_prefs_poss"] == 3 and v["prefs_simp"] == 1.0
    with pytest.raises(ValueError):
        preferences.edges(spark.createDataFrame([*rows, ("1", "g", "s3", "c", 2.0), ("1", "g", "s3", "a", 1.0)], schema))


def test_paired_t(spark):
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate((1, 2, 3, 5))], "qid int, v double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 2, 1, 2))], "qid int, v double")
    r = only(analytics.paired_t(a, b, "v"))
    assert r["t"] == pytest.approx(2.3237900077, abs=1e-6) and r["p"] == pytest.approx(0.10269, abs=1e-4)


def test_empty_inputs(spark):
    run, qrels = runs(spark, []), judged(spark, [("1", "a", 1)])
    assert measures.evaluate(run, qrels, ["counts", "average"]).count() == 0
    assert graded.graded_measures(run, qrels).count() == 0
