"""Preference and group measures by name, ranks of runs, tables of re-ranked runs, resumed epochs, and readers that check whatever is read."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import analytics, measures, preferences, report
from rankloom.sources import run_files

RUN = [(q, f"d{i}", float((i * 7 + q) % 11)) for q in (1, 2, 3) for i in range(9)]
PREFS = [(q, f"g{i % 2}", "s0", f"d{i}", (i * q) % 3) for q in (1, 2, 4) for i in range(0, 12, 1 if q < 3 else 2)]


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame(RUN, "qid int, docno string, sim float")


@pytest.fixture(scope="module")
def prefs(spark):
    return spark.createDataFrame(PREFS, "qid int, jg string, jsg string, docno string, level int")


def test_all_preference_measures_by_name(spark, run, prefs):
    rows = report.evaluation(run, None, ["all_prefs"], per_topic=True, prefs=prefs).collect()
    got = {(r.measure, r.qid): r.value for r in rows}
    each = {str(r.qid): r.asDict() for r in preferences.preference_measures(run, prefs).collect()}
    for retrieved in (False, True):
        for r in preferences.balanced(run, prefs, retrieved=retrieved).collect():
            each[str(r.qid)] |= r.asDict()
    assert each.keys() == {"1", "2"} and got["num_q", "all"] == 2
    assert {m for m, _ in got} == {"runid", "num_q"} | preferences.NAMES
    for name in preferences.NAMES:
        values = [each[q][name] for q in ("1", "2")]
        assert [got[name, q] for q in ("1", "2")] == pytest.approx(values)
        assert got[name, "all"] == pytest.approx(sum(values) / (1 if "num_prefs" in name else 2))
    order = [r.measure for r in sorted(rows, key=lambda r: r.place) if r.qid == "all"]
    assert order == report.NICKNAMES["all_prefs"]
    assert {r.text for r in rows if r.measure == "prefs_num_prefs_poss"} == {str(int(got["prefs_num_prefs_poss", q])) for q in ("1", "2", "all")}


def test_preferences_by_brute_force(run, prefs):
    got = {r.qid: r for r in preferences.by_name(run, prefs, ["prefs_num_prefs_poss", "prefs_num_prefs_ful_ret"], complete=True).collect()}
    assert got.keys() == {1, 2, 4} and got[4].prefs_num_prefs_poss == 0
    for q in (1, 2):
        place = {d: i for i, (d, _) in enumerate(sorted(((d, s) for k, d, s in RUN if k == q), key=lambda x: (-x[1], x[0])))}
        judged = [(g, d, x) for k, g, _, d, x in PREFS if k == q]
        pairs = [(a, b) for g, a, x in judged for h, b, y in judged if g == h and x > y]
        assert got[q].prefs_num_prefs_poss == len(pairs)
        assert got[q].prefs_num_prefs_ful_ret == sum(a in place and b in place and place[a] < place[b] for a, b in pairs)


def test_group_measures_and_mixed_kinds(spark, run, prefs):
    judged = [(q, f"g{i % 2}", f"d{i}", int((i + q) % 3 == 0)) for q in (1, 2) for i in range(9)]
    qrels_jg = spark.createDataFrame(judged, "qid int, jg string, docno string, rel int")
    qrels = qrels_jg.filter("jg = 'g0'").drop("jg")
    got = {(r.measure, r.qid): r.value for r in report.evaluation(run, qrels, ["map", "P_avgjg.3", "map_avgjg", "prefs_simp", "num_q"], per_topic=True, prefs=prefs, qrels_jg=qrels_jg).collect()}
    for q in (1, 2):
        order = [d for d, _ in sorted(((d, s) for k, d, s in RUN if k == q), key=lambda x: (x[1], x[0]), reverse=True)]
        ps, aps = [], []
        for g in ("g0", "g1"):
            good = {d for k, h, d, rel in judged if (k, h) == (q, g) and rel}
            hits = [i for i, d in enumerate(order, 1) if d in good]
            ps.append(sum(i <= 3 for i in hits) / 3)
            aps.append(sum(j / i for j, i in enumerate(hits, 1)) / len(good) if good else 0)
        assert got["P_avgjg_3", str(q)] == pytest.approx(sum(ps) / 2)
        assert got["map_avgjg", str(q)] == pytest.approx(sum(aps) / 2)
        assert got["map", str(q)] == pytest.approx(aps[0])
    assert got["num_q", "all"] == 2 and ("prefs_simp", "all") in got


def test_measures_need_their_judgments(run, prefs):
    for name in ("prefs", "qrels_jg", "map"):
        with pytest.raises(ValueError, match="isn't given"):
            report.evaluation(run, None, [name])
    with pytest.raises(ValueError, match="no such measure"):
        report.parse(["prefs_other"])
    assert [(r.measure, r.value) for r in report.evaluation(run, None, ["num_q"], prefs=prefs).collect()] == [("num_q", 2.0)]


def test_rank_of_runs_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, f"r{i:03}", rng.choice([None, *(x / 8 for x in range(9))]), rng.choice([None, *(x / 8 for x in range(9))])) for k in ("a", "b") for i in range(120)]
    table = spark.createDataFrame(rows, "kind string, run string, mean double, rr double").repartition(7)
    out = analytics.rank_of_runs(table.select("kind", "run", "mean"), table.select("kind", "run", F.col("rr").alias("mean")), by=("kind",))
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    got = {(r.kind, r.run): (r["rank"], r.rr_rank) for r in out.collect()}

    def key(mean, run):
        return (math.inf if mean is None else -mean, run)

    for k, run_, mean, rr in rows:
        others = [key(m, n) for q, n, m, _ in rows if q == k and n != run_]
        assert got[k, run_] == (1 + sum(o < key(mean, run_) for o in others), 1 + sum(o < key(rr, run_) for o in others)), (k, run_)
    assert analytics.rank_of_runs(table.select("run", "mean").limit(0), table.select("run", "mean").limit(0)).count() == 0


def test_comparison_table(spark):
    a = spark.createDataFrame([(r, q, (q * r) % 5 / 5, q / 10) for r in (1, 2, 3) for q in range(1, 8)], "run int, qid int, ndcg double, err double")
    b = a.withColumn("ndcg", F.col("ndcg") + F.col("qid") / 50)
    got = {(r.run, r.measure): r for r in analytics.comparison_table(a, b).collect()}
    assert len(got) == 6 and got[1, "err"].p is None and got[1, "err"].change == 0
    one = got[2, "ndcg"]
    n, d = 7, [q / 50 for q in range(1, 8)]
    mean = sum(d) / n
    t = mean / math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1) / n)
    assert one.p == pytest.approx(analytics.t_probability(t, n)) and one.rr_score - one.score == pytest.approx(mean)


def test_epochs_are_resumed(spark, run, tmp_path):
    qrels = spark.createDataFrame([(q, f"d{i}", (i + q) % 3 - (i == 8)) for q in (1, 2) for i in range(9)], "qid int, docno string, rel int")
    stored, manifest = str(tmp_path / "predictions"), str(tmp_path / "manifest")
    every = run.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("epoch"))).withColumn("setting", F.lit(0)).withColumn("sim", F.xxhash64("docno", "epoch").cast("double"))
    every.write.partitionBy("setting", "epoch").parquet(stored)
    predictions = spark.read.parquet(stored)
    whole = {r.epoch: (r.ndcg, r.err, r["map"]) for r in analytics.epoch_report(every, qrels).collect()}
    first = analytics.resume_epochs(predictions.filter("epoch < 2"), qrels, manifest)
    assert {r.epoch for r in first.collect()} == {0, 1}
    # what is finished isn't read again: neither its files nor other scores under its number change anything
    todo = analytics.pending_epochs(predictions, manifest)
    assert {r.epoch for r in todo.select("epoch").distinct().collect()} == {2, 3}
    scan = next(line for line in todo._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line)
    assert "epoch" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    changed = predictions.withColumn("sim", F.when(F.col("epoch") < 2, 0.0).otherwise(F.col("sim")))
    for _ in range(2):
        done = {r.epoch: (r.ndcg, r.err, r["map"]) for r in analytics.resume_epochs(changed, qrels, manifest).collect()}
        assert done.keys() == whole.keys()
        assert all(done[e] == pytest.approx(whole[e]) for e in whole)
    assert analytics.resume_epochs(predictions.limit(0), qrels, str(tmp_path / "none")).count() == 0


def test_epoch_report_by_measures(spark, run):
    qrels = spark.createDataFrame([(q, f"d{i}", (i + q) % 3) for q in (1, 2) for i in range(9)], "qid int, docno string, rel int")
    one = run.withColumn("epoch", F.lit(5))
    got = analytics.epoch_report(one, qrels).first()
    ap = measures.evaluate(run, qrels, exprs=measures.average(1)).agg(F.avg("map")).first()[0]
    graded = analytics.graded_measures(run, qrels).agg(F.avg("ndcg"), F.avg("err")).first()
    assert got["map"] == pytest.approx(ap) and (got.ndcg, got.err) == pytest.approx(tuple(graded))


def test_readers_check_whatever_is_read(spark, tmp_path):
    def file(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    for rows in (
        run_files.read_qrels_jg(spark, file("a", "1 g d1 1", "1 g d1 0")).select("qid", "docno"), run_files.read_graded_run(spark, file("b", "1 Q0 d1 1 2.0 r", "1 Q0 d1 2 1.0 r")).select("qid"),
        run_files.read_graded_run(spark, file("c", "1 Q0 d1 1 x r")).select("qid"), run_files.read_graded_qrels(spark, file("d", "1 0 d1 9")).select("qid"), run_files.read_qrels(spark, file("e", "1 0 d1")).select("qid"),
    ):
        with pytest.raises(Exception, match="malformed|twice"):
            rows.collect()
        with pytest.raises(Exception, match="malformed|twice"):
            rows.count()
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid int, docno string")
    run_files.write_by_topic(rows, str(tmp_path / "out"))
    assert sorted((r.qid, r.docno) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (1, "b"), (2, "c")]
