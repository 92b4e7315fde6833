"""Experiment analytics: model selection, re-ranking of other runs, document pairs, significance, improvement reports."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graded import DEPTH, graded_by, graded_measures  # noqa: F401
from .shared import stored

#: Judgment labels by name, names by label and year, and what training makes of labels.
GRADES = {"Nav": 4, "HRel": 2, "Rel": 1, "NRel": 0, "Junk": -2}
_LATER = {4: "Nav", 3: "HRel", 2: "HRel", 1: "Rel", 0: "NRel", -2: "Junk"}
GRADES_OF_YEAR = {"wt09": {2: "HRel", 1: "Rel", 0: "NRel"}, "wt10": _LATER, "wt11": {3: "Nav", 2: "HRel", 1: "Rel", 0: "NRel", -2: "Junk"}, "wt12": _LATER, "wt13": _LATER, "wt14": _LATER}
CANONICAL = {4: 2, 3: 2, 2: 2, 1: 1, 0: 0, -2: 0}


def grade_name(label: Column, year: Column) -> Column:
    """A judgment's name in its year, null if that year has no such label."""
    names = {f"{y}|{k}": v for y, t in GRADES_OF_YEAR.items() for k, v in t.items()}
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.concat_ws("|", year, label.cast("string"))]


def remap(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv))[label]


def year_of(qid: Column) -> Column:
    """Topics come in blocks of fifty a year, from 2009."""
    return F.concat(F.lit("wt"), F.lpad((F.floor((qid - 1) / 50) + 9).cast("string"), 2, "0"))


def collection_of(qid: Column) -> Column:
    return F.when(qid <= 200, "2009").when(qid <= 300, "2012")


def best_epochs(validation: DataFrame, test: DataFrame) -> DataFrame:
    """(setting, epoch, err_val, err_test, best) from (setting, epoch, err): each setting's epoch with the largest err on validation (the first on ties; 0 or less never wins), looked up on test."""
    w = Window.partitionBy("setting").orderBy(F.desc("err"), "epoch")
    chosen = validation.filter("err > 0").withColumn("n", F.row_number().over(w)).filter("n = 1").select("setting", "epoch", F.col("err").alias("err_val"))
    top = F.max("err_val").over(Window.partitionBy())  # a row for each setting
    rows = chosen.withColumn("best", F.col("err_val") == top).join(test.select("setting", "epoch", F.col("err").alias("err_test")), ["setting", "epoch"], "left")
    return rows.select("setting", "epoch", "err_val", "err_test", "best")


def common_epochs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The epochs that both tables have."""
    return a.select("epoch").intersect(b.select("epoch"))


def rescore(run: DataFrame, predictions: DataFrame) -> DataFrame:
    """run with predicted scores: missing documents go last, topics without any prediction keep their own; (qid, docno, rank, sim)."""
    known = predictions.select("qid").distinct().withColumn("known", F.lit(True))
    rows = run.join(predictions.select("qid", "docno", F.col("sim").alias("p")), ["qid", "docno"], "left").join(known, "qid", "left")
    sim = F.when(F.col("known"), F.coalesce(F.col("p").cast("double"), F.lit(float("-inf")))).otherwise(F.col("sim").cast("double"))
    rows = rows.select("qid", "docno", sim.alias("sim"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "docno")).cast("bigint")).select("qid", "docno", "rank", "sim")


def rank_of_runs(means: DataFrame, reranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., run, mean, rank, rr_mean, rr_rank) of (by..., run, mean) tables: each re-ranked mean takes its run's place among all others, one at a time.

    A rank is one more than the number of other runs above, ties by name; a missing mean is below all others. Both lists are sorted together, by ranges: the originals
    above a row are those of the ranges before its own, a sum over one row for each range, and those before it in its range. No run is set against another.
    """
    both = means.select(*by, "run", "mean", F.lit(1).alias("own")).union(reranked.select(*by, "run", "mean", F.lit(0).alias("own")))
    order = [F.desc_nulls_last("mean"), "run", "own"]
    dealt = stored(both.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "run-ranges")
    parts = dealt.groupBy(*by, "part").agg(F.sum("own").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.coalesce(F.sum("own").over(Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.join(parts.select(*by, "part", before.alias("before")), [*by, "part"]).withColumn("above", F.col("before") + here)
    own = rows.filter("own = 1").select(*by, "run", "mean", (F.col("above") + 1).alias("rank"))
    other = rows.filter("own = 0").select(*by, "run", F.col("mean").alias("rr_mean"), "above")
    itself = F.col("mean").isNotNull() & (F.col("rr_mean").isNull() | (F.col("mean") > F.col("rr_mean")))
    return own.join(other, [*by, "run"]).select(*by, "run", "mean", "rank", "rr_mean", (F.col("above") + 1 - itself.cast("int")).alias("rr_rank"))


def document_pairs(labels: DataFrame, scores: DataFrame, known: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """(qid, low, high, n, hits, accuracy) over pairs of a topic's documents with different labels: right where the higher label has the larger score.

    labels (qid, docno, rel), scores (qid, docno, sim). Labels outside known and pairs with an unscored document don't count. No pair is made: the
    documents of each score are counted by label, and those of lower scores are a running sum, so work and memory are linear in the documents.
    """
    x = labels.filter(F.col("rel").isin(*known)).join(scores.select("qid", "docno", "sim"), ["qid", "docno"])
    at = x.groupBy("qid", "sim").agg(*(F.count_if(F.col("rel") == k).alias(f"c{k}") for k in known))
    whole = Window.partitionBy("qid")
    below = whole.orderBy("sim").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select("*", *(F.coalesce(F.sum(f"c{k}").over(below), F.lit(0)).alias(f"b{k}") for k in known))
    kinds = [(lo, hi) for i, lo in enumerate(sorted(known)) for hi in sorted(known)[i + 1 :]]
    sums = at.groupBy("qid").agg(*(F.sum(f"c{k}").alias(f"n{k}") for k in known), *(F.sum(F.col(f"c{hi}") * F.col(f"b{lo}")).alias(f"h{lo}_{hi}") for lo, hi in kinds))
    rows = sums.select("qid", F.explode(F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), (F.col(f"n{lo}") * F.col(f"n{hi}")).alias("n"), F.col(f"h{lo}_{hi}").alias("hits")) for lo, hi in kinds))).alias("x"))
    return rows.select("qid", "x.*").filter("n > 0").withColumn("accuracy", F.col("hits") / F.col("n"))


def document_pair_report(labels: DataFrame, scores: DataFrame, names: dict[int, str]) -> DataFrame:
    """(qid, pair, value): the accuracy of each topic by named pair of grades; topic 0 has the mean over topics, topic -1 the number of pairs."""
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    pairs = document_pairs(labels, scores, tuple(sorted(names))).withColumn("pair", F.concat_ws("-", name[F.col("low")], name[F.col("high")])).filter(name[F.col("low")] != name[F.col("high")])
    each = pairs.groupBy("qid", "pair").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("value"))
    mean = each.groupBy("pair").agg(F.avg("value").alias("value")).select(F.lit(0).cast("bigint").alias("qid"), "pair", "value")
    total = each.groupBy("pair").agg(F.sum("n").cast("double").alias("value")).select(F.lit(-1).cast("bigint").alias("qid"), "pair", "value")
    return each.select(F.col("qid").cast("bigint").alias("qid"), "pair", "value").union(mean).union(total)


def epoch_measures(predictions: DataFrame, qrels: DataFrame, families: tuple[str, ...] = ("average", "cutoffs")) -> DataFrame:
    """(epoch, qid, measure...) of predictions (epoch, qid, docno, sim): every epoch's run against the same judgments, by one ranked list keyed by epoch and topic."""
    from .measures import evaluate

    key = F.struct("epoch", "qid").alias("qid")
    judged = qrels.join(predictions.select("epoch", "qid").distinct(), "qid")
    values = evaluate(predictions.select(key, "docno", "sim"), judged.select(key, "docno", "rel"), families)
    return values.select("qid.epoch", "qid.qid", *(c for c in values.columns if c != "qid"))


def epoch_report(predictions: DataFrame, qrels: DataFrame, by: tuple[str, ...] = ("epoch",), depth: int = DEPTH) -> DataFrame:
    """(by..., ndcg, err, map): what a checkpoint is judged by, graded nDCG and ERR at depth and average precision, each a mean over its topics with a positive judgment (for
    map: with any judgment), 0 where there are none."""
    from .measures import average, evaluate

    key = F.struct(*by, "qid").alias("qid")
    judged = qrels.join(predictions.select(*by, "qid").distinct(), "qid")
    ap = evaluate(predictions.select(key, "docno", "sim"), judged.select(key, "docno", "rel"), exprs={"map": average(1)["map"]}).select("qid.*", "map")
    ap = ap.groupBy(*by).agg(F.avg("map").alias("map"))
    each = graded_by(predictions, qrels, by, depth).groupBy(*by).agg(F.avg("ndcg").alias("ndcg"), F.avg("err").alias("err"))
    out = predictions.select(*by).distinct().join(each, list(by), "left").join(ap, list(by), "left")
    return out.select(*by, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ndcg", "err", "map")))


def finished_epochs(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest at path: (setting, epoch, ndcg, err, map), or None if there is none yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found.select("setting", "epoch", "ndcg", "err", "map")


def pending_epochs(predictions: DataFrame, path: str) -> DataFrame:
    """The predictions (setting, epoch, ...) of epochs that the manifest at path hasn't got.

    Finished ones go by a filter on setting and epoch alone, so that a table partitioned by them isn't read there. The driver gets a row for each finished epoch.
    """
    done = finished_epochs(predictions.sparkSession, path)
    if done is None:
        return predictions
    epochs = {r.setting: r.epochs for r in done.groupBy("setting").agg(F.collect_set("epoch").alias("epochs")).collect()}
    for setting, found in epochs.items():
        predictions = predictions.filter(~(F.col("setting").eqNullSafe(F.lit(setting)) & F.col("epoch").isin(found)))
    return predictions


def resume_epochs(predictions: DataFrame, qrels: DataFrame, path: str, depth: int = DEPTH) -> DataFrame:
    """The manifest after all epochs of predictions (setting, epoch, qid, docno, sim) are in it; only those that it hasn't got are evaluated.

    An epoch is one row in a folder of its own, which a job that ends writes whole. One that is killed leaves some epochs finished, or none, and the next call repeats only the
    others; writing an epoch again replaces it. Null settings or epochs are an error.
    """
    todo = pending_epochs(predictions, path)
    named = F.when(F.col("setting").isNotNull() & F.col("epoch").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a prediction without setting or epoch")).cast("boolean"))
    todo = todo.filter(named)
    if not todo.isEmpty():
        rows = epoch_report(todo, qrels, ("setting", "epoch"), depth)
        rows.repartition("setting", "epoch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("setting", "epoch").parquet(path)
    done = finished_epochs(predictions.sparkSession, path)
    if done is None:
        shape = "setting int, epoch int, ndcg double, err double, map double"
        return predictions.sparkSession.createDataFrame([], shape)
    return done


def unique_best_epoch(validation: DataFrame, test: DataFrame) -> DataFrame:
    """(epoch, err_val, err_test) of (epoch, err) tables of one setting: of the epochs that both have, the one with the largest err on validation; the first on ties."""
    both = validation.select("epoch", F.col("err").alias("err_val")).join(test.select("epoch", F.col("err").alias("err_test")), "epoch")
    return both.orderBy(F.desc("err_val"), "epoch").limit(1)


def baseline_table(baseline: DataFrame, others: DataFrame) -> DataFrame:
    """(qid, run, value, baseline, change) of (qid, value) and (run, qid, value): each run's value beside the query-likelihood baseline's, topic by topic and,
    as topic 'all', on average; change is in percent of the baseline's value, null where that is 0."""
    rows = others.select(F.col("qid").cast("string").alias("qid"), "run", "value").join(baseline.select(F.col("qid").cast("string").alias("qid"), F.col("value").alias("baseline")), "qid")
    mean = rows.groupBy("run").agg(F.avg("value").alias("value"), F.avg("baseline").alias("baseline")).select(F.lit("all").alias("qid"), "run", "value", "baseline")
    return rows.union(mean).withColumn("change", (F.col("value") - F.col("baseline")) / F.expr("nullif(baseline, 0)") * 100)


def improvements(table: DataFrame) -> DataFrame:
    """(n, improved, mean_change, median_change) of (rank, rr_rank, mean, rr_mean): runs that move up, and the change in percent."""
    change = (F.col("rr_mean") - F.col("mean")) / F.expr("nullif(mean, 0)") * 100
    return table.agg(F.count("*").alias("n"), F.count_if(F.col("rr_rank") < F.col("rank")).alias("improved"), F.avg(change).alias("mean_change"), F.median(change).alias("median_change"))


def improvement_curve(table: DataFrame) -> DataFrame:
    """(position, run, change): change in percent by original score, the best first."""
    change = (F.col("rr_mean") - F.col("mean")) / F.expr("nullif(mean, 0)") * 100
    return table.select(F.row_number().over(Window.orderBy(F.desc("mean"), "run")).cast("bigint").alias("position"), "run", change.alias("change"))


def class_priors(labels: DataFrame) -> DataFrame:
    """(label, qid, n, p_qid, p_label): counts, a topic's share of its label, and the label's share of all."""
    c = labels.groupBy("label", "qid").agg(F.count("*").alias("n"))
    total = c.groupBy("label").agg(F.sum("n").alias("of_label"))
    every = total.withColumn("all", F.sum("of_label").over(Window.partitionBy()))  # a row for each label
    return c.join(F.broadcast(every), "label").select("label", "qid", "n", (F.col("n") / F.col("of_label")).alias("p_qid"), (F.col("of_label") / F.col("all")).alias("p_label"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or tiny)
            c = (1 + n / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_probability(t: float | None, n: int) -> float | None:
    """Two-sided p-value of a paired t statistic over n pairs."""
    return None if t is None or n < 2 else _beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def paired_t(a: DataFrame, b: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, mean_difference, t, p) of a column over the topics of both tables, for each value of by. The sums are Spark's; a UDF turns one number a row into p."""
    d = a.select(*by, "qid", F.col(column).alias("x")).join(b.select(*by, "qid", F.col(column).alias("y")), [*by, "qid"]).select(*by, (F.col("x") - F.col("y")).alias("d"))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("s"))
    s = s.withColumn("t", F.col("mean_difference") / F.expr("nullif(s / sqrt(n), 0)"))
    return s.select(*by, "n", "mean_difference", "t", F.udf(t_probability, "double")("t", "n").alias("p"))


def comparison_table(original: DataFrame, reranked: DataFrame, measures: tuple[str, ...] = ("err", "ndcg")) -> DataFrame:
    """(run, measure, score, rank, rr_score, rr_rank, change, p) of (run, qid, measures...): a run's mean and its rank among all runs before re-ranking, both after it alone was
    re-ranked, the change in percent (null from 0), and the paired t-test's p over the topics of both. A mean is over the topics that its run has; a run that only one of the tables has is left out.
    """
    key = ("measure", "run")

    def long(df: DataFrame) -> DataFrame:
        return df.select("run", "qid", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))))

    a, b = long(original), long(reranked)
    means = [x.groupBy(*key).agg(F.avg("value").alias("mean")) for x in (a, b)]
    ranks = rank_of_runs(*means, by=("measure",))
    change = (F.col("rr_mean") - F.col("mean")) / F.expr("nullif(mean, 0)") * 100
    p = paired_t(a, b, "value", by=key).select(*key, "p")
    return ranks.join(p, list(key), "left").select("run", "measure", F.col("mean").alias("score"), "rank", F.col("rr_mean").alias("rr_score"), "rr_rank", change.alias("change"), "p")
