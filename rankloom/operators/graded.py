"""Graded nDCG and ERR with exponential gains, and risk-sensitive comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: The highest grade and the usual depth.
MAX_GRADE = 4
DEPTH = 20
#: Slots, at least, that a topic's documents are dealt into to find a score that its first ones reach.
SLOTS = 256
#: Most topics whose scores are broadcast; with more, they are joined.
MOST_TOPICS = 100_000


def _first(run: DataFrame, depth: int) -> DataFrame:
    """The first depth rows of each qid by sim, ties by docno descending, with their rank; a stored table.

    A topic's rows are dealt into slots; as many of them as depth have a row at or above the depth-th largest of their maxima, so what lies below can't be among the first. What is
    left is sorted in even shares before it meets by topic.
    """
    slots = max(SLOTS, 8 * depth)
    best = run.groupBy("qid", F.pmod(F.xxhash64("docno"), F.lit(slots)).alias("slot")).agg(F.max("sim").alias("least")).filter("least is not null")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("least")))
    least = stored(best.withColumn("place", place).filter(F.col("place") == depth).select("qid", "least"), "least")
    few = F.broadcast(least) if least.count() <= MOST_TOPICS else least
    rows = run.join(few, "qid", "left").filter("least is null or sim >= least").drop("least").repartition("qid", "docno")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("docno"))
    return stored(rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth), "first")


def _scored(top: DataFrame, grades: DataFrame, depth: int) -> DataFrame:
    """(qid, ndcg, err) of top (qid, rank, rel) and the number n of judgments of each rel in grades (qid, rel, n)."""
    n = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("rel")))
    best = grades.withColumn("last", n).select("qid", "rel", F.explode(F.expr(f"filter(sequence(1, {depth}), i -> i > last - n and i <= last)")).alias("pos"))
    best = best.groupBy("qid").agg(F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) * F.ln(F.lit(2.0)) / F.ln(F.col("pos") + 1.0)).alias("ideal"))
    gain = F.pow(F.lit(2.0), F.coalesce("rel", F.lit(0))) - 1
    lists = top.groupBy("qid").agg(F.sum(gain * F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0)).alias("dcg"), F.array_sort(F.collect_list(F.struct("rank", (gain / 2**MAX_GRADE).alias("r")))).alias("grades"))
    err = F.expr("aggregate(grades, struct(cast(0 as double) as s, cast(1 as double) as d), (a, x) -> struct(a.s + x.r * a.d / x.rank as s, a.d * (1 - x.r) as d)).s")
    return lists.join(best, "qid").select("qid", (F.col("dcg") / F.col("ideal")).alias("ndcg"), err.alias("err"))


def graded_by(runs: DataFrame, qrels: DataFrame, by: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """(by..., qid, ndcg, err) of (by..., qid, docno, sim): graded measures of every run against the same judgments, by one ranked list keyed by run and topic.

    Of topics with a positive judgment that the run has; ties of score by docno descending, scores as doubles. Judgments are never repeated for the runs: they are
    looked up for the first depth documents, and counted by grade for the ideal list.
    """
    positive = qrels.filter("rel > 0").select("qid", "docno", "rel")
    first = _first(runs.select(F.struct(*by, "qid").alias("qid"), "docno", "sim"), depth).select(F.col("qid").alias("of"), "qid.qid", "docno", "rank")
    known = positive.join(first.select("qid", "docno").distinct(), ["qid", "docno"])
    top = first.join(known, ["qid", "docno"], "left").select(F.col("of").alias("qid"), "rank", "rel")
    grades = positive.groupBy("qid", "rel").agg(F.count("*").alias("n"))
    grades = grades.join(first.select("of", "qid").distinct(), "qid").select(F.col("of").alias("qid"), "rel", "n")
    return _scored(top, grades, depth).select("qid.*", "ndcg", "err")


def graded_measures(run: DataFrame, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(qid, ndcg, err) of one run: graded_by without by."""
    return graded_by(run, qrels, (), depth)


def risk(values: DataFrame, baseline: DataFrame, alpha: float, judged: DataFrame | None = None) -> DataFrame:
    """values minus baseline per topic, losses weighted by 1 + alpha; a topic that the baseline misses counts 0 there.

    judged: all judged topics; those that the run misses are then scored as 0 minus the baseline.
    """
    base = baseline.select("qid", F.col("ndcg").alias("n0"), F.col("err").alias("e0"))
    rows = values if judged is None else judged.select("qid").distinct().join(values, "qid", "left")

    def weighted(x: str, y: str):
        d = F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))
        return F.when(d < 0, d * (1 + alpha)).otherwise(d)

    return rows.join(base, "qid", "left").select("qid", weighted("ndcg", "n0").alias("ndcg"), weighted("err", "e0").alias("err"))


def report(values: DataFrame, runid: str, topics: int | None = None) -> DataFrame:
    """(runid, topic, ndcg, err): the topics and the row amean, whose divisor is topics if given."""
    mean = [(F.sum(c) / (F.lit(topics) if topics else F.count("*"))).alias(c) for c in ("ndcg", "err")]
    total = values.agg(*mean).select(F.lit("amean").alias("topic"), "ndcg", "err")
    return values.select(F.col("qid").cast("string").alias("topic"), "ndcg", "err").union(total).select(F.lit(runid).alias("runid"), "topic", "ndcg", "err")
