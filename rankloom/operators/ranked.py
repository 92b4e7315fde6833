"""The ranked relevance list: a run merged with judgments, one row for each retrieved document.

rel is the judgment, -1 for documents outside the pool and -2 for those in it that nobody judged. A topic is never one task: lists are sorted by ranges
and cut into blocks of at most BLOCK neighbours; what came before a block is a sum over a table of one row for each block of a topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: A block has up to 2 ** BLOCK_BITS rows, which a window holds at once.
BLOCK_BITS = 16
#: Lists of up to so many rows a topic are cut while they are sorted, in one window a topic.
SHORT = 1000
#: A block behind all others.
LAST = 1 << 62


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number (1..n, as rank) in the order within their qid, and their block, which ascends with it. Sorted by ranges into a stored table."""
    dealt = stored(rows.repartitionByRange("qid", *order).sortWithinPartitions("qid", *order).withColumn("place", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("block", F.shiftright("place", BLOCK_BITS))
    parts = dealt.groupBy(F.col("qid").alias("of"), F.col("block").alias("number")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("of", "number", (before - F.col("first") + 1).alias("shift"))
    out = dealt.join(parts, F.col("qid").eqNullSafe(F.col("of")) & (F.col("block") == F.col("number")), "left")  # only the small side can be broadcast, however well rows pack
    return out.select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "block")


def running(rows: DataFrame, keep: str | None = None, **sums: Column) -> DataFrame:
    """rows (qid, block, rank, ...) with running sums in the order of rank, and their totals as all_<name>; keep, which may use totals, drops rows that change no sum."""
    parts = rows.groupBy("qid", "block").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    topic = Window.partitionBy("qid")
    earlier = topic.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("qid", "block", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in sums), *(F.sum(k).over(topic).alias(f"all_{k}") for k in sums))
    here = Window.partitionBy("qid", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(parts, ["qid", "block"], "left")  # only the small side can be broadcast, however well rows pack
    out = out.filter(keep) if keep else out
    return out.select(*rows.columns, *((F.col(f"before_{k}") + F.sum(v).over(here)).alias(k) for k, v in sums.items()), *(f"all_{k}" for k in sums))


def _places(run: DataFrame, ties: str, top: int | None) -> DataFrame:
    """rank_run with blocks."""
    order = [F.col("sim").cast("float").desc(), F.desc("docno") if ties == "desc" else F.asc("docno")]
    if top and top <= SHORT:
        number = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
        return run.withColumn("rank", number).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint")).withColumn("block", F.lit(0).cast("bigint"))
    out = _numbered(run, order, "places")
    return out.filter(F.col("rank") <= top) if top else out


def rank_run(run: DataFrame, ties: str = "desc", top: int | None = None) -> DataFrame:
    """run (qid, docno, sim) with rank 1..n by sim descending as 32-bit floats; ties by docno, descending or ascending."""
    return _places(run, ties, top).drop("block")


def topic_stats(qrels: DataFrame, level: int = 1) -> DataFrame:
    """(qid, num_rel, num_nonrel, num_gain) over all judgments of a topic."""
    return qrels.groupBy("qid").agg(
        F.count_if(F.col("rel") >= level).alias("num_rel"), F.count_if((F.col("rel") >= 0) & (F.col("rel") < level)).alias("num_nonrel"), F.count_if(F.col("rel") > 0).alias("num_gain")
    )


def ideal(qrels: DataFrame) -> DataFrame:
    """(qid, pos, ideal, ideal_next, ideal_dcg, ideal_cost): positive gains of all judged documents in descending order."""
    rows = _numbered(qrels.filter("rel > 0").select("qid", "docno", "rel"), [F.desc("rel"), F.desc("docno")], "ideal").select("qid", "block", "rank", "rel")
    starts = rows.groupBy("qid", "block").agg(F.min_by("rel", "rank").alias("start"))
    starts = starts.select("qid", "block", F.lead("start").over(Window.partitionBy("qid").orderBy("block")).alias("behind"))
    rows = running(rows, ideal_dcg=F.col("rel") * F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0), ideal_cost=F.greatest(F.col("rel"), F.lit(1)))
    following = F.lead("rel").over(Window.partitionBy("qid", "block").orderBy("rank"))
    return rows.join(starts, ["qid", "block"], "left").select(
        "qid", F.col("rank").alias("pos"), F.col("rel").cast("double").alias("ideal"), F.coalesce(following, "behind", F.lit(0)).cast("double").alias("ideal_next"), "ideal_dcg", "ideal_cost"
    )


def _counted(level: int) -> dict[str, Column]:
    found = {"cumrel": F.col("rel") >= level, "cumnonrel": (F.col("rel") >= 0) & (F.col("rel") < level), "cumunj": F.col("rel") == -2}
    return {k: v.cast("bigint") for k, v in found.items()}


def ranked(run: DataFrame, qrels: DataFrame, level: int = 1, judged_only: bool = False, top: int | None = None, docs: bool = True, pooled: bool = False) -> DataFrame:
    """(qid, docno, rank, rel, num_ret, cumrel, cumnonrel, cumunj, num_rel, num_nonrel, num_gain, block) of the topics in both inputs.

    docs: with docno. pooled: documents outside the pool are left out, but for a topic's last one, so that each topic has a row.
    """
    rel = F.when(F.col("rel").isNull(), -1).when(F.col("rel") < 0, -2).otherwise(F.col("rel"))
    columns = ["qid", "docno"] if docs else ["qid"]
    rows = _places(run.select("qid", "docno", "sim"), "desc", top).join(qrels.select("qid", "docno", "rel"), ["qid", "docno"], "left")
    rows = stored(rows.select(*columns, "block", "rank", rel.alias("rel")), "ranked")
    counted = _counted(level)
    keep = "rel <> -1 or rank = all_ret" if pooled and not judged_only else None
    rows = running(rows.filter("rel >= 0") if judged_only else rows, keep, ret=F.lit(1).cast("bigint"), **counted)
    rows = rows.select(*columns, F.col("ret" if judged_only else "rank").alias("rank"), "rel", F.col("all_ret").alias("num_ret"), *counted, "block")
    return rows.join(topic_stats(qrels, level), "qid")


def ranked_groups(run: DataFrame, qrels_jg: DataFrame, level: int = 1, top: int | None = None) -> DataFrame:
    """(qid, rank, rel, cumrel, cumnonrel, cumunj, num_rel, num_nonrel, num_gain) with (qid, jg) as qid: what ranked(pooled=True) gives for each judgment group against the whole run, but
    for num_ret. The run is ranked once for all groups; each group has the documents in its pool and a row at the last rank."""
    key = F.struct("qid", "jg").alias("qid")
    places = _places(run.select("qid", "docno", "sim"), "desc", top)
    judged = places.join(qrels_jg.select("qid", "jg", "docno", "rel"), ["qid", "docno"])
    rel = F.when(F.col("rel").isNull(), -1).when(F.col("rel") < 0, -2).otherwise(F.col("rel"))
    ends = qrels_jg.select("qid", "jg").distinct().join(places.groupBy("qid").agg(F.max("rank").alias("rank")), "qid")
    ends = ends.select(key, F.lit(LAST).alias("block"), "rank", F.lit(-1).alias("rel"))
    rows = stored(judged.select(key, "block", "rank", rel.alias("rel")).union(ends), "ranked")
    counted = _counted(level)
    rows = running(rows, **counted).select("qid", "rank", "rel", *counted)
    return rows.join(topic_stats(qrels_jg.select(key, "rel"), level), "qid")
