"""Runs, judgments and preferences derived from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import stored

#: One row for each (topic, document): the line items of a supplier group, aggregated since their keys repeat.
PAIRS = """select l_suppkey % 50 as qid, concat('D', cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20))) as docno, l_orderkey as okey, l_partkey as pkey,
 cast(max(l_extendedprice) as float) as sim, cast(max(l_discount) as float) as sim2, max(l_linenumber) as line, max(l_linenumber) % 3 as jgn, max(l_quantity) as qty, max(l_tax) as tax
 from lineitem group by l_suppkey % 50, l_orderkey, l_partkey"""
#: A run doesn't retrieve everything and judges don't see everything: small orders aren't retrieved, large ones not by the other run, and untaxed ones aren't judged.
RUN = "select qid, docno, sim from pairs where qty > 10"
BASELINE = "select qid, docno, sim2 as sim from pairs where qty < 40"
QRELS = "select qid, docno, cast((pkey * 7 + line) % 5 - 1 as int) as rel from pairs where tax > 0.02"
QRELS_JG = "select qid, concat('g', cast(jgn as varchar(5))) as jg, docno, cast((pkey * 7 + line) % 4 as int) as rel from pairs where tax > 0.02"
#: Preferences are judged part by part, among the orders of a part: some thirty documents a topic, at any scale. Group g1 judges in overlapping sub-groups.
ORDERED = "select l_partkey as qid, concat('D', cast(l_orderkey as varchar(20))) as docno, cast(max(l_extendedprice) as float) as sim, max(l_linenumber) as line, max(l_quantity) as qty, l_orderkey as okey from lineitem group by l_partkey, l_orderkey"
PRUN = "select qid, docno, sim from ordered where qty > 10"
PREFS = """select qid, concat('g', cast(line % 3 as varchar(5))) as jg, 's0' as jsg, docno, cast((okey + line) % 4 as int) as level from ordered where line % 3 <> 1
 union all select qid, 'g1' as jg, 's0' as jsg, docno, cast(okey % 3 as int) as level from ordered where line % 3 = 1 and qty > 20
 union all select qid, 'g1' as jg, 's1' as jsg, docno, cast(okey % 3 as int) as level from ordered where line % 3 = 1 and qty < 35"""

#: PREFS by one look at each row of ordered, where its SQL takes three.
_PREFS_ONCE = """select qid, p.jg, p.jsg, docno, p.level from (select qid, docno, explode(filter(array(
 struct(line % 3 <> 1 as holds, concat('g', cast(line % 3 as varchar(5))) as jg, 's0' as jsg, cast((okey + line) % 4 as int) as level),
 struct(line % 3 = 1 and qty > 20 as holds, 'g1' as jg, 's0' as jsg, cast(okey % 3 as int) as level),
 struct(line % 3 = 1 and qty < 35 as holds, 'g1' as jg, 's1' as jsg, cast(okey % 3 as int) as level)), x -> x.holds)) as p from ordered)"""

VIEWS = {"pairs": PAIRS, "run": RUN, "baseline": BASELINE, "qrels": QRELS, "qrels_jg": QRELS_JG, "ordered": ORDERED, "prun": PRUN, "prefs": PREFS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def sql(text: str, **tables: DataFrame) -> DataFrame:
        for t in tables:
            text = text.replace(f"from {t}", f"from {{{t}}}")
        return spark.sql(text, **tables)

    if name in ("pairs", "ordered"):
        return sql(VIEWS[name], lineitem=lineitem)
    base = "ordered" if name in ("prun", "prefs") else "pairs"
    return sql(_PREFS_ONCE if name == "prefs" else VIEWS[name], **{base: sql(VIEWS[base], lineitem=lineitem)})


def views(spark: SparkSession, sf_dir: str, *names: str, more: tuple[str, ...] = ()) -> list[DataFrame]:
    """Views of pairs by name (pairs itself: qid, docno and the columns in more), for what reads them several times: the line items are aggregated once, into a stored table of the columns in use."""
    used = " ".join([*(VIEWS[n] for n in names if n != "pairs"), "qid docno", *more])
    pairs = view(spark, sf_dir, "pairs")
    pairs = stored(pairs.select(*(c for c in pairs.columns if re.search(rf"\b{c}\b", used))), "pairs")
    return [pairs if n == "pairs" else spark.sql(VIEWS[n].replace("from pairs", "from {pairs}"), pairs=pairs) for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """sql behind the CTEs of the views it needs; sql may begin with further CTEs, each ended by a comma."""
    ctes = [f"{n} as ({VIEWS[n]})" for n in ("pairs", "ordered", *names)]
    return "with " + ",\n".join(ctes) + ",\n" + sql
