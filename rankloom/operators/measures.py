"""Ranking measures as SQL expressions over the ranked list, grouped by topic.

Every measure is an aggregate over ranked() rows with num_ret, num_rel, num_nonrel and num_gain as grouping columns, so any number of
them is computed by one aggregation. Where a value is undefined (no relevant documents, say) it is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import ideal, ranked, ranked_groups, running

LN2 = "ln(cast(2 as double))"
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))
MULTIPLES = tuple(i / 5 for i in range(1, 11))
Maker = Callable[..., dict[str, str]]


def _d(x: str) -> str:
    return f"cast({x} as double)"


def _over(x: str, y: str) -> str:
    return f"{_d(x)} / nullif({_d(y)}, 0)"


def _sum(condition: str, value: str = "1") -> str:
    return f"sum(case when {condition} then {value} else 0 end)"


def _cut(p: float) -> str:
    return f"floor({p!r}e0 * num_rel + 0.9e0)"


def counts(level: int) -> dict[str, str]:
    r = f"rel >= {level}"
    return {"num_ret": "num_ret", "num_rel": "num_rel", "num_rel_ret": _sum(r), "num_nonrel_judged_ret": _sum(f"rel >= 0 and rel < {level}")}


def average(level: int) -> dict[str, str]:
    r = f"rel >= {level}"
    ap = _over(_sum(r, _over("cumrel", "rank")), "num_rel")
    binary = f"case when cumnonrel = 0 then 1e0 else 1 - {_d('least(cumnonrel, num_rel)')} / {_d('least(num_nonrel, num_rel)')} end"
    bpref = _over(_sum(r, binary), "num_rel")
    before, rest = "(cumrel - 1)", "(cumrel - 1 + cumnonrel)"
    expected = f"case when rank = 1 then 1e0 else 1e0 / rank + ({_d('rank')} - 1) / rank * ({_d(f'{rest} + cumunj')} / (rank - 1)) * (({before} + 1e-5) / ({rest} + 2e-5)) end"
    return {
        "map": ap, "bpref": bpref, "Rprec": _over(_sum(f"{r} and rank <= num_rel"), "num_rel"), "recip_rank": f"1e0 / min(case when {r} then rank end)",
        "infAP": _over(_sum(r, expected), "num_rel"), "binG": _over(_sum(r, f"{LN2} / ln({_d('2 + rank - cumrel')})"), "num_rel"),
        "gm_map": f"ln(greatest(coalesce({ap}, 0), 1e-5))", "gm_bpref": f"ln(greatest(coalesce({bpref}, 0), 1e-5))",
    }


def at_cutoffs(level: int, ks: Iterable[int] = CUTOFFS) -> dict[str, str]:
    out = {}
    for k in ks:
        hit = _sum(f"rel >= {level} and rank <= {k}")
        out |= {f"P_{k}": _over(hit, str(k)), f"recall_{k}": _over(hit, "num_rel"), f"relative_P_{k}": _over(hit, f"least({k}, num_rel)")}
        out[f"map_cut_{k}"] = _over(_sum(f"rel >= {level} and rank <= {k}", _over("cumrel", "rank")), "num_rel")
    return out | {f"success_{k}": f"max(case when rel >= {level} and rank <= {k} then 1 else 0 end)" for k in (1, 5, 10)}


def interpolated(level: int, points: Iterable[float] = RECALLS) -> dict[str, str]:
    """c = 0 takes the best precision anywhere, c over the relevant documents retrieved gives 0."""
    one = {p: f"coalesce(max(case when cumrel >= {_cut(p)} then {_over('cumrel', 'rank')} end), 0)" for p in points}
    return {f"iprec_at_recall_{p:.2f}".replace(".", "_"): x for p, x in one.items()} | {"avg_11pt": f"({' + '.join(one.values())}) / {len(one)}"}


def multiples(level: int, xs: Iterable[float] = MULTIPLES) -> dict[str, str]:
    return {f"Rprec_mult_{x:.2f}".replace(".", "_"): _over(_sum(f"rel >= {level} and rank <= {_cut(x)}"), _cut(x)) for x in xs}


def sets(level: int, x: float = 1.0, weights: tuple[float, ...] = (1.0, -1.0, 0.0, 0.0), docs: int = 1_000_000) -> dict[str, str]:
    if len(weights) != 4:
        raise ValueError("utility takes four weights")
    hit = _sum(f"rel >= {level}")
    p, r = f"({_over(hit, 'num_ret')})", f"(coalesce({_over(hit, 'num_rel')}, 0))"
    a, b, c, d = weights
    return {
        "set_P": p, "set_recall": r, "set_relative_P": _over(hit, "least(num_ret, num_rel)"), "set_map": f"{p} * {r}", "set_F": f"({x}e0 + 1) * {p} * {r} / nullif({r} + {x}e0 * {p}, 0)",
        "utility": f"{a}e0 * {hit} + {b}e0 * (num_ret - {hit}) + {c}e0 * (num_rel - {hit}) + {d}e0 * ({docs} - num_ret - num_rel + {hit})",
    }


def gains(level: int, ks: Iterable[int] = CUTOFFS) -> dict[str, str]:
    """Linear gains; need ideal columns: ideal_total (DCG of the whole ideal list) and ideal_<k>."""
    gain = f"case when rel > 0 then rel * {LN2} / ln({_d('rank')} + 1) else 0 end"
    out = {"ndcg": f"sum({gain}) / nullif(max(ideal_total), 0)"}
    return out | {f"ndcg_cut_{k}": f"sum(case when rank <= {k} then {gain} else 0 end) / nullif(max(ideal_{k}), 0)" for k in ks}


def relative_gains(level: int) -> dict[str, str]:
    """Need dcg, gain, idcg (the ideal DCG at the rank, constant behind its end), ideal, ideal_next, cost, cumgain."""
    at_end = "max(case when rank = num_ret then dcg end)"
    unseen = f"(num_gain - {_sum('gain > 0')}) * {at_end} / max(ideal_total)"
    edge = "ideal is not null and ideal <> ideal_next"
    edges_behind = "max(late)"
    return {
        "ndcg_rel": f"({_sum('gain > 0', 'dcg / idcg')} + {unseen}) / nullif(num_gain, 0)",
        "Rndcg": f"case when num_rel = 0 then 0 else ({_sum(edge, 'dcg / idcg')} + coalesce({edges_behind}, 0) * {at_end} + case when num_ret > num_gain + 1 then {at_end} / max(ideal_total) else 0 end) / nullif(max(edges) + case when num_ret > num_gain + 1 then 1 else 0 end, 0) end",
        "G": "sum(case when gain > 0 then gain * ln(cast(2 as double)) / ln(2 + cost - cumgain) else 0 end) / nullif(max(ideal_gain), 0)",
    }


FAMILIES: dict[str, Maker] = {"counts": counts, "average": average, "cutoffs": at_cutoffs, "interpolated": interpolated, "multiples": multiples, "sets": sets, "gains": gains, "relative_gains": relative_gains}
#: How topics' values become one: counts are added up, gm_ values are logarithms whose mean is raised again, the rest is averaged.
SUMMED = frozenset(counts(1))


def with_ideal(rows: DataFrame, qrels: DataFrame, ks: Iterable[int] = CUTOFFS) -> DataFrame:
    best = ideal(qrels)
    total = best.groupBy("qid").agg(F.max("ideal_dcg").alias("ideal_total"), *(F.max(F.when(F.col("pos") <= k, F.col("ideal_dcg"))).alias(f"ideal_{k}") for k in ks))
    return rows.join(total, "qid", "left")


def with_positions(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ideal list beside the actual one, position by position; late: sum of 1 / ideal DCG over boundaries behind the last rank."""
    best = ideal(qrels)
    n = rows.groupBy("qid").agg(F.max("num_ret").alias("n"))
    edge = F.col("ideal") != F.col("ideal_next")
    total = best.join(n, "qid").groupBy("qid").agg(
        F.max("ideal_dcg").alias("ideal_total"), F.max("ideal_cost").alias("all_cost"), F.sum("ideal").alias("ideal_gain"), F.max("pos").alias("last"), F.count_if(edge).alias("edges"), F.sum(F.when(edge & (F.col("pos") > F.col("n")), 1 / F.col("ideal_dcg"))).alias("late")
    )
    rows = rows.withColumn("gain", F.greatest(F.col("rel"), F.lit(0)).cast("double"))
    rows = running(rows, dcg=F.col("gain") * F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0), cumgain=F.col("gain"))
    return (
        rows.join(best.withColumnRenamed("pos", "rank"), ["qid", "rank"], "left")
        .join(total, "qid", "left")
        .withColumn("idcg", F.coalesce("ideal_dcg", "ideal_total"))
        .withColumn("cost", F.coalesce(F.col("ideal_cost"), F.col("all_cost") + F.col("rank") - F.col("last")).cast("double"))
    )


def evaluate(run: DataFrame, qrels: DataFrame, families: Iterable[str] = ("counts", "average", "cutoffs"), level: int = 1, judged_only: bool = False, top: int | None = None, complete: bool = False, exprs: dict[str, str] | None = None) -> DataFrame:
    """(qid, measure...) for the topics in both inputs; complete adds topics that the run misses, with zeros. exprs: expressions by name in place of families."""
    families = list(families) if exprs is None else []
    exprs = {k: v for f in families for k, v in FAMILIES[f](level).items()} if exprs is None else exprs
    used = " ".join(exprs.values())
    by_position = "idcg" in used or "cumgain" in used  # of all other expressions, documents outside the pool change nothing
    rows = ranked(run, qrels, level, judged_only, top, docs=False, pooled=not by_position)
    cuts = sorted({int(k) for k in re.findall(r"ideal_(\d+)", used)})
    if "ideal_total" in used or cuts:
        rows = with_ideal(rows, qrels, cuts)
    if by_position:
        rows = with_positions(rows.drop("ideal_total"), qrels)  # it brings its own
    return _values(rows, qrels, exprs, complete)


def _values(rows: DataFrame, qrels: DataFrame, exprs: dict[str, str], complete: bool) -> DataFrame:
    keys = [k for k in ("qid", "num_ret", "num_rel", "num_nonrel", "num_gain") if k in rows.columns]
    out = rows.groupBy(*keys).agg(*(F.expr(f"coalesce({v}, 0)").alias(f"m_{k}") for k, v in exprs.items() if v not in keys))
    out = out.select("qid", *(F.col(v if v in keys else f"m_{k}").alias(k) for k, v in exprs.items()))
    if complete:
        missing = {k: F.lit(-11.512925464970229) if k.startswith("gm_") else F.lit(0) for k in exprs}
        out = qrels.select("qid").distinct().join(out, "qid", "left").select("qid", *(F.coalesce(F.col(k), v).alias(k) for k, v in missing.items()))
    return out


def long_form(values: DataFrame) -> DataFrame:
    """(measure, qid, value), one row for each."""
    names = [c for c in values.columns if c != "qid"]
    return values.select("qid", F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("x.measure", F.col("qid").cast("string").alias("qid"), "x.value")


def summarise(values: DataFrame) -> DataFrame:
    """(measure, qid = 'all', value): sums of counts, geometric means of gm_ measures, means of the others, and num_q."""
    each = long_form(values).groupBy("measure").agg(F.sum("value").alias("s"), F.avg("value").alias("a"))
    value = F.when(F.col("measure").isin(*SUMMED), F.col("s")).when(F.col("measure").startswith("gm_"), F.exp("a")).otherwise(F.col("a"))
    return each.select("measure", F.lit("all").alias("qid"), value.alias("value")).union(values.agg(F.lit("num_q").alias("measure"), F.lit("all").alias("qid"), F.countDistinct("qid").cast("double").alias("value")))


def relevance_string(run: DataFrame, qrels: DataFrame, n: int = 10, level: int = 1) -> DataFrame:
    """(qid, relstring): the codes of the first n documents: a digit, > over 9, - outside the pool, . unjudged."""
    code = F.when(F.col("rel") > 9, ">").when(F.col("rel") == -1, "-").when(F.col("rel") == -2, ".").when(F.col("rel") < 0, "<").otherwise(F.col("rel").cast("string"))
    first = ranked(run, qrels, level, top=n).select("qid", F.struct("rank", code.alias("code")).alias("x"))
    return first.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["code"]), "").alias("relstring"))


def by_group(
    run: DataFrame, qrels_jg: DataFrame, families: Iterable[str] = ("average", "cutoffs", "multiples"), level: int = 1, exprs: dict[str, str] | None = None, suffix: str = "_avgjg", **options
) -> DataFrame:
    """Each measure per judgment group, averaged over a topic's groups. The topic and group make up one key, so nothing is joined across groups. exprs and options as of evaluate.

    The run is ranked once for all groups. Where a measure needs more than the documents in a group's pool, it is repeated for each group.
    """
    exprs = {k: v for f in families for k, v in FAMILIES[f](level).items()} if exprs is None else exprs
    key = F.struct("qid", "jg").alias("qid")
    judged = qrels_jg.select(key, "docno", "rel")
    if options.get("judged_only") or re.search("num_ret|ideal|cumgain|idcg", " ".join(exprs.values())):
        groups = qrels_jg.select("qid", "jg").distinct()
        values = evaluate(run.join(groups, "qid").select(key, "docno", "sim"), judged, level=level, exprs=exprs, **options)
    else:
        values = _values(ranked_groups(run, qrels_jg, level, options.get("top")), judged, exprs, options.get("complete", False))
    return values.withColumn("qid", F.col("qid.qid")).groupBy("qid").agg(*(F.avg(c).alias(f"{c}{suffix}") for c in values.columns if c != "qid"))


def z_scores(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(measure, qid, value) of long values against reference (qid, measure, mean, stddev), before any averaging.

    A standard deviation of 0 gives 0 where value and mean agree and -1000000 elsewhere, and so does a missing reference.
    """
    z = F.when(F.col("mean").isNull(), -1_000_000.0).when(F.col("stddev") == 0, F.when(F.col("value") == F.col("mean"), 0.0).otherwise(-1_000_000.0)).otherwise((F.col("value") - F.col("mean")) / F.expr("nullif(stddev, 0)"))
    return values.join(reference, ["qid", "measure"], "left").select("measure", "qid", z.alias("value"))
