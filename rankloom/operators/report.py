"""Measures by name, as an evaluation prints them: `map`, `P.5,10`, `ndcg.1=3,2=9`, `prefs_simp`, `P_avgjg.5`, or a nickname for several."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settings import cutoffs, gain_pairs
from . import measures as M
from . import preferences

#: What the nicknames stand for, in order.
NICKNAMES = {
    "official": "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P".split(),
    "set": "runid num_q num_ret num_rel num_rel_ret utility set_P set_recall set_relative_P set_map set_F".split(),
    "all_trec": (
        "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P relstring recall infAP gm_bpref utility 11pt_avg ndcg relative_P Rprec_mult success "
        "map_cut ndcg_cut ndcg_rel Rndcg binG G set_P set_recall set_relative_P set_map set_F num_nonrel_judged_ret"
    ).split(),
    "prefs": "runid num_q prefs_num_prefs_poss prefs_num_prefs_ful prefs_num_prefs_ful_ret prefs_simp prefs_pair prefs_avgjg".split(),
    "all_prefs": (
        "runid num_q prefs_num_prefs_poss prefs_num_prefs_ful prefs_num_prefs_ful_ret prefs_simp prefs_pair prefs_avgjg prefs_avgjg_Rnonrel "
        "prefs_simp_ret prefs_pair_ret prefs_avgjg_ret prefs_avgjg_Rnonrel_ret prefs_simp_imp prefs_pair_imp prefs_avgjg_imp"
    ).split(),
    "qrels_jg": "runid num_q map_avgjg P_avgjg Rprec_mult_avgjg".split(),
}
#: The measures that are averaged over a topic's judgment groups.
BY_GROUP = {"map_avgjg": "map", "P_avgjg": "P", "Rprec_mult_avgjg": "Rprec_mult"}
SUMMED = M.SUMMED | {f"prefs_num_prefs_{x}" for x in ("poss", "ful", "ful_ret")}
SUCCESS = (1, 5, 10)


def _numbers(text: str, kind=float) -> tuple:
    return tuple(cutoffs(",".join(str(kind(float(x))) for x in text.split(",")), kind))


def _label(prefix: str, x: float) -> str:
    return f"{prefix}_{x:.2f}"


def expressions(name: str, params: str, level: int) -> dict[str, str]:
    """Printed names and expressions of one measure."""
    for family in (M.counts(level), M.average(level)):
        if name in family:
            return {name: family[name]}
    if name in ("P", "recall", "relative_P", "map_cut"):
        ks = _numbers(params, int) if params else M.CUTOFFS
        every = M.at_cutoffs(level, ks)
        return {f"{name}_{k}": every[f"{name}_{k}"] for k in ks}
    if name == "success":
        return {f"success_{k}": f"max(case when rel >= {level} and rank <= {k} then 1 else 0 end)" for k in (_numbers(params, int) if params else SUCCESS)}
    if name in ("iprec_at_recall", "11pt_avg"):
        points = _numbers(params) if params else M.RECALLS
        every = M.interpolated(level, points)
        return {"11pt_avg": every["avg_11pt"]} if name == "11pt_avg" else {_label(name, p): every[_label(name, p).replace(".", "_")] for p in points}
    if name == "Rprec_mult":
        xs = _numbers(params) if params else M.MULTIPLES
        every = M.multiples(level, xs)
        return {_label(name, x): every[_label(name, x).replace(".", "_")] for x in xs}
    if name == "utility" and params:
        return {name: M.sets(level, weights=tuple(float(x) for x in params.split(",")))[name]}
    if name == "set_F" and params:
        return {name: M.sets(level, x=float(params))[name]}
    if name in M.sets(level):
        return {name: M.sets(level)[name]}
    if name == "ndcg_cut":
        ks = _numbers(params, int) if params else M.CUTOFFS
        every = M.gains(level, ks)
        return {f"ndcg_cut_{k}": every[f"ndcg_cut_{k}"] for k in ks}
    if name == "ndcg":
        return {name: M.gains(level)[name]}
    if name in M.relative_gains(level):
        return {name: M.relative_gains(level)[name]}
    raise ValueError(f"no such measure: {name}")


def parse(texts: Iterable[str]) -> list[tuple[str, str]]:
    """(name, parameters) in order; nicknames are spelt out, a measure that is named again takes its last parameters."""
    found: dict[str, str] = {}
    for text in texts:
        for t in NICKNAMES.get(text, [text]):
            name, _, params = t.partition(".")
            if name in BY_GROUP:
                expressions(BY_GROUP[name], params, 1)
            elif name not in ("runid", "num_q", "relstring", *preferences.NAMES):
                expressions(name, "" if "=" in params else params, 1)  # fails on what isn't known
            found[name] = params
    return list(found.items())


def gain_of(rel: Column, gains: dict[int, float]) -> Column:
    """A judgment's gain: by the table, else the judgment itself; judgments below 0 stay."""
    table = F.create_map(*(F.lit(x) for k, v in gains.items() for x in (k, float(v))))
    return F.when(rel < 0, rel.cast("double")).otherwise(F.coalesce(table[rel], rel.cast("double")))


def evaluation(
    run: DataFrame, qrels: DataFrame | None, texts: Iterable[str] = ("official",), runid: str = "run", level: int = 1, per_topic: bool = False, only: str | None = None, prefs: DataFrame | None = None, qrels_jg: DataFrame | None = None, **options
) -> DataFrame:
    """(place, measure, qid, text, value): what an evaluation prints, topic by topic if asked and for all topics, in the order of the measures named.

    only: a single topic to look at. value is null for runid and relstring. options as of measures.evaluate. prefs_ measures are of prefs, _avgjg measures of
    qrels_jg, all others of qrels; a measure whose judgments aren't given is an error. num_q counts the topics that any of the judgments in use shares with the run.
    """
    if only is not None:
        run = run.filter(F.col("qid").cast("string") == only)
    asked = parse(texts)
    places = {name: i for i, (name, _) in enumerate(asked)}
    groups: dict[str, dict[str, str]] = {}
    of_groups: dict[str, str] = {}
    of_prefs: list[str] = []
    where: dict[str, tuple[int, int]] = {}
    for name, params in asked:
        if name in preferences.NAMES:
            of_prefs.append(name)
            where[name] = (places[name], 0)
        elif name in BY_GROUP:
            for i, (label, x) in enumerate(expressions(BY_GROUP[name], params, level).items()):
                label = name + label.removeprefix(BY_GROUP[name])
                of_groups[label] = x
                where[label] = (places[name], i)
        elif name not in ("runid", "num_q", "relstring"):
            gains = params if "=" in params else ""
            for i, (label, x) in enumerate(expressions(name, "" if gains else params, level).items()):
                groups.setdefault(gains, {})[label] = x
                where[label] = (places[name], i)
    for needed, given, what in ((groups or "relstring" in places, qrels, "qrels"), (of_groups, qrels_jg, "qrels_jg"), (of_prefs, prefs, "prefs")):
        if needed and given is None:
            raise ValueError(f"measures of {what} are named, but {what} isn't given")

    def named(values: DataFrame, labels: Iterable[str]) -> DataFrame:
        names = F.create_map(*(F.lit(x) for i, label in enumerate(labels) for x in (f"m{i}", label)))
        return M.long_form(values).withColumn("measure", names[F.col("measure")])

    parts = []
    for gains, exprs in groups.items():
        judged = qrels.withColumn("rel", gain_of(F.col("rel"), gain_pairs(gains))) if gains else qrels
        parts.append(named(M.evaluate(run, judged, level=level, exprs={f"m{i}": x for i, x in enumerate(exprs.values())}, **options), exprs))
    if of_groups:
        parts.append(named(M.by_group(run, qrels_jg, level=level, exprs={f"m{i}": x for i, x in enumerate(of_groups.values())}, suffix="", **options), of_groups))
    if of_prefs:
        parts.append(M.long_form(preferences.by_name(run, prefs, of_prefs, top=options.get("top"), complete=options.get("complete", False))))
    if not parts:  # only runid, num_q or relstring
        both = next(x for x in (qrels, prefs, qrels_jg) if x is not None).select("qid").distinct().join(run.select("qid").distinct(), "qid")
        parts.append(both.select(F.lit(None).cast("string").alias("measure"), F.col("qid").cast("string").alias("qid"), F.lit(None).cast("double").alias("value")))
    every = reduce(DataFrame.union, parts)
    topics = every.filter("measure is not null")
    order = F.create_map(*(F.lit(x) for label, (i, j) in where.items() for x in (label, i * 1000 + j))) if where else F.create_map(F.lit(""), F.lit(0))
    whole = F.col("measure").rlike("^(prefs_)?num_")
    kind = F.when(F.col("measure").startswith("gm_"), F.exp(F.avg("value"))).when(F.col("measure").isin(*SUMMED), F.sum("value")).otherwise(F.avg("value"))
    total = topics.groupBy("measure").agg(kind.alias("value")).select("measure", F.lit("all").alias("qid"), "value")
    rows = (topics.union(total) if per_topic else total).withColumn("place", order[F.col("measure")])
    shown = F.when(whole, F.format_string("%d", F.col("value").cast("bigint"))).otherwise(F.format_string("%6.4f", F.col("value")))
    out = rows.select("place", "measure", "qid", shown.alias("text"), "value")
    none = F.lit(None).cast("double")
    if "num_q" in places:
        kinds = [*parts[: 1 if groups else 0], *parts[len(groups) :]]  # gain tables share their topics
        n = reduce(DataFrame.union, kinds).agg(F.countDistinct("qid").alias("n"))
        out = out.union(n.select(F.lit(places["num_q"] * 1000), F.lit("num_q"), F.lit("all"), F.col("n").cast("string"), F.col("n").cast("double")))
    if "runid" in places:
        out = out.union(run.sparkSession.range(1).select(F.lit(places["runid"] * 1000), F.lit("runid"), F.lit("all"), F.lit(runid), none))
    if "relstring" in places and per_topic:
        n = int(dict(asked)["relstring"] or 10)
        strings = M.relevance_string(run, qrels, n, level)
        out = out.union(strings.select(F.lit(places["relstring"] * 1000), F.lit("relstring"), F.col("qid").cast("string"), F.concat(F.lit("'"), "relstring", F.lit("'")), none))
    return out


def lines(evaluated: DataFrame, z: bool = False) -> DataFrame:
    """The printed lines, topics first and in order, then those for all."""
    name = F.concat(F.lit("Z" if z else ""), F.col("measure"))
    return evaluated.orderBy(F.col("qid") == "all", "qid", "place").select(F.format_string("%-22s\t%s\t%s", name, "qid", "text").alias("value"))
