"""URL filters: fixed rules on hosts and paths, and for all other urls a tree of path templates for each host.

Runs of digits and long hexadecimal runs in a segment become #. Then the tree grows a level at a time, from each host's root down: under each node the
branches with more bad pages than their siblings by a chi-squared test are merged into one wildcard *+ (a single one keeps its name), those with fewer into *-, and all others, rare
ones among them, into *. So what varies from page to page, and what differs without a difference in labels, is one template. A node's share of bad pages is
smoothed towards its parent's, the host's towards that of all pages; templates whose share is above the threshold are rejected.

Everything is counted over all pages. The tables of the tree have a row for each different (host, segments), pre-aggregated in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: The rules of the query, and their verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Levels of the tree; segments below are one last wildcard.
DEPTH = 6
#: Pages that a branch needs to stay by itself.
SUPPORT = 20
#: Chi-squared value (one degree of freedom, 1 %) from which a branch differs from its siblings.
DIFFERENT = 6.634897
#: Labelled pages that the parent's share counts as, and the share of bad ones above which a template is rejected; without any label all stay at 0.5.
WEIGHT = 4.0
REJECT = 0.5
#: What ends a template whose pages end there, and one whose pages go on below the tree. No segment is empty or has a slash.
END, DEEPER = "", "/**"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path, split at the first slash) that fits, or null: its host is the url's or a parent domain, and its path begins the url's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9A-Fa-f]{16,}", "#"), "[0-9]+", "#")
    parts = F.filter(F.split(plain, "/"), lambda s: s != "")
    return F.concat(F.slice(parts, 1, DEPTH), F.array(F.when(F.size(parts) > DEPTH, F.lit(DEEPER)).otherwise(F.lit(END))))


def page_labels(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labels (doc_id, quality, toxic): bad, 0 or 1, if any row of the page has quality 0 or is toxic."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.max(F.expr("cast(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 as bigint)")).alias("bad"))


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """The tree's rows with the level's branches decided: rows of (host, segs, pages, labelled, bad, node, share) get their node at that level and its share."""
    here = rows.filter(F.size("segs") > level).withColumn("seg", F.get("segs", F.lit(level)))
    branch = here.groupBy("host", "node", "seg").agg(F.sum("pages").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    total = branch.groupBy("host", "node").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    l, b, tl, tb = (F.col(c).cast("double") for c in ("l", "b", "tl", "tb"))
    cross = b * (tl - l) - (tb - b) * l
    below = l * (tl - l) * tb * (tl - tb)
    differs = F.when(below > 0, cross * cross * tl / below >= DIFFERENT).otherwise(False)
    end, differs = F.col("seg").isin(END, DEEPER), (F.col("n") >= SUPPORT) & differs
    kind = F.when(end, F.concat(F.lit("="), "seg")).when(differs & (cross > 0), "+").when(differs, "-").otherwise("")
    decided = branch.join(total, ["host", "node"]).select("host", "node", "seg", kind.alias("kind"), "l", "b")
    stats = decided.groupBy("host", "node", "kind").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("branches"), F.min("seg").alias("one"))
    alone = F.col("kind").isin("+", "-") & (F.col("branches") == 1) & ~F.startswith("one", F.lit("*"))
    name = F.when(F.startswith("kind", F.lit("=")) | alone, F.col("one")).otherwise(F.concat(F.lit("*"), "kind"))
    names = decided.select("host", "node", "seg", "kind").join(stats.withColumn("name", name), ["host", "node", "kind"])
    moved = here.join(names.select("host", "node", "seg", "name", "l", "b"), ["host", "node", "seg"]).select(
        "host", "segs", "pages", "labelled", "bad", F.concat("node", F.lit("/"), "name").alias("node"), ((F.col("b") + WEIGHT * F.col("share")) / (F.col("l") + WEIGHT)).alias("share")
    )
    return moved.union(rows.filter(F.size("segs") <= level))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segs, node, share) of every different (host, segs) of urls (host, segs, bad), bad null without a label: its template and that template's smoothed share of bad pages."""
    counted = urls.groupBy("host", "segs").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = write_shared(counted, "paths")
    most, labelled, bad = rows.agg(F.max(F.size("segs")), F.sum("labelled"), F.sum("bad")).first()
    if most is None:
        return rows.select("host", "segs", F.lit("").alias("node"), F.lit(0.0).alias("share"))
    overall = (bad + 0.5) / (labelled + 1.0)
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    rows = rows.join(hosts, "host").select("host", "segs", "pages", "labelled", "bad", F.lit("").alias("node"), ((F.col("b") + F.lit(WEIGHT * overall)) / (F.col("l") + WEIGHT)).alias("share"))
    for level in range(most):
        rows = write_shared(_grown(rows, level), "tree")
    return rows.select("host", "segs", "node", "share")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for every row of pages (page_id, url): the longest fitting rule's verdict, else block if the url's template is rejected, else allow.

    labels (doc_id, quality, toxic) label the pages of the same id; with few or none, shares stay near that of the host or of all pages. Null urls and ones without :// have an empty host and path,
    which is a host like others. Null ids have no label. Repeated rows count and are judged each. Urls and paths of any length are
    judged whole; segments from the (DEPTH + 1)-th on are one last wildcard. An empty table gives no rows. Other columns, html too, aren't read.
    """
    rules = RULES if rules is None else rules
    host, path = parsed(F.col("url"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("segs", _segments(F.col("path")))
    tree = templates(urls.join(page_labels(labels), "page_id", "left"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    fixed = F.lit(None).cast("string")
    for r, v in rules.items():
        fixed = F.when(F.col("rule") == r, F.lit(v)).otherwise(fixed)
    found = urls.join(tree, ["host", "segs"]).withColumn("rule", rule)
    return found.select("page_id", "host", "path", "rule", F.coalesce(fixed, F.when(F.col("share") > REJECT, "block").otherwise("allow")).alias("verdict"), F.col("node").alias("template"))
