"""Filters and counters of a text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bodies of this many bytes or more are left out.
MAX_BODY = 512 * 1024


def with_content(pages: DataFrame) -> DataFrame:
    """Rows whose html, url and body are all there; of (url, html, body) those that the table has."""
    for c in ("html", "url", "body"):
        if c in pages.columns:
            pages = pages.filter(F.col(c).isNotNull())
    return pages


def small_bodies(pages: DataFrame, limit: int = MAX_BODY) -> DataFrame:
    return pages.filter(F.octet_length("body") < limit)


def counters(pages: DataFrame, limit: int = MAX_BODY) -> DataFrame:
    """(counter, value): pages read, pages without content or with too large a body, and pages beside a topic; of (url, body, qid), one pass."""
    missing = F.col("url").isNull() | F.col("body").isNull()
    bad = missing | (F.octet_length("body") >= limit)
    one = pages.agg(F.count("*").alias("pages"), F.count_if(F.coalesce(bad, F.lit(True))).alias("errors"), F.count_if(~F.coalesce(bad, F.lit(True)) & F.col("qid").isNotNull()).alias("qid_pages"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")
