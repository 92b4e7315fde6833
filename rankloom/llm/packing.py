"""Packing into length buckets that pad least.

Texts are cut into pieces of at most max_tokens tokens. The histogram of piece lengths over the whole input has at most max_tokens
entries; a dynamic programme over it finds the bucket boundaries with the least padding. In each bucket, batches of
token_budget // boundary pieces are formed, within shards of a bounded number of pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

#: Pieces of a bucket that one window orders, about.
SHARD = 20_000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (each a length that occurs) that minimise the sum of boundary - length; ties go to the smaller previous boundary."""
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(x)
    buckets = min(buckets, n)
    if not n:
        return []
    cum, mass = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    # cost[j]: lengths up to the j-th in some buckets; what a bucket (i, j] pads is x[j] * (cum[j + 1] - cum[i]) - (mass[j + 1] - mass[i])
    cost = x * cum[1:] - mass[1:]
    back = []
    for _ in range(1, buckets):
        new, choice = cost.copy(), np.full(n, -1)
        for j in range(1, n):
            total = cost[:j] + x[j] * (cum[j + 1] - cum[1 : j + 1]) - (mass[j + 1] - mass[1 : j + 1])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], choice[j] = total[i], i
        cost = new
        back.append(choice)
    out, j = [], n - 1
    for choice in reversed(back):
        out.append(int(x[j]))
        if choice[j] < 0:
            continue
        j = int(choice[j])
    out.append(int(x[j]))
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = 8, max_tokens: int = 2048, token_budget: int = 65_536, tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bucket_tokens, shard, batch, slot) for every piece of every row of docs (doc_id, text).

    Piece i of a text has its tokens from i * max_tokens on. A batch is named by (bucket_tokens, shard, batch) and holds at most
    token_budget tokens with padding (one piece if a boundary exceeds that); slot numbers its pieces. tokens turns the text column into a count; words by default. Null, empty
    and blank texts have no tokens and give no piece. Repeated rows are packed each. Shards are dealt by a hash of id, piece and text, so neither ids
    in steps nor many rows without an id fill one. Other columns are ignored. No piece is dropped.
    """
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.coalesce("text", F.lit(""))).alias("total"), F.xxhash64("text").alias("salt")).filter("total > 0")
    pieces = write_shared(
        counted.select("doc_id", "total", "salt", F.explode(F.sequence(F.lit(0), F.expr(f"cast((total - 1) div {max_tokens} as int)"))).alias("piece")).select(
            "doc_id", "salt", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * F.lit(max_tokens).cast("bigint")).alias("first_token"), F.least(F.col("total") - F.col("piece") * max_tokens, F.lit(max_tokens)).cast("bigint").alias("n_tokens")
        ),
        "pieces",
    )
    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most max_tokens rows
    bounds = optimal_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket = shards = size = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        below = max([x for x in bounds if x < b], default=0)
        n = sum(r[1] for r in histogram if below < r[0] <= b)
        inside = F.col("n_tokens") <= b
        bucket = F.when(inside, F.lit(b).cast("bigint")).otherwise(bucket)
        shards = F.when(inside, F.lit(-(-n // SHARD)).cast("bigint")).otherwise(shards)
        size = F.when(inside, F.lit(max(1, token_budget // b)).cast("bigint")).otherwise(size)
    placed = pieces.select("*", bucket.alias("bucket_tokens"), size.alias("size"), F.pmod(F.xxhash64("doc_id", "piece", "salt"), shards).alias("shard"))
    order = Window.partitionBy("bucket_tokens", "shard").orderBy("doc_id", "piece", "salt")
    return placed.withColumn("at", F.row_number().over(order) - 1).select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", "shard", F.expr("cast(at div size as bigint)").alias("batch"), (F.col("at") % F.col("size")).cast("bigint").alias("slot")
    )
