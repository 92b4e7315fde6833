"""Merkle manifest of a dataset: a tree over the rows of each source, and one over the sources.

The node store is external memory. Leaves are sorted into runs by (source, id) and numbered there; nodes are Parquet tables partitioned by level, and
a node's coordinate is (source, level, place). A pass reads the level that the pass before ended with, in the order of places, and
builds LEVELS further levels, each task block by block: a block is RUN ** LEVELS nodes of a source in a row, so no source is a task's work.
Proofs come from the other direction: from the top down, a scan in the order of coordinates merges each block's nodes with the path of the block itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, write_shared

RUN = 3
LEVELS = 6
BLOCK = RUN**LEVELS
#: Rows of a sorted run, about.
SORTED_ROWS = 500_000
_NODES = "key string, idx bigint, digest string, level int"
_SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
#: The level under which the store keeps the last node of every tree.
TOP = -1


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of values one after another, each as its UTF-8 byte count, a colon and itself, or - if null."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with its number, the number of their key in it, and their place among the key's rows in it."""
    part, run, last, at = TaskContext.get().partitionId(), -1, None, 0
    for b in batches:
        keys = b["key"].to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        new = np.empty(len(keys), bool)
        new[0], new[1:] = keys[0] != last, keys[1:] != keys[:-1]
        place = np.arange(len(keys))
        begin = np.maximum.accumulate(np.where(new, place, -1))
        place = np.where(begin < 0, place + at, place - begin)
        runs = run + np.cumsum(new)
        run, last, at = int(runs[-1]), keys[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(keys), part), pa.int32()), pa.array(runs, pa.int64()), pa.array(place, pa.int64())], names=[*b.schema.names, "part", "run", "at"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx, their place among the rows of equal key (a string without nulls) in the order of columns order, written as sorted runs.

    A key may run on over any number of partitions: of each partition the driver reads how many rows its first and its last key have.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // SORTED_ROWS), min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    by = [F.asc_nulls_first(c) for c in ("key", *order)]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, run bigint, at bigint"
    runs = write_shared(dealt.mapInArrow(_number, schema), "runs")
    ends = runs.groupBy("part", "run").agg(F.md5(F.min("key")).alias("key"), F.count("*").alias("n")).groupBy("part").agg(
        F.min_by(F.struct("key", "n"), "run").alias("first"), F.max_by(F.struct("key", "n"), "run").alias("last"), F.max("run").alias("runs")
    )
    before, key, total = [], None, 0
    for part, first, last, more in sorted(ends.collect(), key=lambda r: r[0]):  # a row for each partition
        if first.key == key:
            before.append((part, 0, total))
        total = last.n if more else first.n + (total if first.key == key else 0)
        key = last.key
    if not before:
        return runs.withColumn("idx", F.col("at")).drop("part", "run", "at")
    offsets = F.broadcast(spark.createDataFrame(before, "part int, run bigint, before bigint"))
    return runs.join(offsets, ["part", "run"], "left").withColumn("idx", F.col("at") + F.coalesce("before", F.lit(0))).drop("part", "run", "at", "before")


def _parents(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]


def _build(level: int):
    """The nodes over blocks that come in order, as (key, idx, digest, level). A tree that is one block short of full ends there with its last node, kept as TOP too."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key, block), rows in groupby(_rows(batches), lambda r: r[:2]):
            nodes = [r[3] for r in rows]
            whole = block == 0 and len(nodes) < BLOCK
            for step in range(1, LEVELS + 1):
                if whole and len(nodes) == 1:
                    yield key, 0, nodes[0], TOP
                    break
                nodes = _parents(nodes)
                for i, x in enumerate(nodes):
                    yield key, block * RUN ** (LEVELS - step) + i, x, level + step

    schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("digest", pa.string()), ("level", pa.int32())])
    return lambda batches: _batches(blocks(batches), schema)


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.select("key", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "digest")


class NodeStore:
    """The nodes over numbered leaves (key, idx, digest): a Parquet table partitioned by level, built pass by pass."""

    def __init__(self, leaves: DataFrame, name: str):
        self.spark, self.leaves, self.path, self.passes = leaves.sparkSession, leaves.select("key", "idx", "digest"), shared_path(leaves.sparkSession, name), 0
        current = self.leaves
        while True:
            level = self.passes * LEVELS
            built = _blocked(current).repartition("key", "block").sortWithinPartitions("key", "block", "idx").mapInArrow(_build(level), _NODES)
            built.write.mode("append").option("compression", "zstd").partitionBy("level").parquet(self.path)
            self.passes += 1
            current = self.level(level + LEVELS)
            if current.isEmpty():
                break

    def level(self, level: int) -> DataFrame:
        if level == 0:
            return self.leaves
        return self.spark.read.schema(_NODES).parquet(self.path).filter(F.col("level") == level).drop("level")

    def tops(self) -> DataFrame:
        """(key, digest) of the last node of every tree."""
        return self.level(TOP).select("key", "digest")

    def _scan(self, number: int, above: DataFrame, tops: DataFrame, leaves: DataFrame) -> DataFrame:
        """All that the blocks of a pass need, in the order of coordinates: the block's own path, or else its tree's, then its nodes level by level."""
        blank = {c: F.lit(None).cast("string").alias(c) for c in ("digest", "forged", "head", "path")} | {"doc_id": F.lit(None).cast("bigint").alias("doc_id")}
        shape = ["key", "block", "kind", "step", "idx", "digest", "forged", "doc_id", "head", "path"]

        def row(df: DataFrame, block: str, kind: int, step: int) -> DataFrame:
            have = df.withColumn("block", F.expr(block)).withColumn("kind", F.lit(kind)).withColumn("step", F.lit(step))
            return have.select(*(F.col(c) if c in have.columns else blank[c] for c in shape))

        out = row(above, "idx", 0, 0).unionByName(row(tops.withColumn("idx", F.lit(0).cast("bigint")), "cast(0 as bigint)", 1, 0))
        for step in range(LEVELS):
            nodes = leaves if number == step == 0 else self.level(number * LEVELS + step)
            out = out.unionByName(row(nodes, f"idx div {RUN ** (LEVELS - step)}", 2, step))
        return out.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "step", "idx")

    def paths(self, tops: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
        """(key, idx, head, path) of every leaf, from tops (key, head, path) of every tree: the siblings on the way up, as left,right| for each level.

        With leaves (the store's, with forged and doc_id) instead (doc_id, leaf, head, proof, folded): the digest of the siblings, and what the forged leaf (else
        the leaf) folds to with them. So the paths of leaves themselves are never stored.
        """
        above = self.spark.createDataFrame([], "key string, idx bigint, head string, path string")
        for number in range(self.passes - 1, -1, -1):
            last = number == 0 and leaves is not None
            scan = self._scan(number, above, tops, leaves if last else self.leaves)
            if last:
                return scan.mapInArrow(_fold, "doc_id bigint, leaf string, head string, proof string, folded string")
            above = scan.mapInArrow(_climb, "key string, idx bigint, head string, path string")
            if number:
                above = write_shared(above, "paths")
        return above


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple], list[list[str]], str, str, int]]:
    """(key, items, nodes by step, head, path, number of steps) of every block; items are its lowest nodes."""
    for (key, _block), rows in groupby(_rows(batches), lambda r: r[:2]):
        head, path, own, items, nodes = "", "", False, [], [[] for _ in range(LEVELS)]
        for r in rows:
            if r[2] < 2:
                if not own:
                    head, path, own = r[8], r[9], r[2] == 0
            else:
                nodes[r[3]].append(r[5])
                if r[3] == 0:
                    items.append(r)
        if items:
            yield key, items, nodes, head, path, LEVELS if own else next(s for s in range(LEVELS + 1) if s == LEVELS or len(nodes[s]) == 1)


def _siblings(nodes: list[list[str]], i: int, steps: int) -> list[tuple[str, str]]:
    out = []
    for s in range(steps):
        a = i - i % RUN
        out.append(("".join(nodes[s][a:i]), "".join(nodes[s][i + 1 : a + RUN])))
        i //= RUN
    return out


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, items, nodes, head, path, steps in _scanned(batches):
            for i, r in enumerate(items):
                yield key, r[4], head, "".join(f"{a},{b}|" for a, b in _siblings(nodes, i, steps)) + path

    return _batches(rows(), pa.schema([("key", pa.string()), ("idx", pa.int64()), ("head", pa.string()), ("path", pa.string())]), 2_000)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for _key, items, nodes, head, path, steps in _scanned(batches):
            upper = [x.split(",") for x in path.split("|")[:-1]]
            tail = "".join(a + b for a, b in upper)
            known: dict[str, str] = {}  # most leaves of a block fold to the same node
            for i, r in enumerate(items):
                beside = _siblings(nodes, i, steps)
                top = r[6] or r[5]
                for a, b in beside:
                    top = digest(a + top + b)
                if top not in known:
                    x = top
                    for a, b in upper:
                        x = digest(a + x + b)
                    known[top] = x
                yield r[7], r[5], head, digest("".join(a + b for a, b in beside) + tail), known[top]

    return _batches(rows(), pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("head", pa.string()), ("proof", pa.string()), ("folded", pa.string())]))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, forged) of every row; key is the source with s before it, or empty if null, and forged the leaf without the text's line ends where the id's CRC-32 is even."""
    doc_id = F.col("doc_id").cast("bigint")
    bare = [F.col(c) for c in ("source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    cut = leaf_digest(doc_id, *bare, F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("key"),
        doc_id.alias("doc_id"),
        leaf_digest(doc_id, *bare, text).alias("digest"),
        F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, cut).alias("forged"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (doc_id, source, lang, n_chars, text).

    Rows of a source stand in the order of doc_id, null first, and of their leaf where ids repeat; repeated rows are leaves each. Nulls in any column are part of the leaf; a null id is never
    tampered with. Empty and very long texts are leaves like others. An empty table gives no rows. Other columns are ignored, whatever their names. Each row is proved against the stored tree
    with the leaf that its tampered text gives, or its own.
    """
    spark: SparkSession = docs.sparkSession
    base = numbered(write_shared(leaves(docs), "leaves"), "doc_id", "digest")
    store = NodeStore(base, "nodes")
    sources = numbered(store.tops().select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "source")
    over = NodeStore(sources, "source-nodes")
    top = over.tops().first()
    if top is None:
        return spark.createDataFrame([], _SCHEMA)
    whole = over.paths(spark.createDataFrame([("", "", "")], "key string, head string, path string"))
    subs = write_shared(whole.select("idx", "path").join(sources.select("idx", F.col("source").alias("key"), F.col("digest").alias("head")), "idx").select("key", "head", "path"), "source-paths")
    found = store.paths(subs, base)
    return found.select(
        "doc_id", "leaf", F.col("head").alias("subroot"), F.lit(top.digest).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == top.digest).alias("verified")
    )
