"""Prefix trie of conversations, built family by family.

A family is the conversations of one base id. Its conversations are rebuilt together (the base's first turns stand before the others' own), and the
family's nodes are counted where the family lies; only these combined nodes are shuffled and merged into the global trie. A node is named by
128 bits, the sums of hashes of (depth, turn) over its turns, so names come from running sums.

What is asked of subtrees is solved on chains: the nodes with the same smallest member and the same number of members lie on one path without a branch
or an end between. Their sums travel up by pointer doubling, in as many rounds as the longest run of chains has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

#: Conversations of a family: ids from a multiple of it on.
FAMILY = 20
#: A conversation keeps fewer turns of its family's base than this.
SHARED = 4
#: Turn numbers of a conversation that one task orders; longer conversations are cut into slices of as many.
SLICE = 1 << 16
#: Ids of a node that are joined into one text before it is hashed.
IDS = 1 << 15
_LOW = 0xFFFFFFFF
_LANES = ("a", "b", "c", "d")
_EMPTY = hashlib.sha256(b"").hexdigest()


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint")


def turns(conversations: DataFrame) -> DataFrame:
    """(base, slice, conv, turn, role, head, t1, t2, words) of every row with an id; t1 and t2 are 128 bits of the turn's digest."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(conv.isNotNull()).select(
        conv.alias("conv"), turn.alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("head"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    cut = F.coalesce(F.expr(f"turn div {SLICE}"), F.lit(-(1 << 62)))
    return rows.select((F.col("conv") - F.col("conv") % FAMILY).alias("base"), cut.alias("slice"), "conv", "turn", "role", "head", _half(F.col("digest"), 1).alias("t1"), _half(F.col("digest"), 17).alias("t2"), "words")


def _names(sums: list[Column]) -> list[Column]:
    a, b, c, d = (s.bitwiseAND(F.lit(_LOW)) for s in sums)
    return [a.bitwiseOR(F.shiftleft(b, 32)), c.bitwiseOR(F.shiftleft(d, 32))]


def _family_nodes(rows: DataFrame, sliced: bool) -> DataFrame:
    """(k1, k2, depth, p1, p2, words, w, n, m, ends) of the nodes of each family: name, parent's name, words of the last turn and of all, members, the smallest of them, and those that end there.

    A family lies in one task; with sliced, each of its slices does, and counts and sums of the slices before are joined.
    """
    keys = ["base", "slice"] if sliced else ["base"]
    order = Window.partitionBy(*keys, "conv").orderBy(F.asc_nulls_first("turn"), "role", "head", "t1", "t2")
    own = rows.repartition(*keys).withColumn("i", F.row_number().over(order).cast("bigint") - 1)
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    if sliced:
        sizes = rows.groupBy("conv", "slice").agg(F.count("*").alias("size"))
        own = own.join(sizes.select("conv", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")), ["conv", "slice"]).withColumn("i", F.col("i") + F.col("before")).drop("before")
    first = own.filter((F.col("conv") == F.col("base")) & (F.col("i") < SHARED - 1)).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "words"))).alias("first"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    own = own.join(first, "base", "left").withColumn("h", h).withColumn("hb", F.least("h", F.coalesce(F.size("first"), F.lit(0)).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    root = F.struct(zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    none = F.filter(F.array(root), lambda _: F.lit(False))
    lent = F.transform(F.slice(F.coalesce("first", F.expr("array()")), 1, F.greatest(F.col("hb"), F.lit(0)).cast("int")), lambda x, j: F.struct((j + 1).cast("bigint").alias("depth"), x.t1.alias("t1"), x.t2.alias("t2"), x.words.alias("words")))
    lent = F.when(F.col("first").isNull(), none).otherwise(lent)
    mine = F.struct((F.col("hb") + F.col("i") - F.col("h") + 1).alias("depth"), F.col("t1"), F.col("t2"), F.col("words"))
    parts = F.concat(F.when(F.col("i") == 0, F.concat(F.array(root), lent)).otherwise(none), F.when(F.col("i") >= F.col("h"), F.array(mine)).otherwise(none))
    path = own.select(*keys, "conv", F.explode(parts).alias("x")).select(*keys, "conv", "x.*")
    x, y = F.xxhash64("depth", "t1"), F.xxhash64("depth", "t2", F.lit(1))
    inner = F.col("depth") > 0
    lanes = {"a": x.bitwiseAND(F.lit(_LOW)), "b": F.shiftrightunsigned(x, 32), "c": y.bitwiseAND(F.lit(_LOW)), "d": F.shiftrightunsigned(y, 32)}
    path = path.select("*", *(F.when(inner, v).otherwise(0).alias(c) for c, v in lanes.items()))
    along = Window.partitionBy(*keys, "conv").orderBy("depth")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    path = path.select(*keys, "conv", "depth", "words", *_LANES, *(F.sum(c).over(upto).alias(f"s{c}") for c in _LANES), F.sum("words").over(upto).alias("w"), F.lead("depth").over(along).isNull().alias("end"))
    if sliced:
        totals = path.groupBy("conv", "slice").agg(*(F.sum(c).alias(c) for c in (*_LANES, "words")))
        totals = totals.select("conv", "slice", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"z{c}") for c in (*_LANES, "words")), F.lead("slice").over(Window.partitionBy("conv").orderBy("slice")).isNull().alias("last"))
        path = path.join(totals, ["conv", "slice"]).withColumns({f"s{c}": F.col(f"s{c}") + F.col(f"z{c}") for c in _LANES} | {"w": F.col("w") + F.col("zwords"), "end": F.col("end") & F.col("last")})
    k, p = _names([F.col(f"s{c}") for c in _LANES]), _names([F.col(f"s{c}") - F.col(c) for c in _LANES])
    path = path.select(*keys, "conv", "depth", "words", "w", "end", k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"))
    return path.groupBy(*keys, "k1", "k2", "depth").agg(
        *(F.min(c).alias(c) for c in ("p1", "p2", "words", "w")), F.count("*").alias("n"), F.min("conv").alias("m"), F.collect_list(F.when(F.col("end"), F.col("conv"))).alias("ends")
    ).drop(*keys)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order of (k1, k2, conv) as texts of up to IDS ids of a node."""
    for b in batches:
        cols = [b[c].to_numpy() for c in ("k1", "k2", "conv")]
        if not b.num_rows:
            continue
        new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        starts = np.flatnonzero(new)
        starts = np.unique(np.concatenate([np.arange(a, z, IDS) for a, z in zip(starts, np.append(starts[1:], b.num_rows), strict=True)]))
        stops = np.append(starts[1:], b.num_rows)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in cols), pa.array([",".join(map(str, cols[2][a:z].tolist())) for a, z in zip(starts, stops, strict=True)])], names=["k1", "k2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's texts, which come in order: a text at a time is fed to it, so a node with any number of ends is never held."""
    held, state = None, hashlib.sha256()
    names = ["k1", "k2", "ends_sha256"]
    for b in batches:
        out = []
        for k1, k2, ids in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if held == (k1, k2):
                state.update(b",")
            else:
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], names=names)


def _ends(families: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end. Ids are sorted by range, so the ends of one node may lie in any number of tasks until they are texts."""
    ids = families.select("k1", "k2", F.explode("ends").alias("conv"))
    texts = ids.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(_joined, "k1 bigint, k2 bigint, first bigint, ids string")
    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def _summed(tree: DataFrame, children: DataFrame) -> DataFrame:
    """(m, n, leaves, total): of each chain with several members the childless nodes in its subtree, and the saved tokens from its top on."""
    own = (F.col("n") - 1) * (F.col("w") - F.col("above"))
    start = tree.filter("n > 1").join(children, (F.col("m") == F.col("cm")) & (F.col("n") == F.col("cn")), "left")
    current = write_shared(start.select("m", "n", F.col("pm").alias("am"), F.col("pn").alias("an"), F.coalesce("single", F.lit(1)).alias("leaves"), own.alias("total")), "sums")
    while not current.filter("am is not null").isEmpty():
        below = current.filter("am is not null").groupBy("am", "an").agg(F.sum("leaves").alias("more"), F.sum("total").alias("added")).withColumnsRenamed({"am": "m", "an": "n"})
        up = current.select(F.col("m").alias("am"), F.col("n").alias("an"), F.col("am").alias("am2"), F.col("an").alias("an2"))
        current = write_shared(
            current.join(below, ["m", "n"], "left").join(up, ["am", "an"], "left").select(
                "m", "n", F.col("am2").alias("am"), F.col("an2").alias("an"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("total") + F.coalesce("added", F.lit(0))).alias("total")
            ),
            "sums",
        )
    return current.select("m", "n", "leaves", "total")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conversations has (conv_id, turn, role, text). Turns go by number, null first; rows of equal number by role, by the first 32 characters of their text and by its digest. Null roles and
    texts are empty. Rows without an id belong to no conversation and are left out; repeated rows are turns of their own. A conversation with no turn left after rebuilding is a
    member of the root only. An empty table gives no nodes. Texts of any length are read once, for digest and count. Other columns are ignored.
    """
    rows = turns(conversations)
    wide = rows.groupBy("base").agg(F.min("slice").alias("low"), F.max("slice").alias("high")).filter("low <> high").select("base")
    wide = write_shared(wide, "wide-families")
    if wide.isEmpty():
        parts = _family_nodes(rows, False)
    else:
        parts = _family_nodes(rows.join(wide, "base", "left_anti"), False).unionByName(_family_nodes(rows.join(wide, "base", "left_semi"), True))
    families = write_shared(parts, "family-nodes")
    nodes = families.groupBy("k1", "k2", "depth").agg(*(F.min(c).alias(c) for c in ("p1", "p2", "words", "w", "m")), F.sum("n").alias("n"), F.sum(F.size("ends")).alias("n_ends"))
    nodes = write_shared(nodes, "nodes")
    chains = nodes.groupBy("m", "n").agg(F.min(F.struct("depth", "p1", "p2", (F.col("w") - F.col("words")).alias("above"))).alias("top"), F.max(F.struct("depth", "k1", "k2", "w", "n_ends")).alias("bottom"))
    chains = chains.select("m", "n", F.col("top.depth").alias("top"), "top.p1", "top.p2", "top.above", F.col("bottom.depth").alias("bottom"), "bottom.k1", "bottom.k2", "bottom.w", "bottom.n_ends")
    over = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("top"), F.col("m").alias("pm"), F.col("n").alias("pn"))
    tree = write_shared(chains.join(over, ["p1", "p2", "top"], "left"), "chains")
    children = write_shared(
        tree.filter("pm is not null").groupBy(F.col("pm").alias("cm"), F.col("pn").alias("cn")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("single")), "children"
    )
    sums = _summed(tree, children)
    info = tree.join(sums, ["m", "n"], "left").join(children, (F.col("m") == F.col("cm")) & (F.col("n") == F.col("cn")), "left").join(_ends(families), ["k1", "k2"], "left")
    info = info.select("m", "n", "top", "bottom", "above", "pm", "leaves", "total", F.coalesce("n_children", F.lit(0)).alias("below"), F.when(F.col("n_ends") > 0, F.col("ends_sha256")).alias("ends"))
    at_top, at_bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    return nodes.select("m", "n", "depth", "words", "w").join(write_shared(info, "chain-values"), ["m", "n"]).select(
        F.col("m").alias("conv_id"), "depth", F.when(at_top, F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_bottom, F.col("below")).otherwise(1).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        F.coalesce(F.col("total") - (F.col("n") - 1) * (F.col("w") - F.col("words") - F.col("above")), F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce(F.when(at_bottom, F.col("ends")), F.lit(_EMPTY)).alias("ends_sha256"),
    )
