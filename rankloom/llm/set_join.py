"""Exact set-similarity join over word shingles with set-relation skipping.

Rows whose sets are equal form a class, which takes part once. Every class indexes its rarest shingles (as many as any partner
must share one of) in lists ordered by set size and position. Relations between sets are then used twice:

* index level: within a list, entries are grouped in blocks by position; a probe skips each block whose largest remaining
  length can't reach the overlap it needs;
* answer level: every list proposes its set with fewest shingles of its own as a representative, and every set is first compared
  only with the one that most of its lists propose. What links to the same representative is one component, so its members
  derive each other's answers from that and are never compared. In a second round one entry of each component meets the
  list's representative, and only entries of different components go on to be probed block by block. Each carries a sketch of
  its set there: one parity bit for each of SKETCH_BITS buckets of shingles. Two sets differ in at least as many shingles as their
  sketches in bits, so pairs that must differ in too many are dropped inside the list and never become rows.

No pair is lost: a pair that links shares an index shingle, and it is either inside one component or probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import hash_filter, in_bitmap, key_bitmap, write_shared
from .graph import connected_components
from .streams import sorted_runs

#: Shingles in at least this many sets are indexed last; at most HOT_MAX of them (1.6 MB) are told apart.
HOT_SETS = 32
HOT_MAX = 200_000
#: Share of the hash space whose shingles are counted; a prefix takes 15 % of a set, so it rarely leaves it.
COUNTED = 0.5
#: Entries of a list that one position block covers, and sets that meet their representative in one group.
BLOCK = 16
GROUP = 512
#: Entries of a list that each entry is compared with, by size and position, to see whether it may have a partner at all.
NEAR = 8
#: Bits of a place below the set's size: the position, above it how many shingles are the set's own (so many at most).
OWN_BITS, POS_BITS = 5, 28
#: Bits of a sketch. It tells most pairs of up to some 3,000 shingles apart; larger sets are compared as texts more often.
SKETCH_BITS = 2048


def _tid() -> Column:
    """A text's identity, by which one row of each class is found again."""
    return F.xxhash64(F.col("text"))


def _needed(size, t: int):
    """The overlap that a set of this size has with any partner, at least."""
    return (t * size + 99) // 100


def _pair_needed(a, b, t: int):
    return (t * (a + b) + 99 + t) // (100 + t)


def _may_link(size, pos, size2, pos2, t: int):
    """Whether two sets with their first common shingle at these positions can share as much as they need."""
    return np.minimum(size - pos, size2 - pos2) >= _pair_needed(size, size2, t)


def _partnered(run, size, pos, t: int, comp=None) -> np.ndarray:
    """Which entries of lists may link with another of their list (of another component).

    run: the list of each entry; entries are sorted by size within it. Each entry meets its next NEAR ones by size and position; in lists longer
    than that, the nearest sizes above and below decide for what is left. No pair that may link is lost.
    """
    n = len(run)
    keep = np.zeros(n, bool)
    for s in range(1, min(NEAR, n - 1) + 1 if n else 0):
        ok = (run[s:] == run[:-s]) & _may_link(size[s:], pos[s:], size[:-s], pos[:-s], t)
        if comp is not None:
            ok &= comp[s:] != comp[:-s]
        keep[s:] |= ok
        keep[:-s] |= ok
    if n > NEAR:
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        lengths = np.diff(np.append(starts, n))
        long = np.repeat(lengths > NEAR, lengths)
        for flip in (False, True):
            r, z = (x[::-1] if flip else x for x in (run, size))
            other = np.ones(n, bool) if comp is None else np.concatenate(([True], (comp[::-1] if flip else comp)[1:] != (comp[::-1] if flip else comp)[:-1]))
            other |= np.concatenate(([True], r[1:] != r[:-1]))
            near = np.maximum.accumulate(np.where(other, np.arange(n) - 1, -1))  # the nearest entry before that is another component's
            ok = (near >= 0) & (r[near] == r) & (np.minimum(z[near], z) >= _needed(np.maximum(z[near], z), t))
            keep |= (ok[::-1] if flip else ok) & long
    return keep


def _fields(place):
    """Size, own shingles and position of a place."""
    return place >> (OWN_BITS + POS_BITS), (place >> POS_BITS) & ((1 << OWN_BITS) - 1), place & ((1 << POS_BITS) - 1)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sid = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for row, s in H.shingle_sets(b["text"], k):
                n[row], sid[row] = len(s), H.set_id(s)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["tid"], pa.array(n), pa.array(sid)], names=["doc_id", "tid", "n_shingles", "sid"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _tid().alias("tid"), "text").mapInArrow(scan, "doc_id bigint, tid bigint, n_shingles bigint, sid bigint")


def _hot_shingles(docs: DataFrame, k: int, total: int) -> np.ndarray:
    """Frequent shingles' 40-bit keys, counted over all rows; counts travel as sorted, byte-transposed gaps."""
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) * COUNTED / 2e6)), 6, 24))
    limit = np.uint64(int(COUNTED * 2**40))

    def count(batches):
        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(keys >> np.uint64(40 - bits), np.arange(1, (1 << bits) + 1, dtype=np.uint64))
            start, out = 0, []
            for bucket, end in enumerate(ends):
                if end > start:
                    low = (keys[start:end] & np.uint64((1 << (40 - bits)) - 1)).astype(np.int64)
                    gaps = np.diff(low, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    out.append((bucket, end - start, np.ascontiguousarray(gaps.T).tobytes() + np.minimum(counts[start:end], 255).astype(np.uint8).tobytes()))
                    start = end
            bucket, size, block = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int64()), pa.array(block, pa.binary())], names=["bucket", "n", "block"])

        for b in batches:
            for _, s in H.shingle_sets(b["text"], k):
                key = s[: np.searchsorted(s, limit << np.uint64(24))] >> np.uint64(24)
                if len(key):
                    held.append(key)
                    n += len(key)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, bucket = [], [], 0
        for t in tables:
            for bucket_, n, block in zip(t["bucket"].to_pylist(), t["n"].to_pylist(), t["block"], strict=True):
                bucket = bucket_
                raw = np.frombuffer(block.as_buffer(), np.uint8)
                gaps = np.zeros((n, 8), np.uint8)
                gaps[:, :5] = raw[: 5 * n].reshape(5, n).T
                keys.append(np.cumsum(gaps.view("<u8").ravel().astype(np.int64)))
                counts.append(raw[5 * n :].astype(np.int64))
        keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        often = sums >= HOT_SETS
        yield pa.RecordBatch.from_arrays([pa.array(keys[often] + (bucket << (40 - bits))), pa.array(sums[often])], names=["key", "n"])

    blocks = docs.select("text").mapInArrow(count, "bucket int, n bigint, block binary")
    hot = blocks.groupBy("bucket").applyInArrow(merge, "key bigint, n bigint").orderBy(F.desc("n"), "key").limit(HOT_MAX)
    return np.sort(hot.select("key").toArrow()["key"].to_numpy().astype(np.uint64))


def _index(docs: DataFrame, k: int, t: int, hot: np.ndarray) -> DataFrame:
    """(token, place, sid): place holds the set's size, how many counted shingles aren't frequent, and the token's position."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def scan(batches):
        hot, seen = shared.value, set()
        limit = np.uint64(int(COUNTED * 2**40) << 24)
        for b in batches:
            tokens, places, sids = [], [], []
            for _, s in H.shingle_sets(b["text"], k):
                if not len(s) or (sid := H.set_id(s)) in seen:
                    continue
                seen.add(sid)
                take = len(s) - _needed(len(s), t) + 1
                low = s[: np.searchsorted(s, limit)]
                key = low >> np.uint64(24)
                at = np.searchsorted(hot, key)
                common = hot[np.minimum(at, len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
                own = min(int((~common).sum()), (1 << OWN_BITS) - 1)
                if common[:take].any():
                    # all that isn't frequent by hash, then the frequent ones by hash
                    s = np.concatenate([low[~common], s[len(low) :], low[common]])
                tokens.append(s[:take].view(np.int64))
                places.append((((len(s) << OWN_BITS) + own) << POS_BITS) + np.arange(take, dtype=np.int64))
                sids.append(np.full(take, sid, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, places, sids)], names=["token", "place", "sid"])

    return docs.select("text").mapInArrow(scan, "token bigint, place bigint, sid bigint")


def _lists(index: DataFrame, t: int) -> DataFrame:
    """Entries of lists that may link with another of their list, each with the representative that its list proposes (its own sid: none)."""

    def lead(batches):
        for starts, c in sorted_runs(batches, "token"):
            keep = np.ones(len(c["sid"]), bool)  # one entry a set: tasks may both have indexed it
            keep[1:] = (c["sid"][1:] != c["sid"][:-1]) | (c["token"][1:] != c["token"][:-1])
            lengths = np.add.reduceat(keep, starts[:-1])
            keep &= np.repeat(lengths > 1, np.diff(starts))
            token, place, sid = (c[x][keep] for x in ("token", "place", "sid"))
            keep = _partnered(token, *_fields(place)[::2], t)
            token, place, sid = token[keep], place[keep], sid[keep]
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size, own, pos = _fields(place)
            # the set that has fewest shingles of its own is the one that most others derive from, in all lists alike
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
            head = np.lexsort((sid, own, run))[first][run]
            rep = np.where(_may_link(size, pos, size[head], pos[head], t), sid[head], sid)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, place, sid, rep)], names=["token", "place", "sid", "rep"])

    spread = index.repartition("token").sortWithinPartitions("token", "place", "sid")
    # sorted by place, equal sets of a list stand together only with sid as the last key; equal sid has equal place
    return spread.mapInArrow(lead, "token bigint, place bigint, sid bigint, rep bigint")


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs (u > v) of a set and the representative that most of its lists propose: one pair a set at most."""
    votes = lists.filter("rep <> sid").groupBy("sid", "rep").count()
    chosen = votes.groupBy("sid").agg(F.max(F.struct("count", "rep"))["rep"].alias("rep"))
    return chosen.select(F.greatest("sid", "rep").alias("u"), F.least("sid", "rep").alias("v"), "sid", "rep")


def _stars_of_components(lists: DataFrame, t: int) -> DataFrame:
    """Pairs (u > v): in each list, one entry of every component against the list's representative."""

    def star(batches):
        for starts, c in sorted_runs(batches, "token"):
            size, own, pos = _fields(c["place"])
            run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            order = np.lexsort((c["sid"], own, c["comp"], run))
            r, k = run[order], c["comp"][order]
            entry = order[np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])))]  # the first of each component
            entry = entry[np.lexsort((c["sid"][entry], own[entry], run[entry]))]
            r = run[entry]
            lead = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            head = entry[np.repeat(lead, np.diff(np.append(lead, len(r))))]
            ok = (head != entry) & _may_link(size[entry], pos[entry], size[head], pos[head], t)
            u, v = c["sid"][entry][ok], c["sid"][head][ok]
            if len(u):
                pairs = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return lists.mapInArrow(star, "u bigint, v bigint").distinct()


def _apart(lists: DataFrame, t: int) -> DataFrame:
    """The entries of lists that may link with an entry of another component. lists: sorted by token and place within partitions."""

    def keep(batches):
        for _, c in sorted_runs(batches, "token"):
            size, _, pos = _fields(c["place"])
            rows = _partnered(c["token"], size, pos, t, c["comp"])
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[x][rows]) for x in ("token", "place", "sid", "comp")], names=["token", "place", "sid", "comp"])

    return lists.mapInArrow(keep, "token bigint, place bigint, sid bigint, comp bigint")


def _sketches(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(sid, sketch) of the sets of chosen (sid, tid), and maybe of others.

    The texts are tested where they are cut: a Python test in the plan would cost each task a second Python process.
    """
    shared, mask = key_bitmap(chosen, "tid")

    def scan(batches):
        for b in batches:
            sids, sketches = [], []
            met = b["text"].filter(pa.array(in_bitmap(shared.value, b["tid"].to_numpy() & mask)))
            for _, s in H.shingle_sets(met, k):
                bucket = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(np.log2(SKETCH_BITS)))
                sids.append(H.set_id(s))
                sketches.append(np.packbits(np.bincount(bucket.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sketches, pa.binary())], names=["sid", "sketch"])

    texts = docs.filter(F.col("text").isNotNull()).select(_tid().alias("tid"), "text")
    return texts.mapInArrow(scan, "sid bigint, sketch binary").dropDuplicates(["sid"])


def _probe(lists: DataFrame, t: int) -> DataFrame:
    """Pairs of different components (u > v) within each list that size, position and sketch leave possible.

    lists: sorted by token within partitions.
    """

    def probe(batches):
        for starts, c in sorted_runs(batches, "token"):
            size, _, pos = _fields(c["place"])
            us, vs = [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                comp = c["comp"][a:b]
                if (comp == comp[0]).all():
                    continue  # one component: every answer follows from the representative's
                z, left, sid = size[a:b], size[a:b] - pos[a:b], c["sid"][a:b]
                bits = np.frombuffer(b"".join(c["sketch"][a:b]), np.uint64).reshape(b - a, -1)
                order = np.lexsort((z, pos[a:b] // BLOCK))
                z, left, sid, comp, bits = z[order], left[order], sid[order], comp[order], bits[order]
                block = np.flatnonzero(np.concatenate(([True], np.diff(pos[a:b][order] // BLOCK) > 0)))
                most, least = np.maximum.reduceat(left, block), np.minimum.reduceat(z, block)
                ends = np.append(block[1:], len(z))
                for i in range(len(z)):
                    for j in np.flatnonzero(np.minimum(most, left[i]) >= _pair_needed(z[i], np.maximum(least, _needed(z[i], t)), t)):
                        s = slice(max(block[j], i + 1), ends[j])
                        if s.start >= s.stop:
                            continue
                        needed = _pair_needed(z[i], z[s], t)
                        ok = np.flatnonzero((np.minimum(left[i], left[s]) >= needed) & (comp[s] != comp[i]))
                        ok = ok[np.bitwise_count(bits[s][ok] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (z[i] + z[s] - 2 * needed)[ok]]
                        if len(ok):
                            vs.append(sid[s][ok])
                            us.append(np.full(len(ok), sid[i]))
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                pairs = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return lists.mapInArrow(probe, "u bigint, v bigint").distinct()


def _verified(docs: DataFrame, chosen: DataFrame, edges: DataFrame, k: int, t: int) -> DataFrame:
    """Those of edges (u, v) that link. Each v's set meets its u's in groups of about GROUP, side by side and streamed."""
    spread = edges.groupBy("v").count().select("v", F.ceil(F.col("count") / GROUP).cast("int").alias("groups"))
    followers = edges.join(spread, "v").select(F.col("u").alias("sid"), F.col("v").alias("key"), F.pmod(F.xxhash64("u"), F.col("groups")).cast("int").alias("salt"), F.lit(1).alias("role"))
    leaders = spread.select(F.col("v").alias("sid"), F.col("v").alias("key"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = write_shared(followers.union(leaders).join(chosen, "sid"), "wanted")
    present = hash_filter(wanted, "tid")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _tid().alias("tid")).filter(F.col("text").isNotNull())
    # by text and id: rows that share an id, or have none, meet only their own text's wanted sets
    chosen_row = (F.col("tid") == F.col("chosen_tid")) & F.col("doc_id").eqNullSafe(F.col("chosen_id"))
    rows = texts.filter(present(F.col("tid"))).join(wanted.withColumnsRenamed({"doc_id": "chosen_id", "tid": "chosen_tid"}), chosen_row)

    def verify(batches):
        key = leader = None
        for b in batches:
            us, vs = [], []
            keys, roles, sids = b["key"].to_numpy(), b["role"].to_numpy(), b["sid"].to_numpy()
            for i, s in H.shingle_sets(b["text"], k):
                if H.set_id(s) != sids[i]:
                    continue  # another text under the same id
                if roles[i] == 0:
                    key, leader = keys[i], s
                elif key == keys[i]:
                    shared = len(np.intersect1d(s, leader, assume_unique=True))
                    if 100 * shared >= t * (len(s) + len(leader) - shared):
                        us.append(sids[i])
                        vs.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = rows.select("key", "salt", "role", "sid", "text").repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    return rows.mapInArrow(verify, "u bigint, v bigint").distinct()


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Links rows whose sets of k-word shingles have 100 * intersection >= percent * union, and returns
    (doc_id, n_shingles, component_id, class_rows) for every row: component_id is the smallest doc_id reachable by links, class_rows
    the number of rows with an equal set.

    A row with fewer than k words has its whole sequence as its one shingle. Null, empty or blank texts have no shingle, link with
    nothing and keep their own doc_id as component_id. Repeated rows, and rows that share a doc_id, are rows of their own; a null
    doc_id is never anyone's component_id unless all members have it. Other columns are ignored. Shingles and sets are compared by
    64-bit hashes.
    """
    signatures = write_shared(_signatures(docs, k), "signatures")
    classes = signatures.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("low_id"), F.min("tid").alias("tid"), F.min_by("doc_id", "tid").alias("doc_id"), F.count("*").alias("class_rows"))
    total = signatures.agg(F.sum("n_shingles")).first()[0] or 0
    if total:
        representatives = classes.select("sid", "doc_id", "tid")
        lists = write_shared(_lists(_index(docs, k, percent, _hot_shingles(docs, k, total)), percent), "lists")
        stars = write_shared(_stars(lists), "stars")
        spokes = stars.select(F.col("sid").alias("u"), F.col("rep").alias("v"))
        links = write_shared(_verified(docs, representatives, spokes, k, percent), "links")
        comps = write_shared(connected_components(links), "comps")

        def tagged(comps: DataFrame) -> DataFrame:
            return lists.join(comps, lists.sid == comps.node, "left").select("token", "place", "sid", F.coalesce("comp", "sid").alias("comp"))

        def by_token(rows: DataFrame) -> DataFrame:
            return rows.repartition("token").sortWithinPartitions("token", "place", "sid")

        tried = stars.select("u", "v")
        for round_ in (1, 2):
            # one entry for each component first: what links merges, and is not probed pair by pair
            if round_ == 1:
                pairs = _stars_of_components(by_token(tagged(comps)), percent)
            else:
                mixed = write_shared(_apart(by_token(tagged(comps)), percent), "mixed")
                met = mixed.select("sid").distinct().join(representatives, "sid")
                pairs = _probe(by_token(mixed.join(_sketches(docs, met, k), "sid")), percent)
            pairs = write_shared(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                bridges = comps.filter("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v"))
                comps = write_shared(connected_components(_verified(docs, representatives, pairs, k, percent).union(bridges)), "comps")
            tried = tried.union(pairs)
        members = classes.join(comps, classes.sid == comps.node, "left").withColumn("comp", F.coalesce("comp", "sid"))
        heads = members.groupBy("comp").agg(F.min("low_id").alias("component_id"))
        answers = members.join(heads, "comp").select("sid", "component_id", "class_rows")
    else:
        answers = classes.select("sid", F.col("low_id").alias("component_id"), "class_rows")
    return (
        signatures.join(answers, "sid", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"))
    )


def one_per_component(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The row of docs with the smallest doc_id (nulls last) of each component, with all columns of docs, whatever their names.

    Rows are told apart by doc_id and text; rows that repeat both are kept once. Rows without any shingle are kept. An empty table stays empty. Texts are
    shuffled only if they may have to go.
    """
    doc_id = F.col("doc_id").cast("bigint")
    key = F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.col("text").isNull(), F.coalesce(F.col("text"), F.lit("")))
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    rows = docs.select(key.alias("row_key"), doc_id.alias("doc_id")).groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    members = write_shared(found.join(rows, "row_key"), "members")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row_key")).alias("low")
    kept = members.groupBy("component_id").agg(low).select("component_id", F.col("low.row_key").alias("kept_key"))
    odd = members.join(kept, "component_id").select(F.col("row_key").alias("odd_key"), (F.col("row_key") == F.col("kept_key")).alias("kept"), "n")
    odd = write_shared(odd.filter("not kept or n > 1"), "odd")
    present = hash_filter(odd, "odd_key")
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("row_key"))
    maybe = source.filter(present(F.col("row_key"))).join(odd.select("odd_key", "kept"), F.col("row_key") == F.col("odd_key"), "left").filter("coalesce(kept, true)")
    if not odd.filter("kept").isEmpty():
        maybe = maybe.dropDuplicates(["row_key"])
    return source.filter(~present(F.col("row_key"))).select("row").union(maybe.select("row")).select("row.*")
