"""The prefix trie, the Merkle manifest and the URL filters against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from rankloom.llm import merkle, prefix_trie, url_templates

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    """df with columns whose names the operators use inside."""
    return df.selectExpr("*", "1 as base", "2 as key", "'x' as conv", "3 as n", "4 as depth", "'k' as digest", "5 as block", "6 as host", "7 as node", "8 as share", "9 as bad", "10 as idx")


# --- trie ------------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    by = {c: [v[2:] for v in sorted(turns)] for c, turns in by.items()}
    node, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(by.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            node[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = (collections.defaultdict(int) for _ in range(3))
    for p in node:
        if p:
            kids[p[:-1]] += 1
    for p, members in node.items():
        own = (len(members) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += kids[p] == 0
    return sorted([(min(m), len(p), min(node[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in node.items()], key=str)


def trie(df):
    return sorted(map(tuple, prefix_trie.trie(df).collect()), key=str)


def test_trie_on_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert trie(clashing(df)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def odd_turns():
    """Families without a base, negative ids, null and repeated turns, turns in several slices, copies, one id that is null, shared long paths."""
    rnd, rows = random.Random(3), []
    for c in [*range(-25, 20), *range(21, 45), 1000, 1001, 1020]:
        for t in range(rnd.randint(0, 6)):
            rows.append((c, rnd.choice([None, t, t, -t * 70_000, t * 70_000]) if c % 3 else t, rnd.choice(["u", "a", None]), rnd.choice(["x", "y y", "", None])))
    rows += [(c, t, "u", "same") for c in range(100, 150) for t in range(5)]
    rows += [(None, 1, "u", "lost"), (201, 0, "u", "a b c")] + [(141, 1, "u", "dup")] * 3
    return rows + [(c, t, "u", f"w {t % 7}") for c, n in ((301, 400), (302, 300), (300, 9)) for t in range(n)]


def test_trie_of_odd_conversations(spark):
    rows = odd_turns()
    assert trie(spark.createDataFrame(rows, TURNS).repartition(5)) == brute_trie(rows)


def test_ends_of_one_node_over_many_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, 0, "u", "x") for c in range(5000, 5100)]
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    assert trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)) == []


# --- manifest --------------------------------------------------------------------------------------------------------------


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            a = i - i % 3
            out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
            i //= 3
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"], leaf(r, r["text"]), r))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        by[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[k] = tree([x[1] for x in by[k]])
    over, out = tree([trees[k][-1][0] for k in keys]), []
    for j, k in enumerate(keys):
        for i, (d, own, r) in enumerate(by[k]):
            proof = path(trees[k], i) + path(over, j)
            x = leaf(r, r["text"] and r["text"].replace("\n", "")) if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else own
            for a, b in proof:
                x = sha(a + x + b)
            out.append((d, own, trees[k][-1][0], over[-1][0], sha("".join(a + b for a, b in proof)), x, x == over[-1][0]))
    return sorted(out, key=str)


def manifest(df):
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


def test_manifest_on_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert manifest(clashing(df)) == brute_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_odd_rows(spark):
    """Null columns, ids and sources that repeat, an empty source besides the null one, and sources of all sizes around whole blocks of the store."""
    rows = [(i, f"t\n{i}" if i % 3 else None, "en" if i % 5 else None, "hot", i) for i in range(1500)]
    rows += [(None, "no id\n", "en", "", 1), (None, "no id\n", "en", "", 1), (7, "a\n", None, None, None), (7, "a\n", None, None, None), (7, "", "fr", None, 0), (8, "w " * 100_000, "en", "é", 5)]
    for source, n in (("one", 1), ("three", 3), ("four", 4), ("s243", 243), ("s244", 244), ("s728", 728), ("s729", 729), ("s730", 730)):
        rows += [(i, f"{source} {i}\n", "en", source, i) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert manifest(df) == brute_manifest([r.asDict() for r in df.collect()])


def test_numbers_run_on_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORTED_ROWS", 50)
    rows = [("a" if i < 700 else f"k{i % 9}", i) for i in range(1000)]
    got = merkle.numbered(spark.createDataFrame(rows, "key string, v int").repartition(3), "v").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.key].append((r.v, r.idx))
    assert all([i for _, i in sorted(x)] == list(range(len(x))) for x in by.values())


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], DOCS)) == []


# --- url filters -----------------------------------------------------------------------------------------------------------

LABELS = "doc_id bigint, quality int, toxic int"


def test_parts_and_rules(spark):
    long = "http://a.org/fr/" + "x/" * 5000
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/net/": ("", "", None), "HTTP://WWW.Example.NET/en/1?x#y": ("www.example.net", "/en/1", "example.net/en/"),
        "http://example.net/EN/1": ("example.net", "/EN/1", "net/"), "http://example.net": ("example.net", "", None), "x://notexample.net/en/": ("notexample.net", "/en/", "net/"),
        "http://É.com/de/": ("É.com", "/de/", None), "http://b.example.com/de/#f": ("b.example.com", "/de/", "example.com/de/"), "http://badexample.com/de/": ("badexample.com", "/de/", None),
        "http://h?u=http://net/": ("h", "", None), "a://b://c/net/": ("b:", "//c/net/", None), "http://org/fr/": ("org", "/fr/", "org/fr/"), long: ("a.org", long[12:], "org/fr/"), "http://h.net/a\nb": ("h.net", "/a\nb", "net/"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, "http://x.net/1"), (3, "http://x.net/1"), (3, "http://x.net/1")]
    got = url_templates.judge(clashing(spark.createDataFrame(rows, "page_id bigint, url string")), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id != 3}
    for i, (u, want) in enumerate(cases.items()):
        if i != 3:
            assert (by[i].host, by[i].path, by[i].rule) == want, u
            assert by[i].verdict == (url_templates.RULES[want[2]] if want[2] else "allow")


def test_templates_reject_what_is_labelled_bad(spark):
    """A bad branch stays by itself and is rejected; good branches are one wildcard, rare ones another; a new host has the share of all pages."""
    rows, labels = [], []
    for i in range(400):
        section = ("shop", "news", "blog", "list")[i % 4]
        rows.append((i, f"http://h.com/{section}/{i}.html"))
        labels.append((i, 0 if section == "shop" or i % 100 == 1 else 1, 0))
    rows += [(1000, "http://h.com/shop/9"), (1001, "http://h.com/rare/9.html"), (1002, "http://new.com/shop/1"), (1003, "http://h.com/" + "/".join("abcdefghij"))]
    labels += [(0, 0, 1), (None, 0, 0), (5000, None, None)]
    got = {r.page_id: (r.template, r.verdict) for r in url_templates.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[0][0].startswith("/shop/") and got[0][1] == "block"
    assert got[1][0] == got[2][0] == got[3][0] and got[1][0].startswith("/*-/") and got[1][1] == "allow"
    assert got[1001][0].startswith("/*/")
    assert got[1000][1] == "block" and got[1002][1] == "allow" and got[1003][0].endswith("//**")


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_templates.judge(empty, spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_do_not_depend_on_order(spark, seed):
    pages, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("pages", "labels"))
    a = url_templates.judge(pages, labels).collect()
    b = url_templates.judge(pages.repartition(3 + seed, "url"), labels.repartition(2)).collect()
    assert sorted(a, key=str) == sorted(b, key=str)


# --- decontamination by classes of length, packing by hashed shards --------------------------------------------------------


def test_leaks_do_not_depend_on_other_items_or_shards(spark, monkeypatch):
    """A short item's windows are its own: neither a long item in its shard nor the size of shards changes what is found of it."""
    from rankloom.llm import decontamination

    def unrelated(n, tag):
        return " ".join(f"{tag}{i}" for i in range(n))

    question, answer = "which of the seven rivers of Old Marrow runs past the mill of the glass makers", "Zanvoria"
    item = (1, f"{question}? {answer}")
    docs = [
        (1, f"{unrelated(200, 'a')} {question} {unrelated(1200, 'b')} {answer} {unrelated(50, 'c')}"),
        (2, f"{unrelated(200, 'a')} {question}? {answer} {unrelated(50, 'c')}"),
        (3, unrelated(300, "d")),
        (4, None),
    ]
    texts = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    long = [(2, f"{unrelated(1500, 'e')}. the end"), (3, f"{unrelated(700, 'f')}. so it ends")]
    found = []
    for items, size in (([item], 32 << 20), ([item, *long], 32 << 20), ([item, *long], 20_000)):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        got = decontamination.contaminated(texts, spark.createDataFrame(items, "item_id bigint, text string")).collect()
        found.append(sorted((r.doc_id, r.item_id) for r in got))
    assert found == [[(2, 1)]] * 3


def test_shards_are_even_whatever_the_ids(spark, monkeypatch):
    from rankloom.llm import packing

    monkeypatch.setattr(packing, "SHARD", 100)
    rows = [(i * 40 if i % 3 else None, f"w{i} x y", "en", "s", 1) for i in range(4000)]
    sizes = [r[0] for r in packing.pack(spark.createDataFrame(rows, DOCS)).groupBy("shard").count().select("count").collect()]
    assert len(sizes) == 40 and sum(sizes) == 4000 and max(sizes) < 200
