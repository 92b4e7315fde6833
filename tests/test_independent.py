"""Operators against plain Python that shares nothing with their expressions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import arrays, stem
from rankloom.operators import analytics, extraction, measures, preferences, report, representatives
from rankloom.sources import matrices, run_files, warc


def topic(seed):
    r = random.Random(seed)
    docs = [f"d{i:02}" for i in range(40)]
    judged = {d: r.choice([-1, 0, 0, 1, 2, 4]) for d in docs if r.random() < 0.7}
    return {d: r.choice([0.1, 0.2, 0.3, 0.4, 0.5]) + r.random() * (seed % 2) for d in docs if r.random() < 0.8}, judged


def frames(spark, seeds):
    run = [(str(s), d, x) for s in seeds for d, x in topic(s)[0].items()]
    qrels = [(str(s), d, x) for s in seeds for d, x in topic(s)[1].items()]
    return spark.createDataFrame(run, "qid string, docno string, sim double"), spark.createDataFrame(qrels, "qid string, docno string, rel int")


def by_hand(scores, judged, gains=None):
    order = sorted(sorted(scores, reverse=True), key=lambda d: -np.float32(scores[d]))
    rel, hits = [judged.get(d) for d in order], 0
    r, nr = sum(x >= 1 for x in judged.values()), sum(x == 0 for x in judged.values())
    ap = bp = bad = 0.0
    for i, x in enumerate(rel, 1):
        if x is not None and x >= 1:
            hits += 1
            ap += hits / i
            bp += 1 if bad == 0 else 1 - min(bad, r) / min(nr, r)
        bad += x == 0
    gain = lambda x: 0 if x is None or x < 0 else (gains or {}).get(x, x)
    dcg = lambda xs: sum(g / math.log2(i + 1) for i, g in enumerate(xs, 1))
    ideal = dcg(sorted((gain(x) for x in judged.values()), reverse=True))
    first = next((i for i, x in enumerate(rel, 1) if x is not None and x >= 1), None)
    return {
        "map": ap / r, "bpref": bp / r, "P_5": sum(x is not None and x >= 1 for x in rel[:5]) / 5, "recip_rank": 1 / first if first else 0, "ndcg": dcg(map(gain, rel)) / ideal,
        "Rprec": sum(x is not None and x >= 1 for x in rel[:r]) / r, "success_2": float(any(x is not None and x >= 1 for x in rel[:2])), "set_F": (2 * hits / len(rel) * hits / r) / (hits / len(rel) + hits / r) if hits else 0.0,
    }


def test_measures_by_name(spark):
    run, qrels = frames(spark, range(6))
    for name, gains in (("ndcg", None), ("ndcg.1=3,2=9,4=4.5", {1: 3, 2: 9, 4: 4.5})):
        out = report.evaluation(run, qrels, ["map", "bpref", "P.5,5", "recip_rank", name, "Rprec", "success.2", "set_F", "num_q", "runid", "relstring.3"], "me", per_topic=True).collect()
        got = {(r.measure, r.qid): r.value for r in out}
        for s in range(6):
            for m, v in by_hand(*topic(s), gains).items():
                assert got[m, str(s)] == pytest.approx(v, abs=1e-9), (m, s)
        assert got["num_q", "all"] == 6 and got["map", "all"] == pytest.approx(np.mean([by_hand(*topic(s))["map"] for s in range(6)]))
        text = {(r.measure, r.qid): r.text for r in out}
        assert text["runid", "all"] == "me" and len(text["relstring", "0"]) == 5
    lines = [r.value for r in report.lines(report.evaluation(run, qrels, ["official"], per_topic=True)).collect()]
    assert lines[0].split()[0] == "num_ret" and lines[-1].startswith("P_1000") and [x.split()[0] for x in lines if "\tall\t" in x][:3] == ["runid", "num_q", "num_ret"]
    assert any(x.startswith("iprec_at_recall_0.10  \t0\t") for x in lines)
    only = report.evaluation(run, qrels, ["map"], per_topic=True, only="3").collect()
    assert {r.qid for r in only} == {"3", "all"}
    for wrong in ("nosuch", "P.0", "P_5"):
        with pytest.raises(ValueError):
            report.parse([wrong])


def balanced_by_hand(scores, rows, retrieved):
    """rows: (jg, jsg, docno, level) of one topic."""
    judged = sorted({d for _, _, d, _ in rows})
    rank = {d: i for i, d in enumerate(sorted(scores, key=lambda d: (-np.float32(scores[d]), d)))}
    order = sorted(judged, key=lambda d: (d not in rank, rank.get(d, 0), d))
    place, k = {d: i for i, d in enumerate(order)}, sum(d in rank for d in judged)
    shares = []
    for jg in sorted({x[0] for x in rows}):
        level = {d: v for g, _, d, v in rows if g == jg}
        rel, non = [d for d in level if level[d] > 0], sorted((d for d in level if level[d] <= 0), key=place.get)
        seen = lambda ds: [d for d in ds if place[d] < k]
        side = seen if retrieved else list
        r, n = len(side(rel)), len(side(non))
        if r >= n:
            pairs = [(a, b) for a in side(level) for b in side(level) if level[a] > level[b]]
            ful = sum(place[a] < place[b] and place[a] < k for a, b in pairs) + len(seen(rel)) * (r - n)
            poss = len(pairs) + len(rel) * (r - n)
        else:
            pairs = [(a, b) for a in side(rel) for b in side(rel) if level[a] > level[b]] + [(a, b) for a in side(level) for b in side(non)[:r]]
            ful, poss = sum(place[a] < place[b] and place[a] < k for a, b in pairs), len(pairs)
        shares.append(ful / poss if poss else None)
    return 0.0 if None in shares else sum(shares) / len(shares)


def test_balanced_preferences(spark):
    prefs, scores = [], {}
    for q in range(12):
        r = random.Random(q)
        docs = [f"d{i}" for i in range(14)]
        scores[q] = {d: r.choice([1.0, 2.0, 3.0, 4.0]) for d in docs if r.random() < 0.7}
        prefs += [(str(q), jg, "0", d, float(r.choice([0, 0, 1, 2] if q % 2 else [0, 1, 2, 3]))) for jg in ("a", "b") for d in docs if r.random() < 0.8]
    run = spark.createDataFrame([(str(q), d, x) for q, s in scores.items() for d, x in s.items()], "qid string, docno string, sim double")
    table = spark.createDataFrame(prefs, "qid string, jg string, jsg string, docno string, level double")
    for retrieved, name in ((False, "prefs_avgjg_Rnonrel"), (True, "prefs_avgjg_Rnonrel_ret")):
        got = {r.qid: r[name] for r in preferences.balanced(run, table, retrieved).collect()}
        assert got == {str(q): pytest.approx(balanced_by_hand(scores[q], [x[1:] for x in prefs if x[0] == str(q)], retrieved)) for q in scores}


def test_document_pairs_against_all_pairs(spark):
    run, qrels = frames(spark, range(4))
    got = {(r.qid, r.low, r.high): (r.n, r.hits) for r in analytics.document_pairs(qrels, run).collect()}
    expected = {}
    for s in range(4):
        scores, judged = topic(s)
        for a in judged:
            for b in judged:
                if a in scores and b in scores and 0 <= judged[a] < judged[b]:
                    n, h = expected.get((str(s), judged[a], judged[b]), (0, 0))
                    expected[str(s), judged[a], judged[b]] = (n + 1, h + (scores[a] < scores[b]))
    assert got == expected


def test_stems_of_the_published_examples():
    for word, expected in {
        "caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "troubled": "troubl", "hopping": "hop", "falling": "fall", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "vietnamization": "vietnam", "operator": "oper", "sensibiliti": "sensibl", "triplicate": "triplic",
        "electrical": "electr", "goodness": "good", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is",
    }.items():
        assert stem.stem(word) == expected
    assert stem.stem(None) is None


def test_matrices(spark, tmp_path):
    for name, x in {"m/1/a.npy": [[0.1, 0.9], [0.4, 0.2]], "d/1/a.npy": [[0.5, 0.6], [0.7, 0.8], [0.3, 0.2]], "i/1.npy": [2.0, 1.0], "j/1.npy": [0.5, 3.0, 1.5]}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        np.save(tmp_path / name, np.array(x, np.float32))
    t, d = matrices.read_matrices(spark, str(tmp_path / "m")), matrices.read_matrices(spark, str(tmp_path / "d"))
    i, j = matrices.read_idf(spark, str(tmp_path / "i")), matrices.read_idf(spark, str(tmp_path / "j"))
    row = matrices.assemble(t, d, i, j, rows=4, columns=3).first()
    assert np.allclose(row.matrix, [[0.1, 0.9, 0], [0.4, 0.2, 0], [0.7, 0.8, 0], [0.3, 0.2, 0]]) and np.allclose(row.idf, [2, 1, 3, 1.5])
    picked = matrices.assemble(t, d, i, j, 4, 1, lambda v: arrays.absolute_max(v, 1)).first()
    assert np.allclose(picked.matrix, [[0.9], [0.2], [0.8], [0.2]])
    (tmp_path / "v").write_text("2 3\nking 1 2 3\nqueen 4 5 6\n")
    assert {r.word: list(r.vector) for r in matrices.read_word_vectors(spark, str(tmp_path / "v")).collect()} == {"king": [1, 2, 3], "queen": [4, 5, 6]}
    docmap = spark.createDataFrame([('{"a": 3}', "a"), ('{"a": 3}', "b")], "m string, d string")
    assert [r.x for r in docmap.select(matrices.doc_rows(F.col("m"), F.col("d")).alias("x")).collect()] == [3, None]


def test_permutation_and_old_slides(spark):
    df = spark.range(3).select("id", F.array(*(F.lit(float(i)) for i in (5, 1, 4, 2, 3))).alias("v"))
    rows = df.select(arrays.permuted(F.col("v"), F.col("id")).alias("p"), arrays.max_slide_old(F.col("v"), 4, 2).alias("s")).collect()
    assert all(sorted(r.p) == [1, 2, 3, 4, 5] for r in rows) and len({tuple(r.p) for r in rows}) > 1
    assert all(list(r.s) == [0, 1, 2, 3] for r in rows)


def test_training_pairs_are_drawn_with_replacement(spark):
    labels = spark.createDataFrame([("1", f"p{i}", 2) for i in range(3)] + [("1", "n", 0), ("1", "m", 1), ("2", "x", 1), ("2", "y", 0), ("3", "alone", 2)], "qid string, docno string, label int")
    rows = representatives.training_pairs(labels, 4000).collect()
    assert rows == representatives.training_pairs(labels, 4000).collect()  # the seed decides
    count = {}
    for r in rows:
        count[r.positive] = count.get(r.positive, 0) + 1
        assert r.negative == {"m": "n", "x": "y"}.get(r.positive, "m")
    assert set(count) == {"p0", "p1", "p2", "m", "x"} and all(abs(c - 4000 / 6) < 150 for c in count.values()) and len(set(count.values())) > 1


def test_extraction(spark):
    rows = spark.createDataFrame([("u", "b", 1), (None, "b", 1), ("u", None, None), ("u", "x" * 99, 1), ("u", "b", None)], "url string, body string, qid int")
    assert {r.counter: r.value for r in extraction.counters(rows, 50).collect()} == {"pages": 5, "errors": 3, "qid_pages": 1}
    assert extraction.small_bodies(extraction.with_content(rows), 50).count() == 2


def test_graded_run_and_report(spark, tmp_path):
    (tmp_path / "good").write_text("wt-1 Q0 a 0 2.5 x\n1 Q0 b 1 1.5 x\n")
    assert run_files.read_graded_run(spark, str(tmp_path / "good")).count() == 2
    for i, bad in enumerate(("1 0 a 0 2.5 x", "1 Q0 a -1 2.5 x", "1 Q0 a 0 much x", "1 Q0 a 0 2.5", "1 Q0 a 0 2.5 x\n1 Q0 a 1 2.5 x")):
        (tmp_path / f"bad{i}").write_text(bad + "\n")
        with pytest.raises(Exception):
            run_files.read_graded_run(spark, str(tmp_path / f"bad{i}")).collect()
    run_files.write_report(spark.createDataFrame([("a", 1.23456, 2), ("b", None, 3)], "name string, x double, n int").coalesce(1), str(tmp_path / "csv"))
    assert "".join(f.read_text() for f in (tmp_path / "csv").glob("part-*")) == "name,x,n\na,1.235,2\nb,,3\n"
    assert run_files.reranked_name("x/run.gz") == "rr_run.gz"


@pytest.mark.parametrize("packed", [True, False])
def test_warc_in_ranges(spark, tmp_path, packed):
    import gzip

    def record(i):
        body = bytes([65 + i % 26]) * (i * 37 % 500) + (b"\nWARC/1.0 is no record" if i % 5 == 0 else b"")
        return f"WARC/1.0\r\nWARC-TREC-ID: d{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    made = [record(i) for i in range(80)]
    (tmp_path / f"a.warc{'.gz' if packed else ''}").write_bytes(b"".join(gzip.compress(x) if packed else x for x in made))
    for step in (333, 4096, 1 << 20):
        rows = warc.read_warc(spark, f"file://{tmp_path}", split_bytes=step).select("docid").collect()
        assert sorted(r.docid for r in rows) == sorted(f"d{i}" for i in range(80)), step
    warc.register(spark)
    assert spark.read.format("warc").option("splitBytes", 1000).load(str(tmp_path)).count() == 80
