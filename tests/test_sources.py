import gzip

import pytest

from rankloom.plans import settings
from rankloom.sources import run_files, warc


def test_run_and_qrels(spark, tmp_path):
    (tmp_path / "run").write_text("1 Q0 a 9 2.5 x junk more\n\n1 Q0 b 3 3.5 last\n")
    rows = run_files.read_run(spark, str(tmp_path / "run")).collect()
    assert {(r.docno, r.sim, r.run_id) for r in rows} == {("a", 2.5, "last"), ("b", 3.5, "last")}
    (tmp_path / "qrels").write_text("1 0 a 1\n1\t0  b 0\n")
    assert run_files.read_qrels(spark, str(tmp_path / "qrels")).count() == 2
    (tmp_path / "bad").write_text("1 0 a\n")
    with pytest.raises(Exception, match="malformed"):
        run_files.read_qrels(spark, str(tmp_path / "bad")).collect()


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1", "a", 1.5), ("1", "b", 2.5)], "qid string, docno string, sim double")
    run_files.write_run(run, str(tmp_path / "out"), "me")
    assert {(r.docno, r["rank"]) for r in run_files.read_run(spark, str(tmp_path / "out")).collect()} == {("b", 1), ("a", 2)}


def test_topics(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<webtrack><topic number="3" type="x"><query>obama family tree</query><description>Find it.</description></topic></webtrack>')
    assert tuple(run_files.read_topics(spark, str(tmp_path / "t.xml")).first()) == (3, "obama family tree", "Find it.")


def test_warc(spark, tmp_path):
    def record(i, body):
        return f"WARC/1.0\nWARC-TREC-ID: d{i}\nWARC-Target-URI: http://x/{i}\nContent-Length: {len(body)}\n\n".encode() + body + b"\n\n"

    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1, b"<p>one</p>") + b"WARC/1.0\nContent-Length: 2\n\nzz\n\n" + record(2, b"WARC/9")))
    rows = warc.read_warc(spark, str(tmp_path))
    assert {(r.docid, bytes(r.content)) for r in rows.collect()} == {("d1", b"<p>one</p>"), ("d2", b"WARC/9")}
    assert warc.target_urls(rows).count() == 2


def test_settings():
    assert settings.topics_of("wt09_10")[::99] == [1, 100] and len(settings.topics_of("wttest")) == 15
    assert settings.cutoffs("10,5,10") == [5, 10] and settings.gain_pairs("1=3.5,2=9") == {1: 3.5, 2: 9.0}
    assert len(settings.grid({"a": "1|2", "b": "x|y|z"})) == 6 and len(settings.splits()) == 15
    assert settings.parse_experiment_id(settings.experiment_id("m", {"k": 1, "ut": True})) == ("m", {"k": "1"})
