"""SequenceFiles that Hadoop writes, read in ranges of any size and held against Hadoop's own reader."""

import pytest

from rankloom.sources import sequence, warc

CODEC = "org.apache.hadoop.io.compress."
ROWS = [(f"k{i}", bytes([i % 256]) * (i * 37 % 900) + f"é{i}".encode()) for i in range(3000)] + [("", b""), ("dup", b"x"), ("dup", b"x"), ("long", b"\xff" * 300_000)]


def hadoop_write(df, path, codec=None, blocks=False):
    prefix, hadoop = "mapreduce.output.fileoutputformat.compress", "org.apache.hadoop."
    conf = {prefix: str(codec is not None).lower(), f"{prefix}.type": "BLOCK" if blocks else "RECORD"} | ({f"{prefix}.codec": codec} if codec else {})
    df.rdd.map(lambda r: (r[0], bytearray(r[1]))).saveAsNewAPIHadoopFile(path, f"{hadoop}mapreduce.lib.output.SequenceFileOutputFormat", f"{hadoop}io.Text", f"{hadoop}io.BytesWritable", conf=conf)


@pytest.mark.parametrize("codec, blocks", [(None, False), (CODEC + "DefaultCodec", False), (CODEC + "DefaultCodec", True), (CODEC + "GzipCodec", True), (CODEC + "BZip2Codec", True)])
def test_round_trip_in_ranges(spark, tmp_path, codec, blocks):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in ROWS], "k string, v binary").repartition(2)
    hadoop_write(df, path, codec, blocks)
    want = sorted(ROWS)
    assert sorted((k, bytes(v)) for k, v in spark.sparkContext.sequenceFile(path).collect()) == want
    for step in (4096, 50_000, 64 << 20):
        assert sorted((r.key, bytes(r.value)) for r in sequence.read_sequence(spark, path, split_bytes=step).collect()) == want
    sequence.register(spark)
    got = spark.read.format("sequencefile").option("splitBytes", 20_000).load(path)
    assert got.schema.simpleString() == "struct<key:string,value:binary>"
    assert sorted((r.key, bytes(r.value)) for r in got.collect()) == want


def test_each_record_is_owned_once(spark, tmp_path):
    path = str(tmp_path / "out")
    hadoop_write(spark.createDataFrame([(k, bytearray(v)) for k, v in ROWS], "k string, v binary").coalesce(1), path)
    (name,) = [str(x) for x in (tmp_path / "out").glob("part*")]
    size = (tmp_path / "out" / name).stat().st_size
    for step in (701, 2003, size - 1, size):
        rows, owners = [], 0
        for a in range(0, size, step):
            mine = list(sequence.records(f"file://{name}", a, min(a + step, size)))
            rows, owners = rows + mine, owners + bool(mine)
        assert rows == list(sequence.records(f"file://{name}", 0, size)) and len(rows) == len(ROWS)
        assert owners > 1 or step > size // 2  # the file is really split


@pytest.mark.parametrize("codec", ["zlib", "gzip", "bzip2"])
def test_hadoop_reads_what_is_written(spark, tmp_path, codec):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in ROWS], "k string, v binary").repartition(3)
    sequence.write_sequence(df, path, "k", "v", codec)
    assert sorted((k, bytes(v)) for k, v in spark.sparkContext.sequenceFile(path).collect()) == sorted(ROWS)
    sequence.write_sequence(df.limit(1), path, "k", "v", codec)  # added to what is there
    assert sequence.read_sequence(spark, path, split_bytes=100_000).count() == len(ROWS) + 1
    assert not [x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("_")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(100).selectExpr("id", "if(id = 77, raise_error('stop'), 'x') as v")
    with pytest.raises(Exception, match="stop"):
        sequence.write_sequence(rows.repartition(4), str(path), "id", "v")
    assert not path.exists() or not [x for x in path.rglob("*") if x.is_file()]
    with pytest.raises(Exception, match="isn't written"):
        sequence.write_sequence(spark.range(1).selectExpr("id", "'x' as v"), str(path), "id", "v", "snappy")


def test_numbers_nulls_and_faults(spark, tmp_path):
    pairs = spark.sparkContext.parallelize([(7, "seven"), (-300, ""), (2**31 - 1, "é")], 1)
    pairs.saveAsSequenceFile(str(tmp_path / "ints"))
    assert {(r.key, bytes(r.value).decode()) for r in sequence.read_sequence(spark, str(tmp_path / "ints")).collect()} == {("7", "seven"), ("-300", ""), (str(2**31 - 1), "é")}
    nulls = spark.createDataFrame([(None, None), ("a", None), (None, bytearray(b"b"))], "k string, v binary")
    sequence.write_sequence(nulls, str(tmp_path / "nulls"), "k", "v")
    assert sorted((r.key, bytes(r.value)) for r in sequence.read_sequence(spark, str(tmp_path / "nulls")).collect()) == [("", b""), ("", b"b"), ("a", b"")]
    sequence.write_sequence(nulls.limit(0), str(tmp_path / "none"), "k", "v")
    assert not list((tmp_path / "none").iterdir())
    assert sequence.read_sequence(spark, str(tmp_path / "none")).count() == 0
    (name,) = (tmp_path / "ints").glob("part*")
    (tmp_path / "cut").write_bytes(name.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends inside a record"):
        sequence.read_sequence(spark, str(tmp_path / "cut")).collect()


def test_warc_source(spark, tmp_path):
    body = "".join(f"WARC/1.0\nWARC-TREC-ID: d{i}\nContent-Length: 4\n\nabc{i % 10}\n\n" for i in range(200))
    (tmp_path / "a.warc").write_text(body)
    warc.register(spark)
    assert {r.docid for r in spark.read.format("warc").option("splitBytes", 500).load(str(tmp_path)).collect()} == {f"d{i}" for i in range(200)}
