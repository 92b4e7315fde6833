"""The pipeline's stages against each other on the smallest tables."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).persist()
        assert after.columns == columns, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids, name
        if name == "quality_rules":
            good = {r.doc_id for r in labels.filter("quality = 1").collect()}
            assert len(good & kept) >= 0.9 * len(good)
        if name == "secret_scan":
            assert kept == ids
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_stages_decide_by_row(spark, tmp_path):
    def words(seed, n=80):
        return " ".join(f"{'abcdefghij'[(seed * 7 + i) % 10]}w{seed}x{i}" for i in range(n))

    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("item_id is not null and trim(text) <> ''").orderBy("item_id").first().text
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def frame(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)

    def left(stage, rows):
        return sorted(r.text for r in dict(corpus_pipeline.STAGES)[stage](spark, frame(rows), SMALL).collect())

    clean = [words(1), words(2), words(3)]
    assert left("quality_rules", [(None, clean[0]), (None, "too short"), (7, clean[1]), (7, "short"), (8, "short")]) == sorted(clean[:2])
    assert left("decontamination", [(None, clean[0]), (None, leak), (7, clean[1]), (7, leak)]) == sorted(clean[:2])
    rows = [(1, clean[0]), (None, clean[0] + " end"), (None, clean[1]), (5, clean[2]), (5, clean[0] + " tail"), (5, clean[2])]
    assert left("jaccard_join", rows) == sorted(clean)


def test_stages_on_nulls_repeats_and_clashing_names(spark):
    text = " ".join(f"{'abcdefghij'[i % 10]}q{i}" for i in range(40_000))
    rows = [(None, None), (None, None), (1, None), (2, ""), (2, ""), (3, " \n "), (4, text), (4, text), (None, text + " more")]
    extra = ["row", "row_key", "component_id", "kept_key", "leak_key", "n", "low", "kept", "piece", "spans", "a.b"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *extra) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)

    def left(name, given):
        got = stages[name](spark, given, SMALL)
        assert got.columns == docs.columns, name
        found = [r.asDict() for r in got.collect()]
        assert all(r[c] == c for r in found for c in extra), name
        return sorted(((r["doc_id"], r["text"]) for r in found), key=repr)

    everything = sorted(rows, key=repr)
    assert left("decontamination", docs) == everything
    assert left("secret_scan", docs) == everything
    assert left("jaccard_join", docs) == sorted({x for x in rows if x[0] is not None or x[1] is None}, key=repr)
    assert not [t for _, t in left("quality_rules", docs) if not (t or "").strip()]
    pieces = stages["packing"](spark, docs, SMALL).collect()
    assert sum(r.n_tokens for r in pieces) == 3 * 40_000 + 1 and {r.doc_id for r in pieces} == {4, None}


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0, name
