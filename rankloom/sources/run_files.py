"""Readers and writers of the positional text formats of retrieval experiments: white-space separated, without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return lines.select("line_no", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"), "value")


def _exactly(df: DataFrame, n: int, what: str) -> DataFrame:
    return _checked(df, F.size("f") == n, F.concat(F.lit(f"malformed {what} line: "), F.col("value")))


def _checked(df: DataFrame, good: Column, message: Column) -> DataFrame:
    """df, an error where a row isn't good. A filter, so that it holds whichever columns are read later."""
    return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rel); four fields a line, else an error."""
    f = F.col("f")
    return _exactly(_fields(spark, path), 4, "qrels").select(f[0].alias("qid"), f[2].alias("docno"), f[3].cast("int").alias("rel"))


def read_qrels_jg(spark: SparkSession, path: str) -> DataFrame:
    """(qid, jg, docno, rel), the second field a judgment group; a document twice in one group is an error."""
    f = F.col("f")
    rows = _exactly(_fields(spark, path), 4, "qrels").select(f[0].alias("qid"), f[1].alias("jg"), f[2].alias("docno"), f[3].cast("int").alias("rel"))
    n = F.count("*").over(Window.partitionBy("qid", "jg", "docno"))
    return _checked(rows.withColumn("n", n), F.col("n") == 1, F.lit("a document is judged twice in one group")).drop("n")


def read_prefs(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _exactly(_fields(spark, path), 5, "preference").select(f[0].alias("qid"), f[1].alias("jg"), f[2].alias("jsg"), f[3].alias("docno"), f[4].cast("double").alias("level"))


def read_qrels_as_prefs(spark: SparkSession, path: str) -> DataFrame:
    """qrels lines as preferences of one sub-group."""
    f = F.col("f")
    return _exactly(_fields(spark, path), 4, "qrels").select(f[0].alias("qid"), f[1].alias("jg"), F.lit("0").alias("jsg"), f[2].alias("docno"), f[3].cast("double").alias("level"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rank, sim, run_id): six fields or more, the rest is ignored; the last line's run id holds for all."""
    f = F.col("f")
    rows = _fields(spark, path).select("line_no", f[0].alias("qid"), f[2].alias("docno"), f[3].try_cast("int").alias("rank"), f[4].cast("double").alias("sim"), f[5].alias("run_id"))
    last = rows.agg(F.max_by("run_id", "line_no").alias("run_id"))  # one row
    return rows.drop("run_id", "line_no").join(F.broadcast(last))


def read_graded_qrels(spark: SparkSession, path: str, most: int = 4) -> DataFrame:
    """Positive judgments; a prefix before the topic number goes, the second field must be 0 and grades at most `most`."""
    f = F.col("f")
    rows = _checked(_exactly(_fields(spark, path), 4, "qrels"), (f[1] == "0") & (f[3].cast("int") <= most), F.lit("malformed graded judgment"))
    return rows.select(F.regexp_replace(f[0], "^.*-", "").alias("qid"), f[2].alias("docno"), f[3].cast("int").alias("rel")).filter("rel > 0")


def read_graded_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, sim, run_id): six fields a line, the second Q0, the rank a whole number from 0 on and the score a number, else an error; a document twice in a topic is an error."""
    f = F.col("f")
    good = (f[1] == "Q0") & f[3].rlike(r"^\d+$") & f[4].try_cast("double").isNotNull()
    rows = _checked(_exactly(_fields(spark, path), 6, "run"), good, F.concat(F.lit("malformed run line: "), F.col("value")))
    rows = rows.select(F.regexp_replace(f[0], "^.*-", "").alias("qid"), f[2].alias("docno"), f[4].try_cast("double").alias("sim"), f[5].alias("run_id"))
    n = F.count("*").over(Window.partitionBy("qid", "docno"))
    return _checked(rows.withColumn("n", n), F.col("n") == 1, F.lit("a document is retrieved twice")).drop("n")


def read_labels(spark: SparkSession, path: str, qids: list[int], include_spam: bool = False) -> DataFrame:
    """(qid, docno, rel) of some topics; negative labels only with include_spam; a later line replaces an earlier one."""
    f = F.col("f")
    rows = _fields(spark, path).select("line_no", f[0].cast("int").alias("qid"), f[2].alias("docno"), f[3].cast("int").alias("rel")).filter(F.col("qid").isin(qids))
    last = rows.groupBy("qid", "docno").agg(F.max_by("rel", "line_no").alias("rel"))
    return last if include_spam else last.filter("rel >= 0")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, sim, inverse_rank) of a run, its own ranks taken at their word."""
    return read_run(spark, path).select(F.col("qid").cast("int").alias("qid"), "docno", "sim", (1.0 / F.col("rank")).alias("inverse_rank"))


def read_z_reference(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _exactly(_fields(spark, path), 4, "z-score").select(f[0].alias("qid"), f[1].alias("measure"), f[2].cast("double").alias("mean"), f[3].cast("double").alias("stddev"))


def read_graded_report(spark: SparkSession, path: str) -> DataFrame:
    """(runid, qid, ndcg, err) of a report; the row amean is topic 0."""
    rows = spark.read.csv(path, header=True).toDF("runid", "topic", "ndcg", "err")
    return rows.select("runid", F.when(F.col("topic") == "amean", 0).otherwise(F.col("topic").try_cast("int")).alias("qid"), F.col("ndcg").cast("double").alias("ndcg"), F.col("err").cast("double").alias("err"))


def read_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of a folder whose names say epoch_ndcg_map_err_loss.run: (epoch, ndcg, map, err, loss, qid, docno, sim)."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.text(directory).select("value", name.alias("name")).filter(F.trim("value") != "")
    p, f = F.split(F.regexp_replace("name", r"\.run$", ""), "_"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return rows.select(p[0].cast("int").alias("epoch"), *(p[i].cast("double").alias(c) for i, c in enumerate(("ndcg", "map", "err", "loss"), 1)), f[0].cast("int").alias("qid"), f[2].alias("docno"), f[4].cast("double").alias("sim"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(number, query, description) of <topic number=...> elements."""
    schema = "_number int, query string, description string"
    return spark.read.format("xml").option("rowTag", "topic").schema(schema).load(path).select(F.col("_number").alias("number"), F.trim("query").alias("query"), F.trim("description").alias("description"))


def read_filter_list(spark: SparkSession, path: str) -> DataFrame:
    """(docid, qid) of one- or two-column lines."""
    f = F.col("f")
    return _fields(spark, path).select(f[0].alias("docid"), F.get(f, F.lit(1)).cast("int").alias("qid"))


def run_lines(run: DataFrame, runid: str, digits: int = 10) -> Column | DataFrame:
    """Lines `qid Q0 docno rank score runid`, by topic and falling score."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "docno"))
    rows = run.withColumn("rank", rank)
    return rows.orderBy("qid", "rank").select(F.format_string(f"%s Q0 %s %d %.{digits}e {runid}", F.col("qid").cast("string"), "docno", "rank", F.col("sim").cast("double")).alias("value"))


def write_run(run: DataFrame, path: str, runid: str, digits: int = 10) -> None:
    run_lines(run, runid, digits).write.mode("overwrite").text(path)


def measure_lines(values: DataFrame, z: bool = False) -> DataFrame:
    """Lines of (measure, qid, value): counts as whole numbers, the rest with four places."""
    name = F.concat(F.lit("Z" if z else ""), F.col("measure"))
    whole = F.col("measure").rlike("^(prefs_)?num_")
    return values.select(F.when(whole, F.format_string("%-22s\t%s\t%d", name, "qid", F.col("value").cast("bigint"))).otherwise(F.format_string("%-22s\t%s\t%6.4f", name, "qid", F.col("value"))).alias("value"))


def report_lines(report: DataFrame) -> DataFrame:
    return report.select(F.format_string("%s,%s,%.5f,%.5f", "runid", "topic", "ndcg", "err").alias("value"))


def reranked_name(name: str) -> str:
    """The file name of a re-ranked run."""
    return f"rr_{name.rsplit('/', 1)[-1]}"


def write_reranked(run: DataFrame, folder: str, name: str, runid: str, digits: int = 10) -> str:
    path = f"{folder.rstrip('/')}/{reranked_name(name)}"
    write_run(run, path, runid, digits)
    return path


def write_report(table: DataFrame, path: str) -> None:
    """A CSV file with a header, numbers that aren't whole with three places, nulls empty."""
    cols = [F.format_string("%.3f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    shown = [F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(table.columns, cols, strict=True)]
    table.select(*shown).write.mode("overwrite").option("header", "true").csv(path)


def write_by_document(rows: DataFrame, path: str, files: int = 16) -> None:
    """(qid, docid, ...) as one folder for each topic, with its rows dealt over a number of files by docid, so that a large topic is not one task's work."""
    rows.repartition("qid", F.pmod(F.xxhash64("docid"), F.lit(files))).sortWithinPartitions("qid", "docid").write.mode("overwrite").partitionBy("qid").parquet(path)


def write_by_topic(df: DataFrame, path: str) -> None:
    """One folder for each topic, in one pass; a topic is up to eight tasks' work, dealt by a hash of the row, so that a task that runs again writes the same rows."""
    df.repartition("qid", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("qid").parquet(path)
