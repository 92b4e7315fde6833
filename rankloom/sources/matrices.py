"""Similarity matrices, term weights and word vectors from files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A


def _numbers(path: str, spark: SparkSession, kind: str, cells) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "value": [cells(np.load(io.BytesIO(c), allow_pickle=False)) for c in f["content"]]})

    return files.mapInPandas(run, f"path string, value {kind}")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, matrix) of files <qid>/<docno>.npy, each a matrix of query terms by document terms."""
    rows = _numbers(path, spark, "array<array<float>>", lambda x: [r.astype(np.float32).tolist() for r in np.atleast_2d(x)])
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).cast("int").alias("qid"), F.regexp_replace(F.element_at(parts, -1), r"\.npy$", "").alias("docno"), F.col("value").alias("matrix"))


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    """(qid, idf) of files <qid>.npy, each the weights of a query's terms."""
    rows = _numbers(path, spark, "array<float>", lambda x: x.astype(np.float32).ravel().tolist())
    return rows.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("qid"), F.col("value").alias("idf"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of lines `word x y z ...`; a first line of two numbers, count and width, is no word."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").filter(~F.trim("value").rlike(r"^\d+ \d+$"))
    return rows.select(f[0].alias("word"), F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: x.cast("float")).alias("vector"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(docno, tokens) of lines `docno token token ...` in the part files below path; a line without a token is left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part*").text(path)
    f = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return rows.select(f.alias("f")).filter("size(f) > 1").select(F.col("f")[0].alias("docno"), F.slice("f", F.lit(2), F.size("f") - 1).alias("tokens"))


def doc_rows(docmap: Column, docno: Column) -> Column:
    """A document's place in a JSON docmap {docno: place}."""
    return F.from_json(docmap, "map<string,int>")[docno]


def assemble(topic: DataFrame, description: DataFrame, topic_idf: DataFrame, description_idf: DataFrame, rows: int, columns: int, positions=None) -> DataFrame:
    """(qid, docno, matrix, idf): a pair's topic rows above its description rows, padded to rows x columns, and the weights of all rows.

    topic, description: (qid, docno, matrix); the weights: (qid, idf). If topic and description together have too many terms, the description's terms with
    the lowest weights go. positions picks the columns (an expression of the column maxima) before padding. Weights behind the last term are 0. A pair that lacks
    either matrix is left out, and a topic with more terms than rows is an error.
    """
    d = description_idf.select("qid", F.col("idf").alias("d_idf"))
    t = topic_idf.select("qid", F.col("idf").alias("t_idf"))
    x = topic.select("qid", "docno", F.col("matrix").alias("t")).join(description.select("qid", "docno", F.col("matrix").alias("d")), ["qid", "docno"]).join(t, "qid").join(d, "qid")
    room = F.when(F.size("t_idf") <= rows, F.lit(rows) - F.size("t_idf")).otherwise(F.raise_error(F.lit("a topic has more terms than rows")).cast("int"))
    order = F.transform("d_idf", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    x = x.withColumn("keep", F.sort_array(F.transform(F.slice(F.array_sort(order), F.lit(1), room), lambda p: p["i"])))
    both = F.concat("t", F.transform("keep", lambda i: F.col("d")[i]))
    x = x.withColumn("m", both).withColumn("w", F.concat("t_idf", F.transform("keep", lambda i: F.col("d_idf")[i])))
    picked = F.col("m") if positions is None else A.select_columns(F.col("m"), positions(A.column_max(F.col("m"))))
    return x.select("qid", "docno", A.pad_matrix(picked, rows, columns).alias("matrix"), A.pad(F.col("w"), rows).alias("idf"))
