"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, secret redaction, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontamination, packing, quality_rules, secrets, set_join
from rankloom.llm.common import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents that the quality rules keep; each carries its own verdict, so no text is joined or shuffled.

    Null, empty and short texts go. Every row is judged by its text and language alone: repeated rows stay or go together, null ids count like
    others, and columns of any name are passed on. An empty table stays empty.
    """
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), carry=True).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    The smallest doc_id stays, a null id only where the group has no other; ties go by a hash of the row. Rows that repeat both id and text are one.
    Null, empty and blank texts have no shingles, link with nothing and stay. Columns of any name are passed on. An empty table stays empty.
    """
    return set_join.one_per_component(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item.

    A row is told by its whole text alone: equal texts stay or go together, whatever their ids, and null, empty and blank texts stay. Items without
    words leak nowhere; with an empty benchmark all rows stay. Columns of any name are passed on. An empty table stays empty.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, and n_chars to match.

    Every row stays as often as it is there, null ids too; null texts stay null and empty ones empty. Columns of any name are passed on. An empty table
    stays empty.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their bucket, batch and slot, in place of the columns of documents.

    Texts of any length are cut into pieces, none is dropped. Null, empty and blank texts give no piece, repeated rows and null ids their own. Other columns
    are left out. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The near-duplicate, decontamination and secret stages are not expressible in SQL; the tests hold their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
