"""Landed report documents: one file per document, named by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, body, path)`` of text or HTML files; the id is the file name without extension.

    A document that was landed as several files has several rows; ``first_landed`` chooses one.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:\.[A-Za-z]+)?\z", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"))


def read_document_table(spark: SparkSession, path: str) -> DataFrame:
    """Documents landed as a parquet table, the form to use for very many small documents."""
    return spark.read.schema("doc_id string, body string").parquet(path)


def first_landed(documents: DataFrame, *others: str) -> DataFrame:
    """One version per document: ``(doc_id, *others, body, path, landed, conflict)``.

    Of the bodies landed under an id, the one of the smallest path stays, and of the same path (or without any) the one
    with the smallest length and hash: arrival, partitions and retries do not matter. ``landed`` counts all, and
    ``conflict`` says that they were not all equal. ``others`` are columns that the id decides.

    Copies combine before the shuffle, so a document landed any number of times is one row of each task. Documents
    that are partitioned by id already, as after a join on it, are not shuffled again.
    """
    path = F.col("path") if "path" in documents.columns else F.lit(None).cast("string")
    print_ = F.struct(F.coalesce(F.octet_length("body"), F.lit(-1)).alias("size"), F.xxhash64("body").alias("hash"))
    rows = documents.select("doc_id", *others, "body", F.coalesce(path, F.lit("")).alias("_path"), print_.alias("_print"))
    first = rows.groupBy("doc_id", *others).agg(
        F.min_by(F.struct("body", "_path"), F.struct("_path", "_print")).alias("_first"), F.count(F.lit(1)).alias("landed"),
        (F.min("_print") != F.max("_print")).alias("conflict"))
    return first.select("doc_id", *others, "_first.body", F.nullif(F.col("_first._path"), F.lit("")).alias("path"), "landed", "conflict")
