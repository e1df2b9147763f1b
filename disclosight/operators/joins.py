"""Joins between filings and transactions.

No key is assumed to be evenly spread. Counts are pre-aggregated before they meet a join, and
optional references, which are NULL for most rows, get a spread key so that the NULL rows do
not all hash to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILING_COLUMNS = ("doc_id", "filing_date", "created_at", "first_name", "last_name", "state_district")


def lines(transactions: DataFrame, filings: DataFrame, columns: tuple[str, ...] = FILING_COLUMNS) -> DataFrame:
    """Transactions with the columns of the filing that discloses them."""
    return transactions.join(filings.select(F.col("id").alias("filing_id"), *columns), "filing_id")


def spread_nulls(reference: Column, row_id: Column) -> Column:
    """``reference`` as text, or a per-row text that matches nothing when it is NULL."""
    return F.coalesce(reference.cast("string"), F.concat(F.lit("\u0000"), row_id.cast("string")))


def line_counts(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("filing_id").agg(F.count(F.lit(1)).alias("transaction_count"))


def with_line_counts(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Filings with their number of lines, 0 when there are none.

    Only lines of the given filings are counted, be they a page or a whole table; how the ids meet
    the lines is left to the optimizer, which knows their size.
    """
    own = transactions.select("filing_id").join(filings.select(F.col("id").alias("filing_id")), "filing_id", "left_semi")
    counts = line_counts(own).withColumnRenamed("filing_id", "_filing_id")
    return (filings.join(counts, F.col("id") == F.col("_filing_id"), "left")
            .withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))
            .drop("_filing_id"))


def with_amended_doc(filings: DataFrame, all_filings: DataFrame) -> DataFrame:
    """Adds ``amends_doc_id``, the document the filing amends."""
    original = all_filings.select(F.col("id").cast("string").alias("_ref"),
                                  F.col("doc_id").alias("amends_doc_id"))
    keyed = filings.withColumn("_key", spread_nulls(F.col("amends_filing_id"), F.col("id")))
    return keyed.join(original, F.col("_key") == F.col("_ref"), "left").drop("_key", "_ref")


def amendments_of(originals: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per (original, amending filing); ``originals`` needs ``id`` and ``doc_id``."""
    named = originals.select(F.col("id").alias("_id"), F.col("doc_id").alias("original_doc_id"))
    return filings.join(named, F.col("amends_filing_id") == F.col("_id")).drop("_id")


def with_evidence_flag(transactions: DataFrame, filings: DataFrame) -> DataFrame:
    """Adds whether the cited evidence document is a stored filing."""
    cited = (transactions.filter(F.col("verification_source_doc_id").isNotNull())
             .select(F.col("verification_source_doc_id").alias("doc_id")).distinct())
    present = (filings.select("doc_id").join(cited, "doc_id", "left_semi").distinct()
               .withColumnRenamed("doc_id", "_present"))
    keyed = transactions.withColumn(
        "_key", spread_nulls(F.col("verification_source_doc_id"), F.col("id")))
    return (keyed.join(present, F.col("_key") == F.col("_present"), "left")
            .withColumn("verification_source_doc_exists", F.col("_present").isNotNull())
            .drop("_key", "_present"))


def with_evidence_flags(transactions: DataFrame, filings: DataFrame) -> DataFrame:
    """``with_evidence_flag`` for whole tables, where few lines cite a document: the others are not moved for it.

    The lines are read for either kind, so they should be a stored table or joins of such, and no page.
    """
    cites = F.col("verification_source_doc_id").isNotNull()
    flagged = with_evidence_flag(transactions.filter(cites), filings)
    return flagged.unionByName(transactions.filter(~cites).withColumn("verification_source_doc_exists", F.lit(False)))


def not_yet_stored(index: DataFrame, filings: DataFrame) -> DataFrame:
    return index.join(filings.select("doc_id"), "doc_id", "left_anti")
