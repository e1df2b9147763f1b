"""Reviewed corrections, applied in bulk from decision tables.

A decision names one line or one filing; nothing is inferred and source values never change.
When several valid decisions name the same record, the highest ``decision_no`` counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


class Applied(NamedTuple):
    table: DataFrame
    rejected: DataFrame
    changes: DataFrame   # id and new values of the columns, of the rows that a valid decision names


VERIFICATION = ("verified_transaction_date", "verification_method", "verification_confidence",
                "verification_source_doc_id", "verification_note", "verified_at")
AMENDMENT = ("amends_filing_id", "amendment_method", "amendment_confidence", "amendment_note",
             "amendment_verified_at")


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks])


def _provenance(method: str, confidence: str) -> list[tuple[Column, str]]:
    return [(~F.col(method).isin(*fv.CURATION_METHODS), "invalid method"),
            (~F.col(confidence).isin(*fv.CURATION_CONFIDENCES), "invalid confidence")]


def locate_lines(decisions: DataFrame, transactions: DataFrame, filings: DataFrame) -> DataFrame:
    """Fill ``transaction_id`` of decisions that name a line by ``doc_id`` and ``sequence``.

    Unknown ids become NULL. The decisions drive both lookups, so only lines they name move.
    """
    # ids 1:1 with decisions; a duplicate (doc_id, sequence) resolves to its lowest line id
    by_id = (transactions.join(decisions.select(F.col("transaction_id").alias("id")).distinct(), "id", "left_semi")
             .select(F.col("id").alias("_known")).distinct())
    named = decisions.filter(F.col("transaction_id").isNull()).select("doc_id", "sequence").distinct()
    wanted = filings.select("doc_id", F.col("id").alias("filing_id")).join(named, "doc_id")
    by_name = (transactions.join(wanted, ["filing_id", "sequence"]).groupBy("doc_id", "sequence")
               .agg(F.min("id").alias("_named")))
    return (decisions.join(by_id, decisions["transaction_id"] == F.col("_known"), "left")
            .join(by_name, ["doc_id", "sequence"], "left")
            .withColumn("transaction_id", F.coalesce("_known", F.when(F.col("transaction_id").isNull(),
                                                                      F.col("_named"))))
            .drop("_known", "_named"))


def _latest(valid: DataFrame, key: str, fields: list[Column]) -> DataFrame:
    return valid.groupBy(key).agg(F.max_by(F.struct("action", *fields), F.col("decision_no")).alias("_d"))


def _changes(latest: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """New values per record; a ``clear`` decision empties them."""
    value = lambda c: F.when(F.col("_d.action") != "clear", F.col(f"_d.{c}"))
    return latest.select(F.col(key).alias("id"), *[value(c).alias(c) for c in columns])


def _overlay(table: DataFrame, latest: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Replace ``columns`` where a decision exists; a ``clear`` decision empties them."""
    order = table.columns
    joined = table.join(latest, table["id"] == latest[key], "left")
    for column in columns:
        new = F.when(F.col("_d.action") == "clear", F.lit(None)).otherwise(F.col(f"_d.{column}"))
        joined = joined.withColumn(column, F.when(F.col("_d").isNull(), F.col(column)).otherwise(new))
    return joined.select(*order)


def apply_verifications(transactions: DataFrame, filings: DataFrame, decisions: DataFrame) -> Applied:
    """Attach or clear verified dates.

    ``decisions``: decision_no, action (``verify``/``clear``), transaction_id or doc_id+sequence,
    verified_transaction_date, method, confidence, source_doc_id, note, verified_at.
    """
    located = locate_lines(decisions, transactions, filings)
    verify = F.col("action") == "verify"
    needs = [(F.col("verified_transaction_date").isNull(), "verified date is required"),
             *_provenance("method", "confidence"),
             (~F.col("source_doc_id").rlike(r"\S"), "evidence document is required")]
    reason = F.coalesce(
        _first_reason((~F.col("action").isin("verify", "clear"), "unknown action")),
        F.when(verify, _first_reason(*needs)),
        F.when(F.col("transaction_id").isNull(), F.lit("unknown transaction")))
    judged = located.withColumn("reason", reason)
    latest = _latest(judged.filter(F.col("reason").isNull()), "transaction_id", [
        F.col("verified_transaction_date"), F.col("method").alias("verification_method"),
        F.col("confidence").alias("verification_confidence"),
        F.col("source_doc_id").alias("verification_source_doc_id"),
        F.col("note").alias("verification_note"), F.col("verified_at")])
    return Applied(_overlay(transactions, latest, "transaction_id", VERIFICATION),
                   judged.filter(F.col("reason").isNotNull()).select("decision_no", "reason"),
                   _changes(latest, "transaction_id", VERIFICATION))


def apply_amendment_links(filings: DataFrame, decisions: DataFrame) -> Applied:
    """Link an amending filing to its original, or clear the link.

    ``decisions``: decision_no, action (``link``/``clear``), amended_doc_id, original_doc_id,
    method, confidence, note, verified_at.
    """
    ids = filings.select("doc_id", "id")
    amended = ids.withColumnsRenamed({"doc_id": "amended_doc_id", "id": "_amended"})
    original = ids.withColumnsRenamed({"doc_id": "original_doc_id", "id": "_original"})
    found = (decisions.join(amended, "amended_doc_id", "left").join(original, "original_doc_id", "left"))
    link = F.col("action") == "link"
    reason = F.coalesce(
        _first_reason((~F.col("action").isin("link", "clear"), "unknown action")),
        F.when(link, F.coalesce(
            _first_reason(*_provenance("method", "confidence")),
            F.when(F.col("amended_doc_id") == F.col("original_doc_id"), "a filing cannot amend itself"))),
        F.when(F.col("_amended").isNull(), F.lit("unknown amended filing")),
        F.when(link & F.col("_original").isNull(), F.lit("unknown original filing")))
    judged = found.withColumn("reason", reason)
    latest = _latest(judged.filter(F.col("reason").isNull()), "_amended", [
        F.col("_original").alias("amends_filing_id"), F.col("method").alias("amendment_method"),
        F.col("confidence").alias("amendment_confidence"), F.col("note").alias("amendment_note"),
        F.col("verified_at").alias("amendment_verified_at")])
    return Applied(_overlay(filings, latest, "_amended", AMENDMENT),
                   judged.filter(F.col("reason").isNotNull()).select("decision_no", "reason"),
                   _changes(latest, "_amended", AMENDMENT))


def amendment_candidates(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Unlinked filings with a line the source marks as amended; never linked automatically."""
    amended = transactions.filter(F.col("filing_status") == "Amended").select("filing_id")
    return (filings.filter(F.col("amends_filing_id").isNull())
            .join(amended, F.col("id") == F.col("filing_id"), "left_semi").select("doc_id").distinct())


def unresolved_lines(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Flagged lines without a verified date, in no order."""
    open_lines = transactions.filter((F.size("quality_flags") > 0)
                                     & F.col("verified_transaction_date").isNull())
    docs = filings.select(F.col("id").alias("filing_id"), "doc_id")
    return (open_lines.join(docs, "filing_id")
            .select("doc_id", "sequence", "txn_date", "notification_date", "quality_flags"))
