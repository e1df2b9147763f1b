"""Date-quality flags and the table constraints as checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import as_date


def date_flags(txn_date: Column, notification_date: Column, filing_date: Column, as_of: Column) -> Column:
    """Violated date rules in reporting order; a missing filing date skips its two rules."""
    rules = [
        (txn_date > notification_date, fv.FLAG_AFTER_NOTIFICATION),
        (txn_date > filing_date, fv.FLAG_AFTER_FILING),
        (txn_date > as_of, fv.FLAG_AFTER_INGESTION),
        (notification_date > filing_date, fv.FLAG_NOTIFICATION_AFTER_FILING),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(flag)) for broken, flag in rules]))


def recomputed_flags(transactions: DataFrame, filings: DataFrame, as_of) -> DataFrame:
    """Every line with ``computed_flags`` and whether they differ from the stored ones."""
    dated = transactions.join(
        filings.select(F.col("id").alias("filing_id"), "doc_id", "filing_date"), "filing_id")
    flags = date_flags(F.col("txn_date"), F.col("notification_date"), F.col("filing_date"), as_date(as_of))
    stored = F.coalesce("quality_flags", F.array().cast("array<string>"))
    return (dated.withColumn("computed_flags", flags)
            .withColumn("changed", ~F.col("computed_flags").eqNullSafe(stored)))


def recompute_summary(recomputed: DataFrame) -> DataFrame:
    return recomputed.agg(F.count(F.lit(1)).alias("examined"), F.count_if("changed").alias("changed"))


def flag_histogram(recomputed: DataFrame) -> DataFrame:
    """Flags among the changed lines."""
    return (recomputed.filter("changed").select(F.explode("computed_flags").alias("flag"))
            .groupBy("flag").agg(F.count(F.lit(1)).alias("n")))


def affected_documents(recomputed: DataFrame) -> DataFrame:
    return recomputed.filter("changed").select("doc_id").distinct()


def with_new_flags(transactions: DataFrame, filings: DataFrame, as_of) -> DataFrame:
    """The transactions table after recomputation; nothing but the flags changes."""
    columns = transactions.columns
    done = recomputed_flags(transactions, filings, as_of)
    return done.withColumn("quality_flags", F.col("computed_flags")).select(*columns)


# --- constraints -------------------------------------------------------------

def _has_text(col: str) -> Column:
    return F.coalesce(F.col(col).rlike(r"\S"), F.lit(False))


def _one_of(col: str, values: tuple[str, ...]) -> Column:
    return F.col(col).isNull() | F.col(col).isin(*values)


FILING_RULES = {
    "doc_kind_domain": lambda: _one_of("doc_kind", fv.DOC_KINDS),
    "source_domain": lambda: _one_of("source", fv.SOURCES),
    "no_self_amendment": lambda: F.col("amends_filing_id").isNull()
    | (F.col("amends_filing_id") != F.col("id")),
    "amendment_method_domain": lambda: _one_of("amendment_method", fv.CURATION_METHODS),
    "amendment_confidence_domain": lambda: _one_of("amendment_confidence", fv.CURATION_CONFIDENCES),
    "amendment_needs_provenance": lambda: F.col("amends_filing_id").isNull()
    | (F.col("amendment_method").isNotNull() & F.col("amendment_confidence").isNotNull()),
}
TRANSACTION_RULES = {
    "txn_type_domain": lambda: _one_of("txn_type", fv.TXN_TYPES),
    "verification_method_domain": lambda: _one_of("verification_method", fv.CURATION_METHODS),
    "verification_confidence_domain": lambda: _one_of("verification_confidence", fv.CURATION_CONFIDENCES),
    "evidence_not_blank": lambda: F.col("verification_source_doc_id").isNull()
    | _has_text("verification_source_doc_id"),
    "verified_date_needs_provenance": lambda: F.col("verified_transaction_date").isNull()
    | (F.col("verification_method").isNotNull() & F.col("verification_confidence").isNotNull()
       & _has_text("verification_source_doc_id")),
}
FILING_REQUIRED = ("doc_id", "year", "first_name", "last_name", "state_district", "doc_kind",
                   "pdf_url", "source")
TRANSACTION_REQUIRED = ("filing_id", "sequence", "asset_name", "txn_type", "txn_date",
                        "notification_date", "amount_min", "amount_raw", "quality_flags")


def row_violations(table: DataFrame, rules: dict, required: tuple[str, ...], key: list[str]) -> DataFrame:
    """One row per broken rule and record."""
    checks = [F.when(~rule(), F.lit(name)) for name, rule in rules.items()]
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c}_required")) for c in required]
    broken = F.array_compact(F.array(*checks))
    return table.select(*key, F.explode(broken).alias("rule"))


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    return (table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def orphans(transactions: DataFrame, filings: DataFrame) -> DataFrame:
    """Lines whose filing does not exist."""
    return transactions.join(filings.select(F.col("id").alias("filing_id")), "filing_id", "left_anti")
