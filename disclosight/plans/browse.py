"""Browsing filings, lines and people: filters, whitelisted order, pages and detail views."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lag_days
from ..functions.identity import filing_name, full_name, person_key
from ..operators import aggregates, filters, joins, ordering

# --- fixed values: public output names ---
FILING_FIELDS = ["doc_id", "year", "name", "state_district", "filing_date", "doc_kind", "pdf_url",
                 "downloaded_at", "created_at", "transaction_count"]
AMENDMENT_FIELDS = ["amends_doc_id", "amendment_method", "amendment_confidence", "amendment_note",
                    "amendment_verified_at"]
RELATION_FIELDS = ["doc_id", "name", "filing_date", "pdf_url", *AMENDMENT_FIELDS]
LINE_FIELDS = [
    "id", "filing_id", "doc_id", "filing_date", "politician_id", "politician_name", "sequence",
    "asset_name", "ticker", "asset_type_code", "txn_type", "txn_date", "disclosure_lag_days",
    "notification_date", "amount_min", "amount_max", "amount_raw", "owner", "filing_status",
    "ownership_source", "notes", "txn_source_id", "quality_flags", "verified_transaction_date",
    "verification_method", "verification_confidence", "verification_source_doc_id",
    "verification_note", "verified_at", "verification_source_doc_exists"]


def filing_rows(filings: DataFrame, extra: list[str] | None = None) -> DataFrame:
    name = filing_name(*[F.col(c) for c in ("prefix", "first_name", "last_name", "suffix")])
    return filings.withColumn("name", name).select(*FILING_FIELDS, *(extra or []))


def line_rows(lines: DataFrame) -> DataFrame:
    """The public fields of lines that carry their filing and evidence columns."""
    who = [F.col(c) for c in ("state_district", "first_name", "last_name")]
    return (lines.withColumn("politician_id", person_key(*who))
            .withColumn("politician_name", full_name(*who[1:]))
            .withColumn("disclosure_lag_days", lag_days(F.col("filing_date"), F.col("txn_date")))
            .withColumn("owner", F.col("owner_token")).select(*LINE_FIELDS))


def politician_rows(rollup: DataFrame) -> DataFrame:
    who = [F.col(c) for c in ("state_district", "first_name", "last_name")]
    return rollup.select(
        person_key(*who).alias("id"), full_name(*who[1:]).alias("name"),
        F.lit(None).cast("string").alias("party"), F.substring("state_district", 1, 2).alias("state"),
        F.expr("substring(state_district, 3)").alias("district"), "state_district", "filing_count",
        "transaction_count")


# --- filings -----------------------------------------------------------------

def select_filings(filings: DataFrame, politician=None, state=None, year=None,
                   filing_date_min=None, filing_date_max=None) -> DataFrame:
    chosen = filters.filings_of_state(filters.of_politician(filings, politician), state)
    return filters.between_dates(filters.in_index_year(chosen, year), "filing_date",
                                 filing_date_min, filing_date_max)


def filings_page(filings: DataFrame, transactions: DataFrame, sort: str | None = "-created_at",
                 limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    order = ordering.filing_order(sort)
    rows = ordering.page(select_filings(filings, **wanted), order, limit, offset)
    counted = joins.with_line_counts(rows, transactions)
    return filing_rows(counted.orderBy(*order))


class FilingDetail(NamedTuple):
    header: DataFrame
    lines: DataFrame
    amendments: DataFrame


LINE_ORDER = "doc_id, sequence"
AMENDMENT_ORDER = "original_doc_id, filing_date nulls last, doc_id"


def filing_detail(filings: DataFrame, transactions: DataFrame, doc_ids: DataFrame) -> FilingDetail:
    """Header, lines and amendments of the filings named in ``doc_ids``, keyed by ``doc_id``.

    The tables are in no order; ``LINE_ORDER`` and ``AMENDMENT_ORDER`` name theirs.
    """
    chosen = filings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    full = joins.with_amended_doc(joins.with_line_counts(chosen, transactions), filings)
    own = transactions.join(chosen.select(F.col("id").alias("filing_id")), "filing_id", "left_semi")
    lines = line_rows(joins.with_evidence_flags(joins.lines(own, filings), filings))
    later = joins.amendments_of(chosen, filings)
    later = later.withColumn("amends_doc_id", F.col("original_doc_id")).withColumn(
        "name", filing_name(*[F.col(c) for c in ("prefix", "first_name", "last_name", "suffix")]))
    return FilingDetail(filing_rows(full, AMENDMENT_FIELDS), lines,
                        later.select("original_doc_id", *RELATION_FIELDS))


# --- lines -------------------------------------------------------------------

def select_transactions(transactions: DataFrame, filings: DataFrame, doc_ids: DataFrame | None = None, ticker=None,
                        asset_type_code=None, txn_type=None, owner=None, year=None, txn_date_min=None, txn_date_max=None,
                        amount_min=None, amount_max=None) -> DataFrame:
    """Lines narrowed by the filters on the line itself; ``year`` overrides the dates."""
    if doc_ids is not None:
        transactions = filters.lines_of_document(transactions, filings, doc_ids)
    chosen = filters.equals(filters.ticker_is(transactions, ticker), asset_type_code=asset_type_code,
                            txn_type=txn_type, owner_token=owner)
    if year is not None:
        chosen = filters.traded_in_year(chosen, year)
    else:
        chosen = filters.between_dates(chosen, "txn_date", txn_date_min, txn_date_max)
    return filters.amount_between(chosen, amount_min, amount_max)


def select_lines(transactions: DataFrame, filings: DataFrame, politician=None, politician_name=None, **wanted) -> DataFrame:
    """Lines with their filing, narrowed by every given filter."""
    who = filters.name_contains(filters.of_politician(filings, politician), politician_name)
    return joins.lines(select_transactions(transactions, filings, **wanted), who)


#: Sort keys that need the filing of a line.
FILING_KEYS = ("politician_name", "disclosure_lag_days", "created_at", "doc_id")


def lines_page(transactions: DataFrame, filings: DataFrame, sort: str | None = "-txn_date",
               limit: int = 50, offset: int = 0, politician=None, politician_name=None, **wanted) -> DataFrame:
    """One page; the evidence lookup only sees the rows of the page.

    Where neither a filter nor the order needs filings, the page is cut first and only its rows are
    joined (every line has a filing).
    """
    order = ordering.transaction_order(sort)
    if politician is None and politician_name is None and (sort or "").lstrip("-") not in FILING_KEYS:
        rows = ordering.page(select_transactions(transactions, filings, **wanted), order, limit, offset)
        rows = joins.lines(rows, filings)
    else:
        rows = ordering.page(select_lines(transactions, filings, politician, politician_name, **wanted), order, limit, offset)
    return line_rows(joins.with_evidence_flag(rows, filings).orderBy(*order))


# --- people ------------------------------------------------------------------

def select_politicians(filings: DataFrame, transactions: DataFrame, state=None, name=None) -> DataFrame:
    chosen = filters.name_contains(filters.politicians_of_state(filings, state), name)
    return aggregates.politician_rollup(chosen, transactions)


def politicians_page(filings: DataFrame, transactions: DataFrame, sort: str | None = "last_name",
                     limit: int = 50, offset: int = 0, state=None, name=None) -> DataFrame:
    rollup = select_politicians(filings, transactions, state, name)
    return politician_rows(ordering.page(rollup, ordering.politician_order(sort), limit, offset))


def politician_detail(filings: DataFrame, transactions: DataFrame, who: tuple[str, str, str]) -> DataFrame:
    return politician_rows(aggregates.politician_rollup(filters.of_politician(filings, who), transactions))


def politician_details(filings: DataFrame, transactions: DataFrame, people: DataFrame) -> DataFrame:
    """One row per person of ``people(state_district, first_name, last_name)``; only their filings and lines are counted."""
    return politician_rows(aggregates.politician_rollup(filters.of_politicians(filings, people), transactions))
