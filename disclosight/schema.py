"""Explicit schemas of the stored tables and of every landed source."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


S, I, L, D, TS, B = (T.StringType(), T.IntegerType(), T.LongType(), T.DateType(),
                     T.TimestampType(), T.BooleanType())

FILINGS = _struct(
    ("id", L, False), ("doc_id", S, False), ("year", I, False), ("prefix", S, True),
    ("first_name", S, False), ("last_name", S, False), ("suffix", S, True),
    ("state_district", S, False), ("filing_date", D, True), ("doc_kind", S, False),
    ("pdf_url", S, False), ("raw_pdf", T.BinaryType(), True), ("downloaded_at", TS, False),
    ("created_at", TS, False), ("source", S, False), ("amends_filing_id", L, True),
    ("amendment_method", S, True), ("amendment_confidence", S, True),
    ("amendment_note", S, True), ("amendment_verified_at", TS, True),
    ("bioguide_id", S, True),
)

TRANSACTIONS = _struct(
    ("id", L, False), ("filing_id", L, False), ("sequence", I, False),
    ("txn_source_id", S, True), ("owner_token", S, True), ("asset_name", S, False),
    ("ticker", S, True), ("asset_type_code", S, True), ("txn_type", S, False),
    ("txn_date", D, False), ("notification_date", D, False), ("amount_min", L, False),
    ("amount_max", L, True), ("amount_raw", S, False), ("cap_gains_flag", B, True),
    ("filing_status", S, True), ("ownership_source", S, True), ("notes", S, True),
    ("quality_flags", T.ArrayType(S), False), ("verified_transaction_date", D, True),
    ("verification_method", S, True), ("verification_confidence", S, True),
    ("verification_source_doc_id", S, True), ("verification_note", S, True),
    ("verified_at", TS, True),
)

INGEST_RUNS = _struct(
    ("started_at", TS, False), ("finished_at", TS, True), ("status", S, False),
    ("year_targets", T.ArrayType(S), False), ("filings_indexed", L, False),
    ("filings_new", L, False), ("filings_skipped", L, False), ("scanned_skipped", L, False),
    ("download_failed", L, False), ("parse_failed", L, False),
    ("transactions_stored", L, False), ("error", S, True), ("source", S, False),
)

#: Columns that may change after a row is stored, by table; all others are source values.
MUTABLE = {
    "transactions": ("quality_flags", "verified_transaction_date", "verification_method", "verification_confidence",
                     "verification_source_doc_id", "verification_note", "verified_at"),
    "filings": ("amends_filing_id", "amendment_method", "amendment_confidence", "amendment_note", "amendment_verified_at"),
}

# One disclosed line as every document parser returns it.
PARSED_LINE = _struct(
    ("source_id", S, True), ("owner", S, True), ("asset_name", S, True), ("ticker", S, True),
    ("asset_type_code", S, True), ("txn_type", S, True), ("txn_date", D, True),
    ("notification_date", D, True), ("amount_min", L, True), ("amount_max", L, True),
    ("amount_raw", S, True), ("notes", S, True), ("filing_status", S, True),
)

HOUSE_INDEX_ROW = _struct(*[(tag, S, True) for tag in (
    "Prefix", "Last", "First", "Suffix", "FilingType", "StateDst", "Year", "FilingDate", "DocID")])

SENATE_LISTING = _struct(
    ("draw", L, True), ("recordsTotal", L, True), ("recordsFiltered", L, True),
    ("data", T.ArrayType(T.ArrayType(S)), True), ("_corrupt_record", S, True),
)

SENATOR_ROW = _struct(("last_name", S, True), ("first_name", S, True), ("state", S, True))

HOUSE_TERM = _struct(("start", S, True), ("end", S, True), ("district", L, True))
SENATE_TERM = _struct(("start", S, True), ("end", S, True))


def roster_snapshot(term: T.StructType) -> T.StructType:
    member = _struct(
        ("bioguide_id", S, True), ("last_name", S, True), ("first_name", S, True),
        ("given_name", S, True), ("last_name_alt", S, True),
        ("last_name_alts", T.ArrayType(S), True), ("state", S, True), ("party", S, True),
        ("terms", T.ArrayType(term), True),
    )
    return _struct(("source", S, True), ("coverage_start", S, True),
                   ("members", T.ArrayType(member), True), ("_corrupt_record", S, True))


RAW_TERM = _struct(("type", S, True), ("start", S, True), ("end", S, True),
                   ("district", L, True), ("state", S, True), ("party", S, True))
RAW_RECORD = _struct(
    ("id", _struct(("bioguide", S, True)), True),
    ("name", _struct(("first", S, True), ("middle", S, True), ("last", S, True),
                     ("suffix", S, True), ("official_full", S, True)), True),
    ("terms", T.ArrayType(RAW_TERM), True),
    ("_corrupt_record", S, True),
)

WORDS = _struct(("doc_id", S, False), ("page", I, False), ("text", S, False),
                ("x0", T.DoubleType(), False), ("top", T.DoubleType(), False))
