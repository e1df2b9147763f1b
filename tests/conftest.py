import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from disclosight import schema  # noqa: E402
from disclosight.session import build_session  # noqa: E402
from disclosight.operators.store import fit  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = dt.date(2024, 3, 1)
PEOPLE = {"A": ("Ann", "Alpha", "CA01"), "B": ("Bob", "Beta", "NY02"), "C": ("Cid", "Gamma", "TX03"),
          "D": ("Dee", "Delta", "FL04")}


@pytest.fixture(scope="session")
def make_tables(spark):
    """Small filings and transactions: one filing per line, given as dicts of overrides."""

    def build(lines):
        filings, transactions = [], []
        for number, line in enumerate(lines, start=1):
            first, last, district = PEOPLE[line.get("person", "A")]
            when = line.get("txn_date", BASE)
            filings.append({
                "id": number, "doc_id": line.get("doc_id", f"{number:08d}"), "year": 2024, "first_name": first,
                "last_name": last, "state_district": district, "filing_date": line.get("filing_date", dt.date(2024, 12, 1)),
                "doc_kind": "efiled", "pdf_url": "u", "source": "house_clerk",
                "amends_filing_id": line.get("amends_filing_id"), "amendment_method": line.get("amendment_method"),
                "amendment_confidence": line.get("amendment_confidence")})
            transactions.append({
                "id": number * 10, "filing_id": number, "sequence": 0, "asset_name": line.get("asset_name", "Asset"),
                "ticker": line.get("ticker", "TICK"), "txn_type": line.get("txn_type", "P"), "txn_date": when,
                "notification_date": line.get("notification_date", when), "amount_min": line.get("amount_min", 1001),
                "amount_max": line.get("amount_max", 15000), "amount_raw": "$", "quality_flags": line.get("quality_flags", []),
                "filing_status": line.get("filing_status")})
        short = lambda target, rows: spark.createDataFrame(
            rows, type(target)([f for f in target.fields if f.name in rows[0]]))
        return fit(short(schema.FILINGS, filings), schema.FILINGS), fit(short(schema.TRANSACTIONS, transactions), schema.TRANSACTIONS)

    return build
