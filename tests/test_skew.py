"""A ticker with a third of all trades, against a plain Python count."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from conftest import BASE
from pyspark.sql import functions as F

from disclosight.operators import bursts, joins
from disclosight.plans import browse, signals


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(7)
    return [{"ticker": "HOT" if rng.random() < 0.34 else f"T{rng.randrange(12)}", "person": rng.choice("ABCD"),
             "txn_date": BASE + dt.timedelta(days=rng.randrange(400)), "amount_min": rng.randrange(1, 99),
             "amount_max": rng.choice([None, 100, 200, 300, 400]), "asset_name": rng.choice(["x", "y", "z"])} for _ in range(500)]


def expected(lines, gap, span, least):
    found = {}
    by_ticker = defaultdict(list)
    for line in lines:
        by_ticker[line["ticker"]].append(line)
    for ticker, rows in by_ticker.items():
        rows.sort(key=lambda r: r["txn_date"])
        groups = [[rows[0]]]
        for before, row in zip(rows, rows[1:]):
            if (row["txn_date"] - before["txn_date"]).days > gap:
                groups.append([])
            groups[-1].append(row)
        for group in groups:
            days = (group[-1]["txn_date"] - group[0]["txn_date"]).days
            people = {r["person"] for r in group}
            if len(people) >= least and days <= span:
                highs = [r["amount_max"] for r in group]
                names = Counter(r["asset_name"] for r in group)
                best = min(names, key=lambda n: (-names[n], n))
                found[ticker, group[0]["txn_date"]] = (len(group), len(people), sum(r["amount_min"] for r in group),
                                                       None if None in highs else sum(highs), best, days)
    return found


@pytest.mark.parametrize("gap, span", [(7, 14), (3, 10), (2, 400)])
def test_clusters_match_a_plain_count(make_tables, lines, gap, span):
    filings, transactions = make_tables(lines)
    rule = signals.ClusterRule("buy_cluster", "Buy", "P", "bc_", "", (), max_gap_days=gap, max_span_days=span)
    rows = signals.clusters(transactions, filings, "2030-01-01", (rule,)).collect()
    got = {(r["ticker"], r["start_date"]): (r["transaction_count"], r["politician_count"], r["total_min"], r["total_max"],
                                            r["asset_name"], r["span_days"]) for r in rows}
    assert got == expected(lines, gap, span, 3) and got


def test_windows_see_one_row_per_day(make_tables, lines):
    _, transactions = make_tables(lines)
    days = bursts.trading_days(transactions)
    assert days.groupBy("txn_type", "ticker", "txn_date").count().filter("count > 1").count() == 0
    assert days.filter("ticker = 'HOT'").count() < transactions.filter("ticker = 'HOT'").count()


def test_lines_without_evidence_are_not_moved(spark):
    """The flag of whole tables is that of one page, and only lines that cite a document meet the documents."""
    rows = [(1, "7", "a"), (2, None, "b"), (2, None, "b"), (3, " ", "c"), (4, "unknown", "d"), (None, "7", "e"), (None, None, None), (1, "7", "a")]
    t = spark.createDataFrame(rows, "id long, verification_source_doc_id string, asset_name string")
    f = spark.createDataFrame([(70, "7"), (71, "7"), (72, None), (73, "9")], "id long, doc_id string")
    want = joins.with_evidence_flag(t, f)
    got = joins.with_evidence_flags(t, f)
    assert got.columns == want.columns
    key = lambda row: tuple(map(str, row))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    moved = got._jdf.queryExecution().optimizedPlan().toString()
    branch = moved[moved.rindex("isnull(verification_source_doc_id"):]
    assert "Join" not in branch


def test_filing_detail_moves_lines_once(make_tables):
    """Lines of a whole table that cite nothing are joined with filings only."""
    f, t = make_tables([{}, {"person": "B", "ticker": None}, {"person": "C", "ticker": "00000001", "amends_filing_id": 1}])
    t = t.withColumn("verification_source_doc_id", F.col("ticker"))
    lines = browse.filing_detail(f, t, f.select("doc_id")).lines
    assert sorted((r["doc_id"], r["verification_source_doc_exists"]) for r in lines.collect()) == [("00000001", False), ("00000002", False), ("00000003", True)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    plain = plan[plan.rindex("Project [", 0, plan.rindex("isnull(ticker")):]
    assert "_present" in plan and "_present" not in plain
