import datetime as dt
from dataclasses import replace

import pytest
from conftest import BASE

from disclosight.operators import order_index, ordering
from disclosight.plans import signals

AS_OF = dt.date(2024, 9, 1)


def burst(ticker, *steps, **extra):
    return [{"ticker": ticker, "person": who, "txn_date": BASE + dt.timedelta(days=day), **extra} for day, who in steps]


SEED = [
    *burst("ALPHA", (0, "A"), (2, "B"), (4, "C")),
    *burst("TWO", (0, "A"), (0, "B")),
    *burst("GAPS", (0, "A"), (7, "B"), (14, "C")),
    *burst("GAPE", (0, "A"), (8, "B"), (16, "C")),
    *burst("LONG", (0, "A"), (7, "B"), (14, "C"), (21, "D")),
    *burst("REPT", (0, "A"), (1, "A"), (2, "A"), (1, "B"), (2, "C")),
    *burst("--", (0, "A"), (0, "B"), (0, "C")),
    *burst("lower", (0, "A"), (0, "B"), (0, "C")),
    *burst("LINE\n", (0, "A"), (0, "B"), (0, "C")),
    *burst("SELL", (0, "A"), (0, "B"), (0, "C"), txn_type="S"),
    *burst("PART", (0, "A"), (0, "B"), (0, "C"), txn_type="S (partial)"),
    *burst("EXCH", (0, "A"), (0, "B"), (0, "C"), txn_type="E"),
    *burst("FUTR", (300, "A"), (300, "B"), (300, "C")),
    *burst("OPEN", (0, "A"), (0, "B"), amount_min=100, amount_max=200),
    *burst("OPEN", (1, "C"), amount_min=50, amount_max=None),
    *burst("NAME", (0, "A"), (0, "B"), asset_name="Zeta"), *burst("NAME", (0, "C"), (0, "D"), asset_name="Eta"),
]


@pytest.fixture(scope="module")
def seed(make_tables):
    filings, transactions = make_tables(SEED)
    return transactions.cache(), filings.cache()


def found(seed, rules=(signals.BUY,), **kw):
    return {r["ticker"]: r for r in signals.clusters(*seed, AS_OF, rules, **kw).collect()}


def test_buy_rule_edges(seed):
    rows = found(seed)
    assert set(rows) == {"ALPHA", "GAPS", "REPT", "OPEN", "NAME"}
    assert rows["ALPHA"]["span_days"] == 4 and rows["GAPS"]["span_days"] == 14
    assert (rows["REPT"]["politician_count"], rows["REPT"]["transaction_count"]) == (3, 5)
    assert rows["ALPHA"]["id"] == "bc_alpha_2024-03-01"


def test_open_ended_total_and_name_tie(seed):
    rows = found(seed)
    assert (rows["OPEN"]["total_min"], rows["OPEN"]["total_max"]) == (250, None)
    assert rows["ALPHA"]["total_max"] == 45000
    assert rows["NAME"]["asset_name"] == "Eta"


def test_sell_rule_leaves_partial_sales_out(seed):
    assert set(found(seed, (signals.SELL,))) == {"SELL"}
    assert {r["type"] for r in found(seed, (signals.BUY, signals.SELL)).values()} == {"buy_cluster", "sell_cluster"}


def test_filters_never_change_ids(seed, spark):
    assert set(found(seed, start="2024-03-15")) == {"GAPS"}
    assert found(seed, start="2024-03-15")["GAPS"]["id"] == found(seed)["GAPS"]["id"]
    who = spark.createDataFrame([("FL04", "DEE", "delta")], "state_district string, first_name string, last_name string")
    assert set(found(seed, politicians=who)) == {"NAME"}
    assert set(found(seed, span_days_max=4)) == {"ALPHA", "REPT", "OPEN", "NAME"}
    with pytest.raises(ValueError):
        found(seed, start="2024-05-01", end="2024-04-01")


def test_detail_people_and_evidence(seed, spark):
    ids = spark.createDataFrame([("bc_OPEN_2024-03-01",), ("sc_SELL_2024-03-01",), ("nonsense",), ("bc_OPEN_2024-03-02",)], "signal_id string")
    summary, people, trades = signals.cluster_detail(*seed, ids, AS_OF)
    assert {r["id"] for r in summary.collect()} == {"bc_open_2024-03-01", "sc_sell_2024-03-01"}
    order = [(r["name"], r["amount_max"]) for r in people.filter("signal_id like 'bc%'").orderBy(*signals.people_order()).collect()]
    assert order == [("Ann Alpha", 200), ("Bob Beta", 200), ("Cid Gamma", None)]
    assert [r["politician_id"] for r in trades.filter("signal_id like 'bc%'").orderBy(*signals.evidence_order()).collect()][-1] == "tx03_cid_gamma"


def test_long_burst_is_rejected_whole_but_kept_by_a_wider_rule(seed):
    assert "LONG" in found(seed, (replace(signals.BUY, max_span_days=21),))


def test_highlights_use_no_older_cluster(seed):
    newest = signals.recent_clusters(*seed, AS_OF).collect()
    assert {r["txn_type"]: r["ticker"] for r in newest} == {"P": "GAPS", "S": "SELL"}
    assert signals.recent_clusters(*seed, dt.date(2025, 6, 1)).filter("ticker <> 'FUTR'").count() == 0
    text = signals.cluster_highlights(signals.recent_clusters(*seed, AS_OF)).filter("ticker = 'GAPS'").first()
    assert text["summary"] == "GAPS — 3 transactions involving 3 members"


def test_largest_trade_ranks_by_minimum(seed):
    rows = {r["txn_type"]: r for r in signals.largest_trades(*seed, AS_OF).collect()}
    assert rows["P"]["amount_min"] == 1001 and rows["P"]["ticker"] == "LONG"  # the latest of equal minimums


def test_order_and_page_rules(seed):
    table = signals.clusters(*seed, AS_OF)
    assert [r["ticker"] for r in signals.page_of_clusters(table, "total_max").collect()][-1] == "OPEN"
    assert [r["ticker"] for r in signals.page_of_clusters(table, "-total_max").collect()][-1] == "OPEN"
    assert [r["ticker"] for r in signals.page_of_clusters(table, limit=2, offset=1).collect()] == ["ALPHA", "GAPS"]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            signals.page_of_clusters(table, **bad)
    with pytest.raises(ValueError):
        ordering.signal_order("-nothing")


def test_rules_keep_their_own_thresholds(seed):
    wide_sell = replace(signals.SELL, max_gap_days=30, max_span_days=30)
    for rules in ((signals.BUY, wide_sell), (wide_sell, signals.BUY)):
        assert set(found(seed, rules)) == {"ALPHA", "GAPS", "REPT", "OPEN", "NAME", "SELL"}
    wide_buy = replace(signals.BUY, max_gap_days=30, max_span_days=30)
    assert {"GAPE", "LONG"} <= set(found(seed, (wide_buy, signals.SELL)))
    assert "ALPHA" not in found(seed, (replace(signals.BUY, min_politicians=4), signals.SELL))


def test_pages_after_a_row_follow_each_other(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5 or None, (i * 3) % 4 or None) for i in range(40)], "id long, amount_min long, amount_max long")
    for sort in ("amount_min", "-amount_min", "amount_max", "-amount_max"):
        keys, order = ordering.transaction_keys(sort), ordering.transaction_order(sort)
        want = [r["id"] for r in df.orderBy(*order).collect()]
        got, last = [], None
        while True:
            page = ordering.page(df, order, 7) if last is None else ordering.page_after(df, keys, last, 7)
            rows = page.select("id", *[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)]).collect()
            if not rows:
                break
            got += [r["id"] for r in rows]
            last = list(rows[-1])[1:]
        assert got == want


def test_deep_pages_from_an_order_index(spark):
    """A third of the rows share their leading keys, others have none; every page equals its part of the sorted table."""
    df = spark.createDataFrame([(i, 7 if i % 3 == 0 else (i * 7) % 50 or None, (i * 3) % 4 or None) for i in range(600)],
                               "id long, amount_min long, amount_max long").repartition(4)
    for sort in ("amount_min", "-amount_min", "-amount_max"):
        want = [r["id"] for r in df.orderBy(*ordering.transaction_order(sort)).collect()]
        index = order_index.build(df, ordering.transaction_keys(sort), 8)
        assert index.total == 600 and max(index.counts) < 200
        for limit, offset in ((50, 0), (50, 550), (100, 333), (1, 599), (100, 590), (10, 600), (10, 5000)):
            keys = order_index.page_keys(index, limit, offset).collect()
            assert [list(r)[-1] for r in keys] == want[offset:offset + limit]
            ranges, before = order_index.touched(index, limit, offset)
            read = sum(index.counts[i] for i in ranges)
            assert before <= offset and (offset >= 600) == (not ranges) and read <= limit + 2 * max(index.counts)
        assert {r["id"] for r in order_index.page(df, "id", index, 20, 300).collect()} == set(want[300:320])
        plan = order_index.page_keys(index, 1, 599)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "range" in plan.split("PartitionFilters")[1].split("]")[0]
    nothing = order_index.build(df.limit(0), ordering.transaction_keys("amount_min"), 4)
    assert nothing.total == 0 and order_index.page_keys(nothing, 5, 0).collect() == []
    for bad in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            order_index.page_keys(nothing, *bad)
