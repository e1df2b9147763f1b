"""Buy and sell cluster signals and the recent-activity highlights.

Signals are computed on read. The job runs in two steps so that it stays cheap on large tables:

1. Burst borders come from a narrow scan (type, ticker, date, id) that is reduced to one row
   per ticker and trading day. Bursts that are too long, or have fewer trades than the rule asks
   for people, are dropped here.
2. Only trades on the remaining days are read in full and joined with their filings, to tell
   people apart and to add amounts up.

Step 1 does not join filings: every line has a filing (the foreign key checked by
``quality.orphans``), so the join could not change a border.

Filters on clusters are applied after clustering. Filtering trades first would move borders and
give the same signal another id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import as_date, six_months_before
from ..functions.identity import full_name, person_key
from ..operators import bursts, filters, joins, ordering
from ..operators.aggregates import open_ended_sum
from ..session import working_table

PERSON = ("doc_id", "first_name", "last_name", "state_district")


@dataclass(frozen=True)
class ClusterRule:
    type: str
    label: str
    txn_type: str
    id_prefix: str
    description: str
    limitations: tuple[str, ...]
    min_politicians: int = fv.MIN_POLITICIANS
    max_gap_days: int = fv.MAX_GAP_DAYS
    max_span_days: int = fv.MAX_SPAN_DAYS
    ticker_pattern: str = fv.TICKER_PATTERN


BUY = ClusterRule("buy_cluster", "Buy cluster", "P", "bc_", fv.BUY_DESCRIPTION, (
    fv.LIMITATION_TIMING, fv.LIMITATION_BUY_DELAY, fv.LIMITATION_RANGES, fv.LIMITATION_SMALL,
    fv.LIMITATION_IDENTITY))
SELL = ClusterRule("sell_cluster", "Sell cluster", "S", "sc_", fv.SELL_DESCRIPTION, (
    fv.LIMITATION_TIMING, fv.LIMITATION_PARTIAL, fv.LIMITATION_SELL_DELAY, fv.LIMITATION_RANGES,
    fv.LIMITATION_SMALL, fv.LIMITATION_IDENTITY))
RULES = {rule.type: rule for rule in (BUY, SELL)}

BURST = [*bursts.SERIES, "burst_id"]
SPAN = [*BURST, "start_date", "end_date"]


def per_type(rules: tuple[ClusterRule, ...], value) -> Column:
    """A literal chosen by the row's transaction type."""
    out = F.when(F.col("txn_type") == rules[0].txn_type, F.lit(value(rules[0])))
    for rule in rules[1:]:
        out = out.when(F.col("txn_type") == rule.txn_type, F.lit(value(rule)))
    return out


def clustered_trades(transactions: DataFrame, rules: tuple[ClusterRule, ...], as_of) -> DataFrame:
    """Trades the rules look at: their types, equity-like tickers, nothing after ``as_of``."""
    wanted = transactions.filter(F.col("txn_type").isin(*[r.txn_type for r in rules]))
    return filters.traded_by(wanted.filter(filters.has_ticker_shape()), as_of)


def members(transactions: DataFrame, filings: DataFrame, rules: tuple[ClusterRule, ...], as_of) -> DataFrame:
    """Trades of every burst that may still qualify, with person and burst span.

    Every rule keeps its own thresholds. Who reads the rows more than once should store them first
    (``member_table``).
    """
    trades = clustered_trades(transactions, rules, as_of)
    numbered = bursts.number_bursts(bursts.trading_days(trades), per_type(rules, lambda r: r.max_gap_days))
    days = bursts.qualifying_days(numbered, per_type(rules, lambda r: r.max_span_days), per_type(rules, lambda r: r.min_politicians))
    in_burst = trades.join(days, bursts.DAY)
    return joins.lines(in_burst, filings, PERSON).withColumn(
        "person_key", person_key(F.col("state_district"), F.col("first_name"), F.col("last_name")))


def member_table(transactions: DataFrame, filings: DataFrame, rules: tuple[ClusterRule, ...], as_of) -> DataFrame:
    """``members`` as a working table: the lines are read twice in all, for days and for trades, whatever follows."""
    return working_table(members(transactions, filings, rules, as_of), "cluster-members")


def cluster_table(member_rows: DataFrame, rules: tuple[ClusterRule, ...]) -> DataFrame:
    """One row per qualifying burst.

    Every trade counts once under its person and once under its asset name; both are combined on
    the map side in one pass. People, totals and the most common name then follow from those
    counts, so neither a set nor a second look at the trades is needed.
    """
    facets = F.array(F.struct(F.lit("person").alias("facet"), F.col("person_key").alias("value")),
                     F.struct(F.lit("asset").alias("facet"), F.col("asset_name").alias("value")))
    counted = (member_rows.select(*SPAN, "amount_min", "amount_max", F.inline(facets))
               .groupBy(*SPAN, "facet", "value").agg(
                   F.count(F.lit(1)).alias("n"), F.sum("amount_min").alias("low"),
                   F.sum("amount_max").alias("high"), F.count_if(F.col("amount_max").isNull()).alias("open")))
    person, asset = F.col("facet") == "person", (F.col("facet") == "asset") & F.col("value").isNotNull()
    of_people = lambda c: F.sum(F.when(person, F.col(c)))
    totals = counted.groupBy(*SPAN).agg(
        of_people("n").alias("transaction_count"), F.count_if(person).alias("politician_count"),
        of_people("low").alias("total_min"), F.when(of_people("open") == 0, of_people("high")).alias("total_max"),
        # most frequent name, the smallest on ties
        F.min(F.when(asset, F.struct((-F.col("n")).alias("n"), "value"))).alias("_name"))
    enough = totals.filter(F.col("politician_count") >= per_type(rules, lambda r: r.min_politicians))
    signal_id = F.concat(per_type(rules, lambda r: r.id_prefix), F.lower("ticker"), F.lit("_"),
                         F.date_format("start_date", "yyyy-MM-dd"))
    return (enough.withColumn("asset_name", F.col("_name.value")).drop("_name")
            .withColumn("id", signal_id).withColumn("type", per_type(rules, lambda r: r.type))
            .withColumn("label", per_type(rules, lambda r: r.label))
            .withColumn("span_days", F.datediff("end_date", "start_date")))


SUMMARY = ["id", "type", "label", "ticker", "asset_name", "transaction_count", "politician_count",
           "start_date", "end_date", "span_days", "total_min", "total_max"]


def clusters(transactions: DataFrame, filings: DataFrame, as_of, rules: tuple[ClusterRule, ...] = (BUY,),
             ticker: str | None = None, politicians: DataFrame | None = None,
             span_days_max: int | None = None, start=None, end=None) -> DataFrame:
    """Cluster summaries, narrowed by the optional filters.

    ``politicians(state_district, first_name, last_name)`` keeps clusters with a trade by any of them.
    """
    # a ticker's bursts depend on its own trades only, so the others need not be clustered
    transactions = filters.ticker_is(transactions, ticker.strip() if ticker and ticker.strip() else None)
    find = members if politicians is None else member_table
    return clusters_of(find(transactions, filings, rules, as_of), rules, ticker, politicians, span_days_max, start, end)


def clusters_of(member_rows: DataFrame, rules: tuple[ClusterRule, ...], ticker: str | None = None,
                politicians: DataFrame | None = None, span_days_max: int | None = None, start=None, end=None) -> DataFrame:
    """The same from member rows."""
    table = cluster_table(member_rows, rules)
    if politicians is not None:
        named = filters.of_politicians(member_rows, politicians).select(*BURST)
        table = table.join(named, BURST, "left_semi")
    table = filters.ticker_is(table, ticker.strip() if ticker and ticker.strip() else None)
    table = filters.span_at_most(table, span_days_max)
    return filters.clusters_touching(table, start, end).select(*BURST, *[c for c in SUMMARY if c not in BURST])


def people_of(member_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per cluster of ``found`` one row per person, in no order (``people_order`` lists the largest upper bound first).

    Rows rather than a nested list, so that no cluster has to fit in one record.
    """
    rows = member_rows.join(found.select(*BURST, F.col("id").alias("signal_id")), BURST)
    return (rows.groupBy("signal_id", "person_key").agg(
        F.min("first_name").alias("first_name"), F.min("last_name").alias("last_name"),
        F.min("state_district").alias("state_district"),
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount_min").alias("amount_min"),
        open_ended_sum(F.col("amount_max")).alias("amount_max"))
        .select("signal_id", F.col("person_key").alias("id"),
                F.concat_ws(" ", "first_name", "last_name").alias("name"), "state_district",
                "transaction_count", "amount_min", "amount_max"))


def people_order() -> list[Column]:
    return [F.col("signal_id").asc(), F.col("amount_max").desc_nulls_last(), F.col("id").asc()]


def evidence_of(member_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The trades behind every cluster of ``found``, in no order (``evidence_order`` gives theirs)."""
    rows = member_rows.join(found.select(*BURST, F.col("id").alias("signal_id")), BURST)
    return rows.select(
        "signal_id", "id", "filing_id", "doc_id", F.col("person_key").alias("politician_id"),
        full_name(F.col("first_name"), F.col("last_name")).alias("politician_name"), "sequence",
        "txn_type", "txn_date", "notification_date", "amount_min", "amount_max", "amount_raw",
        F.col("owner_token").alias("owner"), "asset_name", "ticker", "asset_type_code")


def evidence_order() -> list[Column]:
    return [F.col(c).asc() for c in ("signal_id", "txn_date", "id")]


SIGNAL_ID = r"^(bc|sc)_([A-Za-z0-9.\-]{1,6})_([0-9]{4}-[0-9]{2}-[0-9]{2})\z"


def parse_signal_ids(ids: DataFrame) -> DataFrame:
    """``signal_id`` into type, ticker and start date; NULLs for an unknown form."""
    part = lambda i: F.nullif(F.regexp_extract("signal_id", SIGNAL_ID, i), F.lit(""))
    prefix = part(1)
    return ids.select(
        *ids.columns,
        F.when(prefix == "bc", BUY.type).when(prefix == "sc", SELL.type).alias("type"),
        part(2).alias("ticker"), F.try_to_date(part(3), "yyyy-MM-dd").alias("start_date"))


def cluster_detail(transactions: DataFrame, filings: DataFrame, ids: DataFrame, as_of,
                   rules: tuple[ClusterRule, ...] = (BUY, SELL)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, people and trades of the signals named in ``ids(signal_id)``.

    Only trades of the named tickers are clustered.
    """
    wanted = (parse_signal_ids(ids.select("signal_id").distinct())
              .select("type", F.lower("ticker").alias("_ticker"), "start_date").distinct())
    tickers = wanted.select("_ticker").distinct()
    named = transactions.join(tickers, F.lower(transactions["ticker"]) == tickers["_ticker"], "left_semi")
    rows = member_table(named, filings, rules, as_of)
    table = clusters_of(rows, rules).withColumn("_ticker", F.lower("ticker"))
    found = working_table(table.join(wanted, ["type", "_ticker", "start_date"], "left_semi").drop("_ticker"), "clusters")
    return found, people_of(rows, found), evidence_of(rows, found)


def page_of_clusters(found: DataFrame, sort: str | None = "-politician_count", limit: int = 50,
                     offset: int = 0) -> DataFrame:
    return ordering.page(found, ordering.signal_order(sort), limit, offset)


def with_rule(found: DataFrame, rules: tuple[ClusterRule, ...] = (BUY, SELL)) -> DataFrame:
    """Attach the rule that produced a signal and its limitations."""
    def block(rule: ClusterRule) -> Column:
        return F.struct(
            F.lit(rule.type).alias("type"), F.lit(rule.label).alias("label"),
            F.lit(rule.txn_type).alias("txn_type"),
            F.lit(rule.min_politicians).alias("min_politicians"),
            F.lit(rule.max_gap_days).alias("max_gap_days"),
            F.lit(rule.max_span_days).alias("max_span_days"),
            F.lit(rule.ticker_pattern).alias("ticker_pattern"),
            F.lit(True).alias("excludes_future_dates"), F.lit(False).alias("materialized"),
            F.lit(rule.description).alias("description"))

    rule_col, caveats = F.when(F.lit(False), block(rules[0])), F.when(F.lit(False), F.array(F.lit("")))
    for rule in rules:
        rule_col = rule_col.when(F.col("type") == rule.type, block(rule))
        caveats = caveats.when(F.col("type") == rule.type, F.array(*[F.lit(x) for x in rule.limitations]))
    return found.withColumn("rule", rule_col).withColumn("limitations", caveats)


# --- highlights --------------------------------------------------------------

def recent_clusters(transactions: DataFrame, filings: DataFrame, as_of,
                    rules: tuple[ClusterRule, ...] = (BUY, SELL)) -> DataFrame:
    """The newest cluster of each type lying wholly in the last six months.

    Clusters are computed over the complete history before the window is applied.
    """
    day = as_date(as_of)
    table = clusters(transactions, filings, as_of, rules)
    inside = filters.clusters_within(table, six_months_before(day), day)
    newest = Window.partitionBy("txn_type").orderBy(
        F.col("end_date").desc(), F.col("start_date").desc(), F.col("ticker").asc())
    return inside.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def cluster_highlights(newest: DataFrame, rules: tuple[ClusterRule, ...] = (BUY, SELL)) -> DataFrame:
    """Display text of the newest clusters."""
    reason = per_type(rules, lambda r: fv.CLUSTER_REASON.format(
        people=r.min_politicians, noun="purchases" if r.txn_type == "P" else "sales", gap=r.max_gap_days, span=r.max_span_days))
    summary = F.format_string(fv.CLUSTER_SUMMARY, F.col("ticker"), F.col("transaction_count"), F.col("politician_count"))
    return newest.select(
        "type", F.col("label").alias("title"), summary.alias("summary"), reason.alias("reason"),
        F.col("start_date").alias("date_start"), F.col("end_date").alias("date_end"),
        F.col("id").alias("signal_id"), "ticker", "transaction_count", "politician_count",
        F.concat(F.lit("/signals/"), "id").alias("detail_url"))


def largest_trades(transactions: DataFrame, filings: DataFrame, as_of) -> DataFrame:
    """The purchase and the sale with the highest disclosed minimum of the last six months.

    Ranking comes before the join (every line has a filing), so two rows reach it.
    """
    day = as_date(as_of)
    recent = transactions.filter(
        F.col("txn_type").isin("P", "S") & (F.col("txn_date") >= six_months_before(day))
        & (F.col("txn_date") <= day))
    by_size = Window.partitionBy("txn_type").orderBy(
        F.col("amount_min").desc(), F.col("txn_date").desc(), F.col("id").asc())
    top = recent.withColumn("_rank", F.row_number().over(by_size)).filter("_rank = 1").drop("_rank")
    # two rows at most: one per transaction type
    docs = filings.select(F.col("id").alias("filing_id"), *PERSON)
    return F.broadcast(top).join(docs, "filing_id")


def largest_trade_highlights(top: DataFrame) -> DataFrame:
    purchase = F.col("txn_type") == "P"
    word = F.when(purchase, "Purchase").otherwise("Sale")
    return top.select(
        F.concat(F.lit("largest_disclosed_"), F.lower(word)).alias("type"),
        F.when(purchase, fv.LARGEST_TITLE.format("Purchase")).otherwise(fv.LARGEST_TITLE.format("Sale")).alias("title"),
        "ticker",
        person_key(F.col("state_district"), F.col("first_name"), F.col("last_name")).alias("politician_id"),
        full_name(F.col("first_name"), F.col("last_name")).alias("politician_name"),
        "txn_date", "amount_min", "amount_max", "amount_raw", F.lit(fv.LARGEST_REASON).alias("reason"),
        F.col("id").alias("transaction_id"), "filing_id", "doc_id",
        F.concat(F.lit("/filings/"), "doc_id").alias("detail_url"))
