"""Windows, cluster aggregates, signals and highlights."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..functions.dates import six_months_before
from ..functions.identity import person_key
from ..operators import aggregates, bursts, filters, joins, ordering
from ..plans import signals
from ..session import working_table
from .adapters import AS_OF, filings, transactions
from .registry import query

FT = ("filings", "transactions")
WIDE = tuple(replace(r, max_gap_days=30, max_span_days=30) for r in (signals.BUY, signals.SELL))
BOTH = (signals.BUY, signals.SELL)
TICKER_OK = "regexp_full_match(ticker, '[A-Z][A-Z0-9.\\-]{0,5}')"


def sql_key(alias: str = "") -> str:
    part = lambda c: f"regexp_replace(lower(trim({alias}{c})), '[\\s_]+', '_', 'g')"
    return " || '_' || ".join(part(c) for c in ("state_district", "first_name", "last_name"))


def burst_sql(gap: int, types: str = "'P','S'") -> str:
    """CTEs up to ``numbered``: every clustered trade with its burst."""
    return f"""with looked_at as (
      select t.*, f.doc_id, f.first_name, f.last_name, f.state_district, {sql_key('f.')} as person_key
      from transactions t join filings f on f.id = t.filing_id
      where t.txn_type in ({types}) and {TICKER_OK} and t.txn_date <= date '{AS_OF}'),
    with_prev as (
      select *, lag(txn_date) over (partition by txn_type, ticker order by txn_date, id) as prev_date from looked_at),
    numbered as (
      select *, sum(case when prev_date is null or date_diff('day', prev_date, txn_date) > {gap} then 1 else 0 end)
        over (partition by txn_type, ticker order by txn_date, id rows unbounded preceding) as burst_id
      from with_prev)"""


def cluster_sql(gap: int = 7, span: int = 14, types: str = "'P','S'") -> str:
    """CTEs up to ``clusters``."""
    return burst_sql(gap, types) + f""",
    name_counts as (
      select txn_type, ticker, burst_id, asset_name, count(*) as n from numbered group by all),
    top_names as (
      select txn_type, ticker, burst_id, asset_name from name_counts
      qualify row_number() over (partition by txn_type, ticker, burst_id order by n desc, asset_name) = 1),
    sums as (
      select txn_type, ticker, burst_id, min(txn_date) as start_date, max(txn_date) as end_date,
        cast(date_diff('day', min(txn_date), max(txn_date)) as int) as span_days,
        cast(count(*) as bigint) as transaction_count, cast(count(distinct person_key) as bigint) as politician_count,
        cast(sum(amount_min) as bigint) as total_min,
        cast(case when count(*) = count(amount_max) then sum(amount_max) end as bigint) as total_max
      from numbered group by all having count(distinct person_key) >= 3),
    clusters as (
      select s.*, n.asset_name, case s.txn_type when 'P' then 'bc_' else 'sc_' end || lower(s.ticker) || '_'
          || strftime(start_date, '%Y-%m-%d') as id,
        case s.txn_type when 'P' then 'buy_cluster' else 'sell_cluster' end as type,
        case s.txn_type when 'P' then 'Buy cluster' else 'Sell cluster' end as label
      from sums s join top_names n using (txn_type, ticker, burst_id) where span_days <= {span})"""


SUMMARY = signals.SUMMARY
SUMMARY_SQL = ", ".join(SUMMARY)


def tf(spark, d, assets=True):
    return transactions(spark, d, assets), filings(spark, d)


@query("w1_prev_date", burst_sql(7) + " select id, ticker, txn_type, txn_date, prev_date from numbered", FT)
def w1(spark, d):
    t, f = tf(spark, d, assets=False)
    trades = signals.clustered_trades(t, BOTH, AS_OF)
    return bursts.previous_trade(trades, 7).select("id", "ticker", "txn_type", "txn_date", "prev_date")


@query("w2_burst_id", burst_sql(30) + " select id, ticker, txn_type, cast(burst_id as bigint) as burst_id from numbered", FT)
def w2(spark, d):
    t, f = tf(spark, d, assets=False)
    trades = signals.clustered_trades(t, WIDE, AS_OF)
    return bursts.previous_trade(trades, 30).select("id", "ticker", "txn_type", "burst_id")


@query("w2_burst_spans", burst_sql(7) + """ select txn_type, ticker, cast(burst_id as bigint) as burst_id,
    min(txn_date) as start_date, max(txn_date) as end_date, cast(count(*) as bigint) as transaction_count
    from numbered group by all""", FT)
def w2_spans(spark, d):
    days = bursts.trading_days(signals.clustered_trades(transactions(spark, d), BOTH, AS_OF))
    return bursts.burst_spans(bursts.number_bursts(days, 7)).drop("span_days")


@query("a5_cluster_aggregate", cluster_sql(30, 30) + f" select {SUMMARY_SQL} from clusters", FT)
def a5(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, WIDE).select(*SUMMARY)


PEOPLE_SQL = """
    select c.id as signal_id, n.person_key as id, concat_ws(' ', min(n.first_name), min(n.last_name)) as name,
      min(n.state_district) as state_district, cast(count(*) as bigint) as transaction_count,
      cast(sum(n.amount_min) as bigint) as amount_min,
      cast(case when count(*) = count(n.amount_max) then sum(n.amount_max) end as bigint) as amount_max
    from clusters c join numbered n using (txn_type, ticker, burst_id) group by c.id, n.person_key"""
EVIDENCE_SQL = """
    select c.id as signal_id, n.id, n.filing_id, n.doc_id, n.person_key as politician_id,
      trim(n.first_name || ' ' || n.last_name) as politician_name, n.sequence, n.txn_type, n.txn_date,
      n.notification_date, n.amount_min, n.amount_max, n.amount_raw, n.owner_token as owner, n.asset_name,
      n.ticker, n.asset_type_code
    from clusters c join numbered n using (txn_type, ticker, burst_id)"""


@query("a6_cluster_people", cluster_sql(30, 30) + PEOPLE_SQL, FT)
def a6(spark, d):
    rows = signals.member_table(*tf(spark, d), WIDE, AS_OF)
    return signals.people_of(rows, signals.clusters_of(rows, WIDE))


@query("j9_leading_person", cluster_sql(30, 30) + """,
    per as (select c.id as signal_id, n.person_key, cast(case when count(*) = count(n.amount_max) then sum(n.amount_max) end as bigint) as amount_max
      from clusters c join numbered n using (txn_type, ticker, burst_id) group by c.id, n.person_key)
    select signal_id, person_key as leading, amount_max from per
    qualify row_number() over (partition by signal_id order by amount_max desc nulls last, person_key) = 1""", FT)
def j9(spark, d):
    """The first person in list order of every cluster, as a minimum that combines on the map side."""
    members = signals.member_table(*tf(spark, d), WIDE, AS_OF)
    rows = signals.people_of(members, signals.clusters_of(members, WIDE))
    place = F.struct(F.col("amount_max").isNull().alias("open"), (-F.col("amount_max")).alias("size"), F.col("id").alias("id"))
    return rows.groupBy("signal_id").agg(F.min(place).alias("p")).select(
        "signal_id", F.col("p.id").alias("leading"), (-F.col("p.size")).alias("amount_max"))


@query("a7_most_common_asset", """with counted as (
      select ticker, asset_name, count(*) as n from transactions where ticker is not null group by all)
    select ticker, asset_name from counted
    qualify row_number() over (partition by ticker order by n desc, asset_name) = 1""", ("transactions",))
def a7(spark, d):
    t = transactions(spark, d, True).filter("ticker is not null")
    return aggregates.most_common(t, ["ticker"], "asset_name")


@query("a4_open_ended_sum", """select txn_type, ticker, cast(sum(amount_min) as bigint) as total_min,
    cast(case when count(*) = count(amount_max) then sum(amount_max) end as bigint) as total_max
    from transactions group by all""", ("transactions",))
def a4(spark, d):
    return transactions(spark, d).groupBy("txn_type", "ticker").agg(
        F.sum("amount_min").alias("total_min"), aggregates.open_ended_sum(F.col("amount_max")).alias("total_max"))


@query("w3_newest_cluster", cluster_sql(30, 30) + f"""
    select {SUMMARY_SQL} from clusters
    where start_date >= date '1999-12-30' and end_date <= date '{AS_OF}'
    qualify row_number() over (partition by txn_type order by end_date desc, start_date desc, ticker) = 1""", FT)
def w3(spark, d):
    return signals.recent_clusters(*tf(spark, d), AS_OF, WIDE).select(*SUMMARY)


LARGEST_SQL = f"""with ranked as (
      select t.*, f.doc_id, f.first_name, f.last_name, f.state_district, row_number() over (
        partition by txn_type order by amount_min desc, txn_date desc, t.id) as rn
      from transactions t join filings f on f.id = t.filing_id
      where txn_type in ('P', 'S') and txn_date between date '1999-12-30' and date '{AS_OF}')"""


@query("w4_largest_trades", LARGEST_SQL + """ select id, filing_id, doc_id, txn_type, txn_date, amount_min,
    amount_max from ranked where rn = 1""", FT)
def w4(spark, d):
    t, f = tf(spark, d, assets=False)
    return signals.largest_trades(t, f, AS_OF).select(
        "id", "filing_id", "doc_id", "txn_type", "txn_date", "amount_min", "amount_max")


@query("c1_buy_clusters", cluster_sql(types="'P'") + f" select {SUMMARY_SQL} from clusters", FT)
def c1_buy(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, (signals.BUY,)).select(*SUMMARY)


@query("c1_sell_clusters", cluster_sql(types="'S'") + f" select {SUMMARY_SQL} from clusters", FT)
def c1_sell(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, (signals.SELL,)).select(*SUMMARY)


@query("c1_wide_clusters_page", cluster_sql(30, 30) + f""" select {SUMMARY_SQL} from clusters
    order by politician_count desc, ticker, start_date, type limit 50""", FT)
def c1_page(spark, d):
    found = signals.clusters(*tf(spark, d), AS_OF, WIDE)
    order = [*ordering.signal_order("-politician_count"), F.col("type").asc()]
    return ordering.page(found, order, 50).select(*SUMMARY)


@query("c1_mixed_clusters", cluster_sql(types="'P'") + f", buys as (select {SUMMARY_SQL} from clusters) select * from buys union all "
       f"select * from ({cluster_sql(30, 30, types="'S'")} select {SUMMARY_SQL} from clusters)", FT)
def c1_mixed(spark, d):
    """Each rule keeps its own thresholds: buys 7 and 14 days, sales 30 and 30."""
    return signals.clusters(*tf(spark, d), AS_OF, (signals.BUY, WIDE[1])).select(*SUMMARY)


def detail(spark, d):
    """Details of all clusters, asked for as a caller may hold their ids: tickers in upper case, beside ids of an unknown form."""
    t, f = tf(spark, d)
    known = signals.clusters(t, f, AS_OF, WIDE)
    ids = known.select(F.concat(F.substring("id", 1, 3), F.upper(F.expr("substring(id, 4)"))).alias("signal_id"))
    ids = ids.unionByName(known.select(F.concat(F.lit("xx_"), "id").alias("signal_id")))
    return signals.cluster_detail(t, f, ids, AS_OF, WIDE)


@query("c2_cluster_detail", cluster_sql(30, 30) + f" select {SUMMARY_SQL} from clusters", FT)
def c2_detail(spark, d):
    return detail(spark, d)[0].select(*SUMMARY)


@query("c2_detail_people", cluster_sql(30, 30) + PEOPLE_SQL, FT)
def c2_people(spark, d):
    return detail(spark, d)[1]


@query("c2_detail_trades", cluster_sql(30, 30) + EVIDENCE_SQL, FT)
def c2_trades(spark, d):
    return detail(spark, d)[2]


@query("j8_cluster_evidence", cluster_sql(30, 30) + EVIDENCE_SQL, FT)
def j8(spark, d):
    rows = signals.member_table(*tf(spark, d), WIDE, AS_OF)
    return signals.evidence_of(rows, signals.clusters_of(rows, WIDE))


@query("j7_clusters_of_politicians", cluster_sql(30, 30) + f""" select {SUMMARY_SQL} from clusters c
    where exists (select 1 from numbered n join customer p on n.last_name = p.c_name
      where n.txn_type = c.txn_type and n.ticker = c.ticker and n.burst_id = c.burst_id and p.c_acctbal < 0)""", FT)
def j7(spark, d):
    from .adapters import table
    t, f = tf(spark, d)
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("last_name"))
    who = f.join(poor, "last_name", "left_semi").select("state_district", "first_name", "last_name").distinct()
    return signals.clusters(t, f, AS_OF, WIDE, politicians=who).select(*SUMMARY)


@query("f14_cluster_overlap", cluster_sql(30, 30) + f""" select {SUMMARY_SQL} from clusters
    where end_date >= date '1997-01-15' and start_date <= date '1998-03-10'""", FT)
def f14(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, WIDE, start="1997-01-15", end="1998-03-10").select(*SUMMARY)


@query("f15_cluster_span", cluster_sql(30, 30) + f" select {SUMMARY_SQL} from clusters where span_days <= 20", FT)
def f15(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, WIDE, span_days_max=20).select(*SUMMARY)


@query("f16_clusters_within", cluster_sql(30, 30) + f""" select {SUMMARY_SQL} from clusters
    where start_date >= date '1999-12-30' and end_date <= date '{AS_OF}'""", FT)
def f16(spark, d):
    day = F.lit(AS_OF).cast("date")
    return filters.clusters_within(signals.clusters(*tf(spark, d), AS_OF, WIDE), six_months_before(day), day).select(*SUMMARY)


@query("f12_ticker_shape", f"""select coalesce(ticker, '') as ticker, cast(count(*) as bigint) as n from transactions
    where {TICKER_OK} group by all""", ("transactions",))
def f12(spark, d):
    return transactions(spark, d).filter(filters.has_ticker_shape()).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("f13_not_future", f"select id, txn_date from transactions where txn_date <= date '{AS_OF}'", ("transactions",))
def f13(spark, d):
    return filters.traded_by(transactions(spark, d), AS_OF).select("id", "txn_date")


def _signal_sort_sql():
    return " union all ".join(
        f"select '{sign}{key}' as sort_key, id from (select id, row_number() over (order by {'lower(ticker)' if key == 'ticker' else key} {way} nulls last, ticker, start_date, type) as pos from clusters) where pos <= 20"
        for key in sorted(ordering.SIGNAL_SORTS) for way, sign in (("asc", ""), ("desc", "-")))


@query("o4_signal_sorts", cluster_sql(30, 30) + " " + _signal_sort_sql(), FT)
def o4(spark, d):
    found = working_table(signals.clusters(*tf(spark, d), AS_OF, WIDE), "clusters")
    tie = F.col("type").asc()
    pages = [ordering.page(found, [*ordering.signal_order(sign + key), tie], 20).select(F.lit(sign + key).alias("sort_key"), "id")
             for key in sorted(ordering.SIGNAL_SORTS) for sign in ("", "-")]
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("x1_person_key", f"select id, {sql_key()} as person_key from filings", ("filings",))
def x1(spark, d):
    return filings(spark, d).select("id", person_key(
        F.col("state_district"), F.col("first_name"), F.col("last_name")).alias("person_key"))


@query("x3_signal_id", cluster_sql(30, 30) + " select id, ticker, start_date from clusters", FT)
def x3(spark, d):
    return signals.clusters(*tf(spark, d), AS_OF, WIDE).select("id", "ticker", "start_date")


@query("x4_signal_id_parse", cluster_sql(30, 30) + """ select id as signal_id, type, lower(ticker) as ticker, start_date
    from clusters union all select 'zz_' || id, null, null, null from clusters""", FT)
def x4(spark, d):
    ids = signals.clusters(*tf(spark, d), AS_OF, WIDE).select(F.col("id").alias("signal_id"))
    return signals.parse_signal_ids(ids.unionByName(ids.select(F.concat(F.lit("zz_"), "signal_id").alias("signal_id"))))


def _texts(rules, value) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "case txn_type " + " ".join(f"when '{r.txn_type}' then {quoted(value(r))}" for r in rules) + " end"


LIMITATION_SQL = _texts(BOTH, lambda r: "\n".join(r.limitations)) + " as limitations, " + _texts(BOTH, lambda r: r.description) + " as description"


@query("x40_rule_block", cluster_sql(30, 30) + """ select id, label as rule_label, txn_type as rule_txn_type,
    30 as max_gap_days, 30 as max_span_days, 3 as min_politicians, """ + LIMITATION_SQL + " from clusters", FT)
def x40(spark, d):
    found = signals.with_rule(signals.clusters(*tf(spark, d), AS_OF, WIDE), WIDE)
    return found.select("id", F.col("rule.label").alias("rule_label"), F.col("rule.txn_type").alias("rule_txn_type"),
                        "rule.max_gap_days", "rule.max_span_days", "rule.min_politicians",
                        F.array_join("limitations", "\n").alias("limitations"), F.col("rule.description").alias("description"))


HIGHLIGHT_SQL = f"""
    select type, label as title, ticker || ' — ' || transaction_count || ' transactions involving '
        || politician_count || ' members' as summary,
      'At least 3 politicians disclosed ' || case txn_type when 'P' then 'purchases' else 'sales' end
        || ' of the same ticker, with no more than 30 days between consecutive transactions and a maximum 30-day span.'
        as reason,
      start_date as date_start, end_date as date_end, id as signal_id, ticker, transaction_count, politician_count,
      '/signals/' || id as detail_url
    from clusters where start_date >= date '1999-12-30' and end_date <= date '{AS_OF}'
    qualify row_number() over (partition by txn_type order by end_date desc, start_date desc, ticker) = 1"""


@query("c3_cluster_highlights", cluster_sql(30, 30) + HIGHLIGHT_SQL, FT)
def c3(spark, d):
    return signals.cluster_highlights(signals.recent_clusters(*tf(spark, d), AS_OF, WIDE), WIDE)


@query("x38_highlight_text", cluster_sql(30, 30) + f""" select id as signal_id, ticker || ' — ' || transaction_count
    || ' transactions involving ' || politician_count || ' members' as summary, '/signals/' || id as detail_url
    from clusters""", FT)
def x38(spark, d):
    found = signals.clusters(*tf(spark, d), AS_OF, WIDE)
    return signals.cluster_highlights(found, WIDE).select("signal_id", "summary", "detail_url")


@query("c4_largest_highlights", LARGEST_SQL + f""" select
    case txn_type when 'P' then 'largest_disclosed_purchase' else 'largest_disclosed_sale' end as type,
    case txn_type when 'P' then 'Largest Disclosed Purchase (by minimum amount)'
      else 'Largest Disclosed Sale (by minimum amount)' end as title, ticker,
    {sql_key()} as politician_id, trim(first_name || ' ' || last_name) as politician_name, txn_date, amount_min,
    amount_max, amount_raw, 'Ranked by disclosed minimum amount. This is not necessarily the definitively largest transaction when disclosed ranges overlap.' as reason,
    id as transaction_id, filing_id, doc_id, '/filings/' || doc_id as detail_url from ranked where rn = 1""", FT)
def c4(spark, d):
    t, f = tf(spark, d, assets=False)
    return signals.largest_trade_highlights(signals.largest_trades(t, f, AS_OF))


@query("x39_largest_text", f"""with ranked as (select t.*, f.doc_id, f.first_name, f.last_name, f.state_district
      from transactions t join filings f on f.id = t.filing_id where txn_type in ('P', 'S'))
    select id as transaction_id, case txn_type when 'P' then 'Largest Disclosed Purchase (by minimum amount)'
      else 'Largest Disclosed Sale (by minimum amount)' end as title, {sql_key()} as politician_id,
    '/filings/' || doc_id as detail_url from ranked""", FT)
def x39(spark, d):
    t, f = tf(spark, d, assets=False)
    rows = joins.lines(t.filter("txn_type in ('P', 'S')"), f)
    return signals.largest_trade_highlights(rows).select("transaction_id", "title", "politician_id", "detail_url")


@query("x41_txn_noun", cluster_sql(30, 30) + """ select id, case type when 'buy_cluster' then 'purchase' else 'sale' end as one,
    case type when 'buy_cluster' then 'purchases' else 'sales' end as many from clusters""", FT)
def x41(spark, d):
    from ..functions.labels import txn_noun
    return signals.clusters(*tf(spark, d), AS_OF, WIDE).select(
        "id", txn_noun(F.col("type"), many=False).alias("one"), txn_noun(F.col("type")).alias("many"))
