"""Filters, joins, aggregates, ordering and browsing views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.dates import lag_days
from ..functions.identity import person_key, resolve_person_ids
from ..operators import aggregates, filters, joins, order_index, ordering
from ..plans import browse
from ..session import working_table
from .adapters import filings, table, transactions
from .q_signals import sql_key
from .registry import query

FT = ("filings", "transactions")
LINES_SQL = """with lines as (select t.*, f.doc_id, f.filing_date, f.created_at, f.first_name, f.last_name,
    f.state_district from transactions t join filings f on f.id = t.filing_id)"""


def lines(spark, d, assets=False):
    return joins.lines(transactions(spark, d, assets), filings(spark, d))


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# --- filters -----------------------------------------------------------------

@query("f1_politician_equality", """with who as (select f.state_district, lower(first_name) as f1, lower(last_name) as l1
      from filings f join customer c on f.last_name = c.c_name where c_acctbal < 0)
    select id, first_name, last_name from filings f where exists (select 1 from who w
      where w.state_district = f.state_district and w.f1 = lower(f.first_name) and w.l1 = lower(f.last_name))""",
       ("filings",))
def f1(spark, d):
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("last_name"))
    f = filings(spark, d)
    who = f.join(poor, "last_name", "left_semi").withColumn("last_name", F.upper("last_name"))
    return filters.of_politicians(f, who).select("id", "first_name", "last_name")


@query("f2_state_prefix_filings", "select id, state_district from filings where state_district like 'EU%'", ("filings",))
def f2(spark, d):
    return filters.filings_of_state(filings(spark, d), "eu").select("id", "state_district")


@query("f3_state_prefix_politicians", "select id, state_district from filings where lower(state_district) like 'a_0%'",
       ("filings",))
def f3(spark, d):
    return filters.politicians_of_state(filings(spark, d), "A_0").select("id", "state_district")


@query("f4_index_year", "select id, year from filings where year = 1998", ("filings",))
def f4(spark, d):
    return filters.in_index_year(filings(spark, d), 1998).select("id", "year")


@query("f5_date_range", """select id, filing_date from filings
    where filing_date between date '1996-02-29' and date '1997-03-01'""", ("filings",))
def f5(spark, d):
    return filters.between_dates(filings(spark, d), "filing_date", "1996-02-29", "1997-03-01").select("id", "filing_date")


@query("f6_amount_range", "select id, amount_min, amount_max from transactions where amount_min between 15001 and 50000",
       ("transactions",))
def f6(spark, d):
    return filters.amount_between(transactions(spark, d), 15001, 50000).select("id", "amount_min", "amount_max")


@query("f7_name_contains", "select id from filings where (first_name || ' ' || last_name) ilike '%building cust%99%'",
       ("filings",))
def f7(spark, d):
    return filters.name_contains(filings(spark, d), " BUILDING cust%99 ").select("id")


@query("f8_ticker_equality", "select id, ticker from transactions where lower(ticker) = 'p77'", ("transactions",))
def f8(spark, d):
    return filters.ticker_is(transactions(spark, d), "p77").select("id", "ticker")


@query("f9_exact_codes", """select id from transactions where asset_type_code = 'Stock Option'
    and txn_type = 'S (partial)' and owner_token = 'Self'""", ("transactions",))
def f9(spark, d):
    return filters.equals(transactions(spark, d), asset_type_code="Stock Option", txn_type="S (partial)",
                          owner_token="Self").select("id")


@query("f10_lines_of_documents", """select id, filing_id from transactions
    where filing_id in (select id from filings where doc_kind = 'scanned')""", FT)
def f10(spark, d):
    f = filings(spark, d)
    wanted = f.filter("doc_kind = 'scanned'").select("doc_id")
    return filters.lines_of_document(transactions(spark, d), f, wanted).select("id", "filing_id")


@query("f11_calendar_year", "select id, txn_date from transactions where year(txn_date) = 1999", ("transactions",))
def f11(spark, d):
    return filters.traded_in_year(transactions(spark, d), 1999).select("id", "txn_date")


INDEX_SQL = "select doc_id, case when id % 3 = 0 then 'C' else 'P' end as filing_type, filing_date from filings"


def index_rows(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "C").otherwise("P")
    return filings(spark, d).select("doc_id", kind.alias("filing_type"), "filing_date")


@query("f17_periodic_reports", f"select * from ({INDEX_SQL}) where filing_type = 'P'", ("filings",))
def f17(spark, d):
    return filters.periodic_reports(index_rows(spark, d))


@query("f18_filed_since", f"select * from ({INDEX_SQL}) where filing_date >= date '1999-06-01'", ("filings",))
def f18(spark, d):
    return filters.filed_since(index_rows(spark, d), "1999-06-01")


@query("f19_profile_filter", """select id, ticker, txn_type, owner_token from transactions
    where contains(lower(ticker), 'p7') and txn_type = 'P' and owner_token = 'SP'""", ("transactions",))
def f19(spark, d):
    return filters.profile_lines(transactions(spark, d), "P7", "P", "SP").select("id", "ticker", "txn_type", "owner_token")


NAME_SQL = "concat_ws(' ', nullif(prefix, ''), nullif(first_name, ''), nullif(last_name, ''), nullif(suffix, ''))"


@query("f20_filing_row", f"""select f.doc_id, year, {NAME_SQL} as name, state_district, filing_date, doc_kind, pdf_url,
      strftime(downloaded_at, '%Y-%m-%d %H:%M:%S') as downloaded_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
      coalesce(n, 0) as transaction_count
    from filings f left join (select filing_id, cast(count(*) as bigint) as n from transactions group by 1) c
      on c.filing_id = f.id""", FT)
def f20(spark, d):
    rows = browse.filing_rows(joins.with_line_counts(filings(spark, d), transactions(spark, d)))
    return rows.withColumns({c: stamp(c) for c in ("downloaded_at", "created_at")})


LINE_SQL = f"""select l.id, filing_id, doc_id, filing_date, {sql_key()} as politician_id,
      trim(first_name || ' ' || last_name) as politician_name, sequence, asset_name, ticker, asset_type_code, txn_type,
      txn_date, cast(date_diff('day', txn_date, filing_date) as int) as disclosure_lag_days, notification_date,
      amount_min, amount_max, amount_raw, owner_token as owner, filing_status, ownership_source, notes, txn_source_id,
      array_to_string(quality_flags, ',') as quality_flags, verified_transaction_date, verification_method,
      verification_confidence, verification_source_doc_id, verification_note,
      strftime(verified_at, '%Y-%m-%d') as verified_at,
      verification_source_doc_id is not null and verification_source_doc_id in (select doc_id from filings)
        as verification_source_doc_exists
    from lines l"""


def flat_lines(rows):
    return rows.withColumn("quality_flags", F.array_join("quality_flags", ",")).withColumn(
        "verified_at", F.date_format("verified_at", "yyyy-MM-dd"))


@query("f21_transaction_row", LINES_SQL + LINE_SQL, FT)
def f21(spark, d):
    f = filings(spark, d)
    return flat_lines(browse.line_rows(joins.with_evidence_flags(lines(spark, d, True), f)))


POLITICIAN_SQL = f"""select {sql_key()} as id, trim(first_name || ' ' || last_name) as name, cast(null as varchar) as party,
      substr(state_district, 1, 2) as state, substr(state_district, 3) as district, state_district, filing_count,
      transaction_count from rollup"""
ROLLUP_SQL = """with rollup as (select f.first_name, f.last_name, f.state_district,
      cast(count(distinct f.id) as bigint) as filing_count, cast(count(t.id) as bigint) as transaction_count
      from filings f left join transactions t on t.filing_id = f.id group by all)"""


@query("f22_politician_row", ROLLUP_SQL + POLITICIAN_SQL, FT)
def f22(spark, d):
    return browse.politician_rows(aggregates.politician_rollup(filings(spark, d), transactions(spark, d)))


@query("f23_verified_lines", "select id, verified_transaction_date from transactions where verified_transaction_date is not null",
       ("transactions",))
def f23(spark, d):
    return filters.verified_lines(transactions(spark, d)).select("id", "verified_transaction_date")


# --- joins -------------------------------------------------------------------

@query("j1_lines_with_filings", LINES_SQL + " select id, doc_id, filing_date, first_name, last_name, state_district from lines", FT)
def j1(spark, d):
    return lines(spark, d).select("id", "doc_id", "filing_date", "first_name", "last_name", "state_district")


@query("j2_filings_with_lines", """select f.id, cast(count(t.id) as bigint) as transaction_count,
    cast(coalesce(sum(t.amount_min), 0) as bigint) as total_min
    from filings f left join transactions t on t.filing_id = f.id group by f.id""", FT)
def j2(spark, d):
    sums = transactions(spark, d).groupBy("filing_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_min").alias("s"))
    return filings(spark, d).select("id").join(sums, F.col("id") == F.col("filing_id"), "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("transaction_count"), F.coalesce("s", F.lit(0)).alias("total_min"))


@query("j3_line_counts", """select f.id, cast((select count(*) from transactions t where t.filing_id = f.id) as bigint)
    as transaction_count from filings f""", FT)
def j3(spark, d):
    return joins.with_line_counts(filings(spark, d).select("id"), transactions(spark, d))


@query("j4_amended_document", """select f.id, o.doc_id as amends_doc_id from filings f
    left join filings o on o.id = f.amends_filing_id""", ("filings",))
def j4(spark, d):
    f = filings(spark, d)
    return joins.with_amended_doc(f.select("id", "amends_filing_id"), f).select("id", "amends_doc_id")


@query("j5_amendments_of_filing", """select o.doc_id as original_doc_id, f.doc_id, f.filing_date from filings f
    join filings o on o.id = f.amends_filing_id""", ("filings",))
def j5(spark, d):
    f = filings(spark, d)
    return joins.amendments_of(f, f).select("original_doc_id", "doc_id", "filing_date")


@query("j6_evidence_exists", """select id, verification_source_doc_id is not null and verification_source_doc_id in
    (select doc_id from filings) as verification_source_doc_exists from transactions""", FT)
def j6(spark, d):
    return joins.with_evidence_flag(transactions(spark, d).select("id", "verification_source_doc_id"),
                                    filings(spark, d)).select("id", "verification_source_doc_exists")


@query("j10_not_yet_stored", "select doc_id from filings where source <> 'senate_efd'", ("filings",))
def j10(spark, d):
    f = filings(spark, d)
    return joins.not_yet_stored(f, f.filter("source = 'senate_efd'")).select("doc_id")


# --- aggregates and set operations ------------------------------------------

@query("a1_page_total", "select cast(count(*) as bigint) as total from filings where year = 1997 and state_district like 'AS%'",
       ("filings",))
def a1(spark, d):
    return aggregates.total(browse.select_filings(filings(spark, d), state="as", year=1997))


@query("a2_politician_rollup", ROLLUP_SQL + " select * from rollup", FT)
def a2(spark, d):
    return aggregates.politician_rollup(filings(spark, d), transactions(spark, d))


@query("a3_politician_total", """select cast(count(*) as bigint) as total from (select distinct state_district,
    lower(first_name), lower(last_name) from filings)""", ("filings",))
def a3(spark, d):
    return aggregates.politician_total(filings(spark, d))


@query("u1_persons_of_district", """select distinct state_district, first_name, last_name from filings
    where state_district in (select state_district from filings where amends_filing_id is not null)""", ("filings",))
def u1(spark, d):
    f = filings(spark, d)
    return aggregates.persons_of_district(f, f.filter("amends_filing_id is not null"))


# --- ordering ----------------------------------------------------------------

@query("o1_sort_key_descending", """select id, row_number() over (order by filing_date desc nulls first, doc_id) as pos
    from filings order by filing_date desc nulls first, doc_id limit 100""", ("filings",))
def o1(spark, d):
    return ranked_page(filings(spark, d), ordering.filing_order("-filing_date"))


def ranked_page(df, order, limit=100, offset=0):
    """A page with positions, so that the order itself is compared."""
    return ranked(ordering.page(df, order, limit, offset), order)


def ranked(rows, order):
    from pyspark.sql import Window
    # at most 100 rows reach this window
    return rows.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))


@query("o2_filing_sort", """select id, row_number() over (order by filing_date asc nulls last, doc_id) as pos
    from filings order by filing_date asc nulls last, doc_id limit 100""", ("filings",))
def o2(spark, d):
    return ranked_page(filings(spark, d), ordering.filing_order("filing_date"))


_SORT_SQL = {
    "txn_date": "txn_date", "notification_date": "notification_date",
    "politician_name": "lower(first_name || ' ' || last_name)", "asset_name": "lower(asset_name)",
    "ticker": "lower(ticker)", "txn_type": "txn_type", "owner": "lower(owner_token)",
    "asset_type_code": """lower(case asset_type_code when 'ST' then 'Stocks (including ADRs)' when 'OP' then 'Options'
        when 'GS' then 'Government Securities and Agency Debt' when 'CT' then 'Cryptocurrency'
        when 'EF' then 'Exchange Traded Funds (ETF)' else asset_type_code end)""",
    "disclosure_lag_days": "date_diff('day', txn_date, filing_date)", "amount_min": "amount_min",
    "amount_max": "amount_max", "created_at": "created_at", "doc_id": "lower(doc_id)",
}


def _sort_sql():
    parts = []
    for key, expr in _SORT_SQL.items():
        for way, sign in (("asc", ""), ("desc", "-")):
            second = f", amount_max {way} nulls last" if key == "amount_min" else ""
            parts.append(f"""select '{sign}{key}' as sort_key, id, cast(pos as bigint) as pos from (select id, row_number() over (
                order by {expr} {way} nulls last{second}, id) as pos from lines) where pos <= 20""")
    return LINES_SQL + " " + " union all ".join(parts)


@query("o3_transaction_sorts", _sort_sql(), FT)
def o3(spark, d):
    rows = working_table(lines(spark, d, True), "lines")  # read once per sort key
    pages = [ranked_page(rows, ordering.transaction_order(sign + key), 20).withColumn("sort_key", F.lit(sign + key))
             for key in ordering.TRANSACTION_SORTS for sign in ("", "-")]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def _person_sort_sql():
    tie = "lower(last_name), lower(first_name), lower(state_district), last_name, first_name, state_district"
    return ROLLUP_SQL + " " + " union all ".join(
        f"""select '{sign}{key}' as sort_key, first_name, last_name, state_district, pos from (select *, row_number() over (
            order by {_person_key(key)} {way} nulls last, {tie}) as pos from rollup) where pos <= 50"""
        for key in sorted(ordering.POLITICIAN_SORTS) for way, sign in (("asc", ""), ("desc", "-")))


def _person_key(key: str) -> str:
    if key == "name":
        return "lower(concat_ws(' ', first_name, last_name))"
    return key if key.endswith("_count") else f"lower({key})"


@query("o5_politician_sort", _person_sort_sql(), FT)
def o5(spark, d):
    from pyspark.sql import Window
    rollup = working_table(aggregates.politician_rollup(filings(spark, d), transactions(spark, d)), "people")
    pages = []
    for key in sorted(ordering.POLITICIAN_SORTS):
        for sign in ("", "-"):
            order = ordering.politician_order(sign + key)
            # at most 50 rows reach this window
            pages.append(ordering.page(rollup, order, 50).select(
                F.lit(sign + key).alias("sort_key"), "first_name", "last_name", "state_district", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos")))
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("o6_page", """select id, row_number() over (order by amount_min desc, amount_max desc nulls last, id) as pos
    from (select * from transactions order by amount_min desc, amount_max desc nulls last, id limit 50 offset 150)""",
       ("transactions",))
def o6(spark, d):
    return ranked_page(transactions(spark, d), ordering.transaction_order("-amount_min"), 50, 150)


_AFTER_SQL = """select sort_key, id, row_number() over (partition by sort_key order by pos) as pos from (
    {parts}) where pos > 150 and pos <= 200"""
_AFTER_KEYS = {"-amount_max": "amount_max desc nulls last", "ticker": "lower(ticker) asc nulls last", "-amount_min": "amount_min desc, amount_max desc nulls last"}


@query("o6_deep_page", " union all ".join(
    f"select '{key}' as sort_key, id, row_number() over (order by {order}, id) as pos, count(*) over () as total from transactions qualify pos > total - 50"
    for key, order in _AFTER_KEYS.items()), ("transactions",))
def o6_deep(spark, d):
    """The last 50 rows of each order, found in its index, with the number of all rows."""
    rows, pages = transactions(spark, d), []
    for sort in _AFTER_KEYS:
        index = order_index.build(rows, ordering.transaction_keys(sort), 32)
        offset = max(0, index.total - 50)
        found = order_index.page(rows, "id", index, 50, offset)
        pages.append(ranked(found, ordering.transaction_order(sort)).withColumn("pos", F.col("pos") + F.lit(offset).cast("long"))
                     .withColumn("sort_key", F.lit(sort)).withColumn("total", F.lit(index.total).cast("long")))
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("o6_page_after", _AFTER_SQL.format(parts=" union all ".join(
    f"select '{key}' as sort_key, id, row_number() over (order by {order}, id) as pos from transactions" for key, order in _AFTER_KEYS.items())),
       ("transactions",))
def o6_after(spark, d):
    """Pages that begin after a row instead of after a number of rows."""
    rows, pages = transactions(spark, d), []
    for sort in _AFTER_KEYS:
        keys = ordering.transaction_keys(sort)
        values = [col.alias(f"k{i}") for i, (col, _) in enumerate(keys)]
        last = ordering.page(rows, ordering.transaction_order(sort), 1, 149).select(*values).first()
        found = ordering.page_after(rows, keys, list(last), 50)
        pages.append(ranked(found, ordering.transaction_order(sort)).withColumn("sort_key", F.lit(sort)))
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("o7_filing_lines_in_order", """select filing_id, id, cast(sequence as int) as sequence from transactions
    where filing_id in (select id from filings where amends_filing_id is not null)""", FT)
def o7(spark, d):
    f = filings(spark, d).filter("amends_filing_id is not null").select(F.col("id").alias("filing_id"))
    rows = transactions(spark, d).join(f, "filing_id", "left_semi")
    return rows.select("filing_id", "id", "sequence").orderBy("filing_id", "sequence", "id")


# --- views -------------------------------------------------------------------

@query("c5_transaction_browse", LINES_SQL + LINE_SQL + """ where txn_type = 'P' and amount_min >= 1001
    and txn_date between date '1998-01-01' and date '1998-12-31' order by txn_date desc, l.id limit 50 offset 10""", FT)
def c5(spark, d):
    return flat_lines(browse.lines_page(transactions(spark, d, True), filings(spark, d), "-txn_date", 50, 10,
                                        txn_type="P", amount_min=1001, year=1998))


@query("c6_filing_browse", f"""select f.doc_id, year, {NAME_SQL} as name, state_district, filing_date, doc_kind, pdf_url,
      strftime(downloaded_at, '%Y-%m-%d %H:%M:%S') as downloaded_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
      cast((select count(*) from transactions t where t.filing_id = f.id) as bigint) as transaction_count
    from filings f where state_district like 'EU%' and year = 1999
    order by f.created_at desc, f.doc_id limit 50""", FT)
def c6(spark, d):
    rows = browse.filings_page(filings(spark, d), transactions(spark, d), state="eu", year=1999)
    return rows.withColumns({c: stamp(c) for c in ("downloaded_at", "created_at")})


def detail(spark, d):
    """Detail of every filing; one lookup serves any number of documents."""
    f = filings(spark, d)
    return browse.filing_detail(f, transactions(spark, d, True), f.select("doc_id"))


@query("c7_filing_detail_header", f"""select f.doc_id, {NAME_SQL} as name, filing_date,
      (select o.doc_id from filings o where o.id = f.amends_filing_id) as amends_doc_id, amendment_method,
      amendment_confidence, amendment_note,
      cast((select count(*) from transactions t where t.filing_id = f.id) as bigint) as transaction_count
    from filings f""", FT)
def c7_header(spark, d):
    return detail(spark, d).header.select(
        "doc_id", "name", "filing_date", "amends_doc_id", "amendment_method", "amendment_confidence",
        "amendment_note", "transaction_count")


@query("c7_filing_detail_lines", LINES_SQL + LINE_SQL, FT)
def c7_lines(spark, d):
    return flat_lines(detail(spark, d).lines)


@query("c7_filing_detail_amendments", """select o.doc_id as original_doc_id, f.doc_id,
      concat_ws(' ', nullif(f.prefix, ''), f.first_name, f.last_name, nullif(f.suffix, '')) as name, f.filing_date,
      f.pdf_url, o.doc_id as amends_doc_id, f.amendment_method, f.amendment_confidence, f.amendment_note
    from filings o join filings f on f.amends_filing_id = o.id""", ("filings",))
def c7_amendments(spark, d):
    return detail(spark, d).amendments.drop("amendment_verified_at")


@query("c8_politician_browse", ROLLUP_SQL.replace(" group by all)", """
      where lower(state_district) like 'am%' and (first_name || ' ' || last_name) ilike '%i%' group by all)""")
       + POLITICIAN_SQL + """ order by filing_count desc, lower(last_name), lower(first_name), lower(state_district),
      last_name, first_name, state_district limit 50""", FT)
def c8(spark, d):
    return browse.politicians_page(filings(spark, d), transactions(spark, d), "-filing_count", 50, state="AM", name="i")


@query("c8_politician_details", ROLLUP_SQL.replace(" group by all)", " where f.last_name in (select c_name from customer where c_acctbal < 0) group by all)")
       + POLITICIAN_SQL, FT)
def c8_details(spark, d):
    """Details of many people at once: those with a negative account."""
    f = filings(spark, d)
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("last_name"))
    people = f.join(poor, "last_name", "left_semi").select("state_district", "first_name", "last_name").distinct()
    return browse.politician_details(f, transactions(spark, d), people)


@query("x2_resolve_person_id", f"""with asked as (select distinct {sql_key()} as person_id from filings
      union all select 'nodistrict' || doc_id from filings
      union all select distinct upper(state_district) || '_nobody_' from filings),
    persons as (select state_district, {sql_key()} as person_id, min(first_name) as first_name, min(last_name) as last_name
      from filings group by all)
    select person_id, state_district, first_name, last_name from asked left join persons using (person_id)""",
       ("filings",))
def x2(spark, d):
    f = filings(spark, d)
    key = person_key(F.col("state_district"), F.col("first_name"), F.col("last_name"))
    asked = (f.select(key.alias("person_id")).distinct()
             .unionByName(f.select(F.concat(F.lit("nodistrict"), "doc_id").alias("person_id")))
             .unionByName(f.select(F.concat(F.upper("state_district"), F.lit("_nobody_")).alias("person_id")).distinct()))
    return resolve_person_ids(asked, f)


@query("x5_disclosure_lag", LINES_SQL + " select id, cast(date_diff('day', txn_date, filing_date) as int) as lag_days from lines", FT)
def x5(spark, d):
    return lines(spark, d).select("id", lag_days(F.col("filing_date"), F.col("txn_date")).alias("lag_days"))
