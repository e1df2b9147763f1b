"""Landed files written from the given tables and read back, documents, rosters and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..plans import report_html, report_layout, report_text, resolve, roster
from ..plans.ingest import normalized_lines
from ..session import scratch_path
from ..sources import documents, house_index, rosters, senate_index, tables
from . import landing
from .adapters import filers, filings, members, records, table, transactions
from .q_scalars import NICK_SQL
from .registry import query

FT = ("filings", "transactions")
INDEX_SQL = """coalesce(prefix, '') as prefix, last_name as last, first_name as first, coalesce(suffix, '') as suffix,
    case when doc_kind = 'scanned' then 'C' else 'P' end as filing_type, state_district, year, filing_date, doc_id"""


@query("s1_house_index_xml", f"select {INDEX_SQL} from filings", ("filings",))
def s1(spark, d):
    path = landing.land_xml(landing.index_table(spark, d), "index-xml", house_index.ROOT_TAG, house_index.ROW_TAG)
    return house_index.strict(house_index.read_xml(spark, path))


@query("s2_house_index_tsv", f"select {INDEX_SQL} from filings", ("filings",))
def s2(spark, d):
    path = landing.land_tsv(landing.index_table(spark, d), "index-tsv")
    return house_index.strict(house_index.read_tsv(spark, path))


@query("s3_listing_preference", """select doc_id, year, case when year < 1998 then 'xml' else 'txt' end as origin from filings""",
       ("filings",))
def s3(spark, d):
    f = filings(spark, d).select("doc_id", "year")
    xml, txt = f.filter("year < 1998"), f
    return house_index.prefer_xml(xml.withColumn("origin", F.lit("xml")), txt.withColumn("origin", F.lit("txt")))


@query("s4_senate_listing_json", """select given as first, replace(last, ',', '') as last,
    replace(last, ',', '') || ', ' || given || ' (Senator)' as office, 'P' as filing_type, filing_date, doc_id,
    case when contains(office, 'Former') then 'paper' else 'electronic' end as view_kind from filers""", ("filers",))
def s4(spark, d):
    path = landing.land_json(landing.senate_listing_pages(spark, d), "listing")
    return senate_index.strict(senate_index.read_listing(spark, path, multi_line=False))


@query("s5_current_senators_xml", """select strip_accents(lower(last_name || bioguide_id)) as last_key, lower(first_name) as first_key, state
    from members""", ("members",))
def s5(spark, d):
    rows = members(spark, d).select(F.concat("last_name", "bioguide_id").alias("last_name"), "first_name", "state")
    path = landing.land_xml(rows, "senators", "contact_information", "member")
    return senate_index.read_senators(spark, path)


ROSTER_SQL = """select bioguide_id, last_name, first_name, given_name, {alts} state, party,
    start1 || '/' || end1 || ' ' || start2 || '/' || coalesce(cast(end2 as varchar), '') as terms from members"""


def flat_terms(df):
    one = lambda t: F.concat(t["start"].cast("string"), F.lit("/"), F.coalesce(t["end"].cast("string"), F.lit("")))
    return df.withColumn("terms", F.array_join(F.transform("terms", one), " "))


@query("s6_house_roster_json", ROSTER_SQL.format(alts="coalesce(alternate, '') as last_name_alts,"), ("members",))
def s6(spark, d):
    path = landing.land_json(landing.roster_snapshots(spark, d, house=True), "house-roster")
    read = rosters.read_house_roster(spark, path, multi_line=False)
    return flat_terms(read).withColumn("last_name_alts", F.array_join("last_name_alts", ","))


@query("s7_senate_roster_json", ROSTER_SQL.format(alts=""), ("members",))
def s7(spark, d):
    path = landing.land_json(landing.roster_snapshots(spark, d, house=False), "senate-roster")
    return flat_terms(rosters.read_senate_roster(spark, path, multi_line=False))


def raw_union(spark, d):
    raw = landing.raw_records(spark, d)
    historical = F.col("name.first").isin("James", "William", "Robert")
    old = landing.land_json(raw.filter(historical), "legislators-historical")
    new = landing.land_json(raw.filter(~historical), "legislators-current")
    return rosters.read_raw_records(spark, old, new, multi_line=False)


@query("s8_raw_legislators", """select bioguide_id, first, coalesce(official_full, '') as official_full, cast(4 as int) as terms,
    cast(case when first in ('James', 'William', 'Robert') then 0 else 1 end as int) as origin from records""", ("records",))
def s8(spark, d):
    return raw_union(spark, d).select(F.col("id.bioguide").alias("bioguide_id"), "name.first", F.coalesce(
        "name.official_full", F.lit("")).alias("official_full"), F.size("terms").alias("terms"), "origin")


@query("u2_all_records", "select bioguide_id, last from records", ("records",))
def u2(spark, d):
    return raw_union(spark, d).select(F.col("id.bioguide").alias("bioguide_id"), "name.last")


@query("s9_stored_tables", """select f.id, f.doc_id, t.id as line_id from filings f join transactions t on t.filing_id = f.id
    where f.source = 'senate_efd'""", FT)
def s9(spark, d):
    stored = landing.land_parquet(filings(spark, d).select("id", "doc_id", "source"), "stored-filings")
    f = tables.read_parquet(spark, stored, filings(spark, d).select("id", "doc_id", "source").schema)
    t = transactions(spark, d).select(F.col("id").alias("line_id"), "filing_id")
    return f.filter("source = 'senate_efd'").join(t, f["id"] == t["filing_id"]).select("id", "doc_id", "line_id")


@query("s10_document_landing", "select cast(doc_id as varchar) as doc_id, md5(text) as digest, length(text) as chars from documents")
def s10(spark, d):
    path = landing.land_parquet(table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body")), "documents")
    landed = documents.read_document_table(spark, path)
    return landed.select("doc_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("chars"))


# --- document parsing -----------------------------------------------------------

LINE_COLUMNS = """id as doc_id, block_no, source_id, owner, asset_name, ticker, asset_type_code, txn_type, txn_date,
    notification_date, amount_min, amount_max, amount_raw, notes, filing_status"""
TEXT_SQL = """with t as (select cast(id as varchar) as id, txn_type, txn_date, notification_date, amount_min, amount_max, asset_name,
      txn_source_id, case when owner_token <> 'Self' then owner_token end as owner,
      case when ticker <> '--' then ticker end as ticker,
      case when length(asset_type_code) = 2 then asset_type_code else 'ST' end as code, notes, filing_status from transactions),
    parsed as (
      select id, cast(0 as int) as block_no, txn_source_id as source_id, owner,
        asset_name || coalesce(' (' || ticker || ')', '') as asset_name, ticker, code as asset_type_code, txn_type, txn_date,
        notification_date, amount_min, coalesce(amount_max, amount_min) as amount_max,
        '$' || format('{:,}', amount_min) || coalesce(' - $' || format('{:,}', amount_max), '') as amount_raw,
        notes || ' with $5 more' as notes, filing_status from t
      union all select id, 1, null, 'JT', 'Long asset part one', null, 'CT', txn_type, txn_date, notification_date, 1001, 15000,
        '$1,001 - $15,000', null, 'Amended' from t)"""


@query("c13_parse_report_text", TEXT_SQL + f" select {LINE_COLUMNS} from parsed", ("transactions",))
def c13(spark, d):
    return report_text.parse_text(landing.report_texts(spark, d)).drop("fault")


@query("w5_trade_blocks", """select cast(id as varchar) as doc_id, cast(n as int) as block_no,
    case n when 0 then filing_status when 1 then 'Amended' else 'Lost' end as filing_status
    from transactions cross join (values (0), (1), (2)) b(n)""", ("transactions",))
def w5(spark, d):
    return report_text.blocks(landing.report_texts(spark, d)).select("doc_id", "block_no", "filing_status")


@query("c16_normalized_lines", TEXT_SQL + """ select id as doc_id, block_no as sequence, coalesce(asset_name, '') as asset_name,
    owner as owner_token, amount_min, amount_max, amount_raw from parsed""", ("transactions",))
def c16(spark, d):
    return normalized_lines(report_text.parse_text(landing.report_texts(spark, d))).select(
        "doc_id", "sequence", "asset_name", "owner_token", "amount_min", "amount_max", "amount_raw")


@query("c15_parse_report_html", """select cast(id as varchar) as doc_id, cast(1 as int) as block_no,
      case when amount_min % 97 = 0 then 'broken' end as fault, owner_token as owner, asset_name || ' & Co' as asset_name, ticker,
      asset_type_code, case when amount_min % 97 <> 0 then txn_type end as txn_type, txn_date, amount_min, amount_max,
      case when amount_max is null then 'Over $' || format('{:,}', amount_min)
        else '$' || format('{:,}', amount_min) || ' - $' || format('{:,}', amount_max) end as amount_raw, notes from transactions
    union all select cast(id as varchar), 5, null, 'Joint', 'Williams', 'WMB', 'Stock', 'E', notification_date, 50000000, null,
      'Over $50,000,000', '--' from transactions""", ("transactions",))
def c15(spark, d):
    return report_html.parse_html(landing.senate_pages(spark, d)).drop("source_id", "notification_date", "filing_status")


LAYOUT_SQL = """select doc_id, case when suffix is not null then 'SP' else 'DC' end as owner, first_name || ' Fund (Q' || doc_id || ')' as asset_name,
      'Q' || doc_id as ticker, 'ST' as asset_type_code, 'S (partial)' as txn_type, cast(created_at as date) as txn_date,
      cast(created_at as date) as notification_date, 1001 as amount_min, 15000 as amount_max, '$1,001 - $15,000' as amount_raw,
      'first note more $99' as notes, doc_kind as filing_status from filings
    union all select doc_id, null, 'Other', null, 'GS', 'E', cast(created_at as date), cast(created_at as date), 15, 15, '$15.00',
      null, null from filings"""


@query("c14_parse_report_layout", LAYOUT_SQL, ("filings",))
def c14(spark, d):
    return report_layout.parse_layout(landing.report_words(spark, d)).drop("fault", "block_no", "source_id").withColumns(
        {c: F.col(c).cast("int") for c in ("amount_min", "amount_max")})


@query("w6_visual_rows", """select doc_id, cast(page as int) as page, cast(row_no as int) as row_no, cast(n as int) as words from filings
    cross join (values (1, 0, 2), (1, 1, 8), (1, 2, 2), (1, 3, 1), (1, 4, 9), (1, 5, 4), (1, 6, 3), (1, 7, 3), (2, 0, 2), (2, 1, 6),
      (2, 2, 5), (2, 3, 2)) v(page, row_no, n)""", ("filings",))
def w6(spark, d):
    return report_layout.visual_rows(landing.report_words(spark, d)).select("doc_id", "page", "row_no", F.size("words").alias("words"))


@query("w7_page_columns", """select doc_id, cast(page as int) as page, page = 2 as inherited, 100.0 as asset, 490.0 as amount from filings
    cross join (values (1), (2)) v(page)""", ("filings",))
def w7(spark, d):
    found = report_layout.page_columns(report_layout.page_rows(landing.report_words(spark, d)))
    return found.select("doc_id", "page", "inherited", F.col("at.asset").cast("decimal(4,1)").alias("asset"),
                        F.col("at.amount").cast("decimal(4,1)").alias("amount"))


# --- official names ---------------------------------------------------------------

SURNAME_SQL = "case shape when 2 then 'Smith' || family when 5 then 'Extra' else last end"
GIVEN_SQL = """case shape when 1 then first || ' Q.' when 2 then first || ' Pena Smith' || family when 4 then first || ' Lee'
    when 5 then first || ' Paul Extra' else first end"""
ALTS_SQL = """case shape when 2 then 'Pena Smith' || family || ' Smith' || family || ',Smith' || family || ' Smith' || family
    when 3 then 'Peña' || family when 4 then 'Lee ' || last when 5 then 'Extra Extra,Paul Extra Extra' else '' end"""


def official(spark, d):
    r = records(spark, d)
    surname = names.official_surname(F.col("last"), F.col("official_full"))
    given = names.official_given(F.col("first"), F.col("middle"), F.col("last"), F.col("official_full"))
    return r.withColumn("surname", surname).withColumn("given", given)


@query("x31_suffix_token", """with tokens as (select doc_id, unnest(string_split(last || ' jr., SENIOR, ivy', ' ')) as token from filers)
    select doc_id, token, lower(trim(token, '.,')) in ('jr', 'sr', 'junior', 'senior', 'ii', 'iii', 'iv', 'v') as suffix from tokens""",
       ("filers",))
def x31(spark, d):
    token = F.explode(F.split(F.concat("last", F.lit(" jr., SENIOR, ivy")), " ")).alias("token")
    return filers(spark, d).select("doc_id", token).withColumn("suffix", names.is_suffix(F.col("token")))


@query("x32_official_surname", f"select bioguide_id, {SURNAME_SQL} as surname from records", ("records",))
def x32(spark, d):
    return official(spark, d).select("bioguide_id", "surname")


@query("x33_official_given", f"select bioguide_id, {GIVEN_SQL} as given from records", ("records",))
def x33(spark, d):
    return official(spark, d).select("bioguide_id", F.array_join("given", " ").alias("given"))


@query("x34_initial_token", """with tokens as (select bioguide_id, unnest(string_split(given_name || ' J.P. É 4', ' ')) as token from members)
    select bioguide_id, token, token in ('J.', 'J.P.', 'É') as initial from tokens""", ("members",))
def x34(spark, d):
    token = F.explode(F.split(F.concat("given_name", F.lit(" J.P. É 4")), " ")).alias("token")
    return members(spark, d).select("bioguide_id", token).withColumn("initial", names.is_initial(F.col("token")))


@query("x35_alternate_surnames", f"select bioguide_id, {ALTS_SQL} as alternates from records", ("records",))
def x35(spark, d):
    alts = names.alternate_surnames(F.col("given"), F.col("surname"), F.col("official_full"))
    return official(spark, d).select("bioguide_id", F.array_join(alts, ",").alias("alternates"))


# --- roster snapshots ---------------------------------------------------------------

@query("c11_house_snapshot", f"""select bioguide_id, {SURNAME_SQL} as last_name, first as first_name, {GIVEN_SQL} as given_name,
    {ALTS_SQL} as last_name_alts, case late when 'rep' then state else 'XX' end as state, nullif(party, '') as party,
    '1999-01-06/2001-01-03' || case late when 'rep' then ' 2003-01-07/' || late_end else '' end as terms from records""", ("records",))
def c11(spark, d):
    snapshot = roster.house_snapshot(landing.raw_records(spark, d), "2026-01-01")
    return flat_terms(snapshot).withColumn("last_name_alts", F.array_join("last_name_alts", ","))


SENATE_SNAPSHOT_SQL = f"""select bioguide_id, {SURNAME_SQL} as last_name, first as first_name, {GIVEN_SQL} as given_name, state,
    nullif(party, '') as party, '2003-01-07/' || %s as terms from records where late = 'sen'"""


@query("c12_senate_snapshot", SENATE_SNAPSHOT_SQL % "late_end", ("records",))
def c12(spark, d):
    raw = landing.raw_records(spark, d)
    return flat_terms(roster.senate_snapshot(raw, "2026-01-01", roster.verified_corrections(spark)))


@query("j13_service_corrections", SENATE_SNAPSHOT_SQL % "case state when 'EU' then '2009-01-03' else late_end end", ("records",))
def j13(spark, d):
    snapshot = roster.senate_snapshot(landing.raw_records(spark, d), "2026-01-01")
    fixes = snapshot.filter("state = 'EU'").select("bioguide_id", F.lit("2003-01-07").alias("start"), F.lit("2009-01-03").alias("end"))
    return flat_terms(roster.apply_corrections(snapshot, fixes))


@query("k4_snapshot_write", f"select bioguide_id, {SURNAME_SQL} as last_name, first as first_name from records", ("records",))
def k4(spark, d):
    path = scratch_path(spark, "snapshot")
    snapshot = roster.house_snapshot(landing.raw_records(spark, d), "2026-01-01")
    rosters.write_snapshot(snapshot, path)
    return spark.read.schema(snapshot.schema).json(path).select("bioguide_id", "last_name", "first_name")


DIFF_SQL = """select bioguide_id, case state when 'AF' then 'added' when 'AS' then 'removed' else 'changed' end as kind,
      case when state not in ('AF', 'AS') then 'party' end as field from members
      where state in ('AF', 'AS') or first_name = 'Edward'
    union all select bioguide_id, 'changed', 'terms' from members where state not in ('AF', 'AS') and end2 is null"""


def _two_snapshots(spark, d):
    now = landing.roster(spark, d)
    old = now.filter("state <> 'AF'")
    ended = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.coalesce(t["end"], F.lit("2009-01-03").cast("date")).alias("end"),
                                                    t["district"].alias("district")))
    new = (now.filter("state <> 'AS'").withColumn("party", F.when(F.col("first_name") == "Edward", "I").otherwise(F.col("party")))
           .withColumn("terms", ended))
    return old, new


@query("j12_snapshot_diff", DIFF_SQL, ("members",))
def j12(spark, d):
    return roster.snapshot_diff(*_two_snapshots(spark, d)).select("bioguide_id", "kind", "field")


@query("j12_bucket_diff", DIFF_SQL, ("members",))
def j12_buckets(spark, d):
    return roster.bucket_diff(*_two_snapshots(spark, d)).select("bioguide_id", "kind", "field")


@query("j12_senate_snapshot_diff", """select bioguide_id, 'changed' as kind, 'given_name' as field from members
    where given_name <> first_name""", ("members",))
def j12_senate(spark, d):
    now = landing.roster(spark, d)
    return roster.snapshot_diff(now, now.withColumn("given_name", F.col("first_name")), roster.SENATE_FIELDS).select(
        "bioguide_id", "kind", "field")


# --- resolution -----------------------------------------------------------------------

PAIRS_SQL = f"""with {NICK_SQL},
    pairs as (select f.doc_id, f.filing_date, m.bioguide_id, m.state, f.filing_date is null
        or f.filing_date between m.start1 and m.end1 or (f.filing_date >= m.start2 and (m.end2 is null or f.filing_date <= m.end2)) as serving,
        coalesce(m.end2 < f.filing_date and m.end1 < f.filing_date, false) as ended
      from filers f join members m on {{anchor}}
        and (lower(f.given) = lower(m.first_name) or exists (select 1 from nick n where n.formal = lower(m.first_name) and n.short = lower(f.given)))),
    found as (select doc_id, count(*) as idents, count(*) filter (where serving) as hits, min(bioguide_id) as any_id,
        min(bioguide_id) filter (where serving) as hit_id, min(state) as any_state, min(state) filter (where serving) as hit_state,
        bool_and(ended) as ended from pairs group by doc_id)"""
HOUSE_ANCHOR = """f.state_district[1:2] = m.state and length(f.state_district) >= 2 and
    strip_accents(lower(regexp_replace(f.last, ', MD.$', ''))) in (strip_accents(lower(m.last_name)), coalesce(strip_accents(lower(m.alternate)), ''))"""
SENATE_ANCHOR = "strip_accents(lower(regexp_replace(f.last, ' II$', ''))) = strip_accents(lower(m.last_name))"


@query("c9_resolve_house", PAIRS_SQL.format(anchor=HOUSE_ANCHOR) + """,
    judged as (select f.doc_id, r.*, case when length(f.state_district) < 2 then 'no_state' when hits = 1 then 'resolved'
        when hits > 1 then 'ambiguous' when idents is null then 'no_match' when idents > 1 then 'ambiguous'
        when ended then 'resolved_post_service' else 'not_serving' end as status
      from filers f left join (select doc_id as rid, * exclude (doc_id) from found) r on r.rid = f.doc_id)
    select doc_id, status, case status when 'resolved' then hit_id when 'resolved_post_service' then any_id end as bioguide_id from judged""",
       ("filers", "members"))
def c9(spark, d):
    return resolve.resolve_house(filers(spark, d), landing.roster(spark, d)).select("doc_id", "status", "bioguide_id")


@query("j11_service_interval", PAIRS_SQL.format(anchor=HOUSE_ANCHOR) + """ select f.doc_id, f.hit_id as low, max(p.bioguide_id) as high
    from found f join pairs p on p.doc_id = f.doc_id and p.serving group by all""", ("filers", "members"))
def j11(spark, d):
    return resolve.serving_matches(filers(spark, d), landing.roster(spark, d))


# The sitting listing holds the members whose first name is short in print.
LISTED_SQL = """, listed as (select f.doc_id, count(*) as n, min(m.state) as state from filers f join members m
        on strip_accents(lower(f.last)) = strip_accents(lower(m.last_name))
        and (lower(f.given) = lower(m.first_name) or exists (select 1 from nick n where n.formal = lower(m.first_name) and n.short = lower(f.given)))
      where m.party = 'D' group by f.doc_id)"""


@query("c10_resolve_senate", PAIRS_SQL.format(anchor=SENATE_ANCHOR) + LISTED_SQL + """,
    judged as (select f.doc_id, r.any_state, r.hit_state, l.state as listed_state, case when l.n = 1 then 'resolved_current'
        when hits = 1 then 'resolved' when hits > 1 then 'ambiguous'
        when contains(f.office, 'Former') and f.filing_date is not null and idents = 1 and ended then 'resolved_post_service'
        when contains(f.office, 'Former') and f.filing_date is not null and idents > 1 then 'ambiguous'
        when l.n is null then 'unresolved' else 'ambiguous' end as status
      from filers f left join found r on r.doc_id = f.doc_id left join listed l on l.doc_id = f.doc_id)
    select doc_id, status, case status when 'resolved_current' then listed_state when 'resolved' then hit_state
      when 'resolved_post_service' then any_state end || '00' as state_district from judged""", ("filers", "members"))
def c10(spark, d):
    m = members(spark, d).filter("party = 'D'")
    listing = senate_index.senators(m.select("last_name", "first_name", "state", F.col("bioguide_id").alias("position")))
    return resolve.resolve_senate(filers(spark, d).drop("state_district"), listing, landing.roster(spark, d)).select(
        "doc_id", "status", "state_district")
