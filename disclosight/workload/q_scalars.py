"""Labels, dates, ids, links and amount cells over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import dates, documents, labels, names, report_text
from ..operators import joins
from .adapters import filings, members, table, transactions
from .registry import query

FT = ("filings", "transactions")


def money(col: str) -> str:
    return f"'$' || format('{{:,}}', {col})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LABEL_SQL = "case {code} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in fv.ASSET_TYPE_LABELS.items()) + " else {code} end"
# every code of the list in turn, and one that is not on it
CODES = [*fv.ASSET_TYPE_LABELS, "??"]


@query("x6_asset_type_label", f"""with coded as (select id, [{', '.join(map(quoted, CODES))}][1 + id % {len(CODES)}] as code from transactions)
    select id, code, {LABEL_SQL.format(code='code')} as label from coded""", ("transactions",))
def x6(spark, d):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("id") % len(CODES)).cast("int") + 1)
    return transactions(spark, d).select("id", code.alias("code")).withColumn("label", labels.asset_type_label(F.col("code")))


@query("x7_txn_type_label", """select id, case txn_type when 'P' then 'Purchase' when 'S' then 'Sale' when 'E' then 'Exchange'
    else 'Sale (partial)' end as label from transactions""", ("transactions",))
def x7(spark, d):
    return transactions(spark, d).select("id", labels.txn_type_label(F.col("txn_type")).alias("label"))


@query("x8_amount_label", f"""select id, case when amount_max is null then 'Over ' || {money('amount_min')}
    else {money('amount_min')} || ' - ' || {money('amount_max')} end as label from transactions""", ("transactions",))
def x8(spark, d):
    return transactions(spark, d).select("id", labels.amount_label(F.col("amount_min"), F.col("amount_max")).alias("label"))


@query("x9_flag_messages", """with flagged as (select t.id, f.filing_date, list_concat(quality_flags, [x for x in [
      case when t.txn_date > f.filing_date then 'transaction_date_after_filing' end, 'not_a_flag',
      case when t.notification_date > f.filing_date then 'notification_date_after_filing' end,
      case when t.filing_id % 2 = 0 then 'transaction_date_after_ingestion_date' end,
      case when f.filing_date is null then 'transaction_date_after_filing' end] if x is not null]) as flags
      from transactions t join filings f on f.id = t.filing_id)
    select id, array_to_string([m for m in [case x
      when 'transaction_date_after_notification' then 'Transaction date is after the notification date.'
      when 'transaction_date_after_filing' then 'Transaction date is after the filing date' || coalesce(' (' || strftime(filing_date, '%Y-%m-%d') || ')', '') || '.'
      when 'transaction_date_after_ingestion_date' then 'Transaction date is after the date this filing was ingested.'
      when 'notification_date_after_filing' then 'Notification date is after the filing date' || coalesce(' (' || strftime(filing_date, '%Y-%m-%d') || ')', '') || '.'
      end for x in flags] if m is not null], chr(10)) as warning from flagged""", FT)
def x9(spark, d):
    rows = joins.lines(transactions(spark, d), filings(spark, d))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    extra = F.array_compact(F.array(
        flag(F.col("txn_date") > F.col("filing_date"), fv.FLAG_AFTER_FILING), F.lit("not_a_flag"),
        flag(F.col("notification_date") > F.col("filing_date"), fv.FLAG_NOTIFICATION_AFTER_FILING),
        flag(F.col("filing_id") % 2 == 0, fv.FLAG_AFTER_INGESTION),
        flag(F.col("filing_date").isNull(), fv.FLAG_AFTER_FILING)))
    return rows.select("id", labels.flag_messages(F.concat("quality_flags", extra), F.col("filing_date")).alias("warning"))


@query("x10_display_date", """select id, strftime(coalesce(verified_transaction_date, txn_date), '%m/%d/%Y') as shown
    from transactions union all select id, coalesce(strftime(filing_date, '%m/%d/%Y'), '—') from filings""", FT)
def x10(spark, d):
    t = transactions(spark, d).select("id", labels.display_date(F.col("txn_date"), F.col("verified_transaction_date")).alias("shown"))
    return t.unionByName(filings(spark, d).select("id", labels.display_date(
        F.col("filing_date"), F.lit(None).cast("date")).alias("shown")))


@query("x11_six_month_cutoff", "select id, cast(txn_date - interval 6 month as date) as cutoff from transactions", ("transactions",))
def x11(spark, d):
    return transactions(spark, d).select("id", dates.six_months_before(F.col("txn_date")).alias("cutoff"))


DOC_IDS_SQL = """with ids as (select id, source, year, case when source = 'senate_efd' and doc_kind <> 'scanned'
    then 'a' || doc_id || '-b7' when doc_kind = 'scanned' then lpad(doc_id, 7, '0') else lpad(doc_id, 8, '1') end as doc from filings)"""


def doc_ids(spark, d):
    scanned = F.col("doc_kind") == "scanned"
    doc = (F.when((F.col("source") == "senate_efd") & ~scanned, F.concat(F.lit("a"), "doc_id", F.lit("-b7")))
           .when(scanned, F.lpad("doc_id", 7, "0")).otherwise(F.lpad("doc_id", 8, "1")))
    return filings(spark, d).select("id", "source", "year", doc.alias("doc"))


@query("x12_house_doc_kind", DOC_IDS_SQL + """ select id, case when regexp_full_match(doc, '[0-9]{7}') then 'scanned' else 'efiled' end as kind
    from ids""", ("filings",))
def x12(spark, d):
    return doc_ids(spark, d).select("id", documents.house_doc_kind(F.col("doc")).alias("kind"))


@query("x13_senate_doc_kind", DOC_IDS_SQL + """ select id, case when regexp_full_match(doc, '[0-9]+') then 'scanned' else 'efiled' end as kind
    from ids""", ("filings",))
def x13(spark, d):
    return doc_ids(spark, d).select("id", documents.senate_doc_kind(F.col("doc")).alias("kind"))


@query("x14_view_link", DOC_IDS_SQL + """ select id, case when source <> 'senate_efd' then null when regexp_full_match(doc, '[0-9]+') then 'paper'
    else 'electronic' end as view_kind, case when source = 'senate_efd' then doc end as view_id from ids""", ("filings",))
def x14(spark, d):
    doc = F.col("doc")
    path = F.when(F.col("source") != "senate_efd", "else").when(doc.rlike(r"^[0-9]+\z"), "paper").otherwise("ptr")
    link = F.concat(F.lit('<a href="/search/view/'), path, F.lit("/"), doc, F.lit('/" target="_blank">Report</a>'))
    return doc_ids(spark, d).withColumn("v", documents.view_link(link)).select("id", "v.view_kind", "v.view_id")


@query("x15_document_url", DOC_IDS_SQL + """ select id, case when source <> 'senate_efd'
      then 'https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/' || year || '/' || doc || '.pdf'
      when regexp_full_match(doc, '[0-9]+') then 'https://efdsearch.senate.gov/search/view/paper/' || doc || '/'
      else 'https://efdsearch.senate.gov/search/view/ptr/' || doc || '/' end as url from ids""", ("filings",))
def x15(spark, d):
    return doc_ids(spark, d).select("id", documents.document_url(F.col("source"), F.col("year"), F.col("doc")).alias("url"))


@query("x16_lenient_date", """select id, case txn_type when 'P' then txn_date when 'S' then txn_date end as parsed from transactions""",
       ("transactions",))
def x16(spark, d):
    day = F.col("txn_date")
    text = (F.when(F.col("txn_type") == "P", F.date_format(day, " M/d/yyyy "))
            .when(F.col("txn_type") == "S", F.date_format(day, "MM/dd/yyyy"))
            .when(F.col("txn_type") == "E", F.concat(F.date_format(day, "M"), F.lit("/32/"), F.date_format(day, "yyyy")))
            .otherwise(F.date_format(day, "M/d/yy")))
    return transactions(spark, d).select("id", dates.lenient_us_date(text).alias("parsed"))


@query("x17_office_name", """select doc_id, case when filing_date is not null then custkey || ' ' || given else first end as first,
    case when filing_date is not null then replace(last, ',', '') else last end as last from filers""", ("filers",))
def x17(spark, d):
    from .adapters import filers
    given = F.concat(F.col("custkey").cast("string"), F.lit(" "), "given")
    family = F.regexp_replace("last", ",", "")
    office = F.when(F.col("filing_date").isNotNull(), F.concat(F.lit(" "), family, F.lit(" , "), given, F.lit(" (Senator)"))
                    ).otherwise("Senator")
    rows = filers(spark, d).withColumn("n", documents.office_name(office, F.col("first"), F.col("last")))
    return rows.select("doc_id", "n.first", "n.last")


@query("x18_former_senator", "select doc_id, office = 'Name (Former Senator)' as former from filers", ("filers",))
def x18(spark, d):
    from .adapters import filers
    return filers(spark, d).select("doc_id", documents.is_former_senator(F.col("office")).alias("former"))


@query("x19_senate_txn_code", "select id, txn_type as code from transactions union all select id, null from filings", FT)
def x19(spark, d):
    label = (F.when(F.col("txn_type") == "P", " Purchase").when(F.col("txn_type") == "S", "SALE (full)")
             .when(F.col("txn_type") == "E", "exchange ").otherwise("Sale (Partial)"))
    t = transactions(spark, d).select("id", documents.senate_txn_code(label).alias("code"))
    return t.unionByName(filings(spark, d).select("id", documents.senate_txn_code(F.col("doc_kind")).alias("code")))


@query("x20_senate_amount", """select id, amount_min, case when amount_min % 2 = 0 then amount_max end as amount_max from transactions
    union all select id, null, null from filings""", FT)
def x20_senate(spark, d):
    low, high = F.col("amount_min"), F.col("amount_max")
    cell = F.when((low % 2 == 0) & high.isNotNull(), F.concat(labels.dollars(high), F.lit(" - "), labels.dollars(low))).otherwise(
        F.concat(F.lit("OVER "), labels.dollars(low)))
    t = transactions(spark, d).withColumn("a", documents.senate_amount(cell)).select("id", "a.amount_min", "a.amount_max")
    f = filings(spark, d).withColumn("a", documents.senate_amount(F.col("pdf_url")))
    return t.unionByName(f.select("id", "a.amount_min", "a.amount_max"))


@query("x20_house_amount", """select id, amount_min, coalesce(amount_max, amount_min) as amount_max from transactions""", ("transactions",))
def x20_house(spark, d):
    low, high = F.col("amount_min"), F.col("amount_max")
    cell = F.when(high.isNotNull(), F.concat(labels.dollars(low), F.lit(" -\n"), labels.dollars(high))).otherwise(
        F.concat(labels.dollars(low), F.lit(".75")))
    return transactions(spark, d).withColumn("a", documents.house_amount(cell)).select("id", "a.amount_min", "a.amount_max")


@query("x21_normalize_text", """select doc_id, array_to_string([trim(regexp_replace(l, '\\s+', ' ', 'g'))
    for l in string_split(replace(text, chr(0), ''), chr(10))], chr(10)) as text from documents""")
def x21(spark, d):
    return table(spark, d, "documents").select("doc_id", report_text.normalize_text(F.col("text")).alias("text"))


HEADER_TEXT_SQL = "select id, doc_id as filing_id, 'Hon. ' || last_name as name, ' Member' as status, ' ' || state_district as state_district from filings"


@query("x22_header_fields", HEADER_TEXT_SQL, ("filings",))
def x22(spark, d):
    # the late Name line lies beyond the first 20 lines and must not count
    text = F.concat(F.lit("Clerk\nfiling id #old\nFiling Id # "), "doc_id", F.lit(" \nNAME:Hon. "), "last_name",
                    F.lit("\nStatus: Member\nstate/district: "), "state_district", F.repeat(F.lit("\nx"), 20),
                    F.lit("\nName: nobody"))
    return filings(spark, d).withColumn("h", report_text.header_fields(text)).select(
        "id", "h.filing_id", "h.name", "h.status", "h.state_district")


@query("x23_source_id_owner", """select id, txn_source_id as source_id, case when owner_token <> 'Self' then owner_token end as owner
    from transactions""", ("transactions",))
def x23(spark, d):
    line = F.concat_ws(" ", "txn_source_id", F.lower("owner_token"), F.lit("Asset 12345678 SP"))
    return transactions(spark, d).select("id", report_text.source_id(line).alias("source_id"),
                                         report_text.owner_token(line).alias("owner"))


@query("x24_asset_type_code", """select id, case when length(asset_type_code) = 2 then asset_type_code
    when asset_type_code is not null then 'AB' end as code from transactions""", ("transactions",))
def x24(spark, d):
    code = F.col("asset_type_code")
    line = F.when(code.isNotNull(), F.concat(F.lit("x [ab] y ["), F.lower(code), F.lit("] z [toolong]"))).otherwise("none []")
    return transactions(spark, d).select("id", report_text.asset_type_code(line).alias("code"))


@query("x25_ticker", "select id, case when ticker <> '--' then ticker end as ticker from transactions", ("transactions",))
def x25(spark, d):
    line = F.concat(F.lit("Sale ( Partial ) of "), F.coalesce("amount_raw", F.lit("")),
                    F.coalesce(F.concat(F.lit(" ("), "ticker", F.lit(") (ZZZ)")), F.lit(" (a b)")))
    line = F.when(F.col("ticker") == "--", "(--)").otherwise(line)
    return transactions(spark, d).select("id", report_text.ticker(line).alias("ticker"))


@query("x26_spine", "select id, txn_type, txn_date, notification_date from transactions", ("transactions",))
def x26(spark, d):
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    line = F.concat(F.lit("Asset S 1 E "), "txn_type", F.lit("  "), us("txn_date"), F.lit("\n"), us("notification_date"), F.lit(" $1"))
    rows = transactions(spark, d).withColumn("s", report_text.spine(line))
    return rows.select("id", "s.txn_type", report_text.strict_report_date(F.col("s.first_date")).alias("txn_date"),
                       report_text.strict_report_date(F.col("s.second_date")).alias("notification_date"))


@query("x27_fold_name", """select doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), '’', ''''), '\\s+', ' ', 'g')) as folded
    from documents""")
def x27(spark, d):
    return table(spark, d, "documents").select("doc_id", names.fold_name(F.col("text")).alias("folded"))


@query("x28_given_tokens", """select bioguide_id, case when given_name <> first_name then 'j,' else '' end || lower(first_name) as tokens
    from members""", ("members",))
def x28(spark, d):
    full = F.concat(F.col("given_name"), F.lit(" "), F.col("first_name"), F.lit(", Jr."))
    return members(spark, d).select("bioguide_id", F.array_join(names.given_tokens(names.fold_name(full)), ",").alias("tokens"))


@query("x29_primary_token", """select bioguide_id, case when given_name <> first_name then 'j' else lower(first_name) end as token
    from members""", ("members",))
def x29(spark, d):
    return members(spark, d).select("bioguide_id", names.primary_token(names.fold_name(F.col("given_name"))).alias("token"))


NICK_SQL = """nick as (select * from (values ('james', 'jim'), ('william', 'bill'), ('robert', 'bob'), ('michael', 'mike'),
    ('andrew', 'drew'), ('stephen', 'steve'), ('theodore', 'ted'), ('edward', 'ted')) v(formal, short))"""


# every pair of the nickname relation in turn, with a short form that is its own or the next pair's
RELATION = [(formal, short) for formal, shorts in fv.NICKNAMES.items() for short in shorts]
RELATION_SQL = "relation as (select * from (values " + ", ".join(
    f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(RELATION)) + ") v(i, formal, short))"


@query("x30_all_nicknames", f"""with {RELATION_SQL},
    asked as (select c_custkey, a.formal, b.short from customer
      join relation a on a.i = c_custkey % {len(RELATION)} join relation b on b.i = (c_custkey + case when c_custkey % 2 = 0 then 1 else 0 end) % {len(RELATION)})
    select c_custkey, formal, short, formal = short or exists (select 1 from relation r
      where (r.formal = a.formal and r.short = a.short) or (r.formal = a.short and r.short = a.formal)) as agree from asked a""")
def x30_all(spark, d):
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(RELATION)).cast("int") + 1)
    key = F.col("c_custkey")
    asked = table(spark, d, "customer").select(
        "c_custkey", at([a for a, _ in RELATION], key).alias("formal"),
        at([b for _, b in RELATION], key + F.when(key % 2 == 0, 1).otherwise(0)).alias("short"))
    # asked both ways round: a filer may use either form
    one = names.given_names_agree(F.col("short"), F.col("formal"), F.lit(""))
    other = names.given_names_agree(F.col("formal"), F.col("short"), F.lit(""))
    return asked.select("c_custkey", "formal", "short", F.when(key % 2 == 0, one).otherwise(other).alias("agree"))


@query("x30_given_names_agree", f"""with {NICK_SQL}
    select f.doc_id, lower(f.given) = lower(m.first_name) or exists (select 1 from nick n
      where n.formal = lower(m.first_name) and n.short = lower(f.given)) as agree
    from filers f join members m on m.bioguide_id = 'C' || lpad(cast(1 + f.custkey - f.custkey % 2 as varchar), 9, '0')""",
       ("filers", "members"))
def x30(spark, d):
    from .adapters import filers
    f = filers(spark, d)
    partner = F.concat(F.lit("C"), F.lpad((1 + F.col("custkey") - F.col("custkey") % 2).cast("string"), 9, "0"))
    m = members(spark, d).select("bioguide_id", "first_name", "given_name")
    pairs = f.withColumn("bioguide_id", partner).join(m, "bioguide_id")
    fold = lambda c: names.fold_name(F.col(c))
    return pairs.select("doc_id", names.given_names_agree(fold("first"), fold("first_name"), fold("given_name")).alias("agree"))


@query("x36_house_surname", """select doc_id, strip_accents(lower(case when contains(last, 'MD.') then string_split(last, ',')[1] else last end)) as surname
    from filers""", ("filers",))
def x36(spark, d):
    from .adapters import filers
    md = F.regexp_replace("last", r", MD\.", ", MD., FACS;")
    return filers(spark, d).select("doc_id", names.house_surname(names.fold_name(md)).alias("surname"))


@query("x37_senate_surname", "select doc_id, strip_accents(lower(replace(last, ' II', ''))) as surname from filers", ("filers",))
def x37(spark, d):
    from .adapters import filers
    return filers(spark, d).select("doc_id", names.senate_surname(names.fold_name(F.col("last"))).alias("surname"))
