"""Ingestion jobs, idempotent stores and streams over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.identity import person_key
from ..operators import joins, store
from ..plans import burst_log, curate, ingest, recompute, report_html, report_text
from ..session import scratch_path, working_table
from ..sources import documents, manifest, stored_keys, tables
from ..streaming import bursts, ingest as stream_ingest
from . import adapters, landing
from .adapters import filings, transactions
from .q_signals import sql_key
from .registry import query

FT = ("filings", "transactions")
RUN_DAY = dt.date(2000, 6, 30)

DOC = """case when doc_kind = 'scanned' and source = 'senate_efd' then concat('77', doc_id)
    when doc_kind = 'scanned' then lpad(doc_id, 7, '0') when source = 'senate_efd' then concat('a', doc_id, '-b7')
    else concat('2000000', doc_id) end"""


def index(spark, d):
    """Listing rows; some documents are listed twice."""
    copies = F.when(F.col("amends_filing_id").isNotNull(), 2).otherwise(1)
    return filings(spark, d).select(
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"), "source", F.expr(DOC).alias("doc_id"), "year", "filing_date",
        F.coalesce("prefix", F.lit("")).alias("prefix"), F.col("first_name").alias("first"), F.col("last_name").alias("last"),
        F.coalesce("suffix", F.lit("")).alias("suffix"), "state_district").drop("_copy")


CHANGED, REPEATED = "id % 7 = 0", "id % 5 = 0"
ARRIVED = "not (coalesce(suffix, '') = 'Jr.' and year = 1998)"


def landed(spark, d):
    """One document per filing unless it never arrived; some are blank, some hold an impossible date or type."""
    f = filings(spark, d, deal=True).filter(ARRIVED).withColumn("doc", F.expr(DOC))
    day = landing.us("created_at")
    shown = F.when(F.col("id") % 41 == 0, F.lit("02/30/2020")).otherwise(day)
    house = landing.text(landing.TABLE_HEAD, "SP ", F.col("last_name"), " (Q1) [ST] P ", shown, " ", day, " $1,001 - $15,000\nF S: New\n",
                         "Second asset [GS] S ", day, " ", day, " $15,001 -\n$50,000\n")
    label = F.when(F.col("id") % 41 == 0, "Barter").otherwise("Purchase")
    senate = landing.text("<table><tr>", *[landing.text("<td>", c, "</td>") for c in (
        "1", day, "Self", "Q2", F.col("last_name"), "Stock", label, "Over $1,000", "--")], "</tr></table>")
    body = F.when(F.col("id") % 37 == 0, F.lit(" \n")).when(F.col("source") == "senate_efd", senate).otherwise(house)
    # some are landed again in other words, some with the same ones; the first by path counts, wherever its row is
    first = F.struct(body.alias("body"), F.concat(F.lit("a/"), "doc", F.lit(".txt")).alias("path"))
    other = F.struct(F.regexp_replace("first.body", r"\[ST\]|Stock", "[OP]").alias("body"), F.concat(F.lit("b/"), "doc", F.lit(".html")).alias("path"))
    again = F.struct(F.col("first.body").alias("body"), F.concat(F.lit("c/"), "doc", F.lit(".txt")).alias("path"))
    versions = F.array_compact(F.array(F.when(F.expr(CHANGED), other), F.when(F.expr(REPEATED), again), F.when(F.expr(REPEATED), F.col("first")), F.col("first")))
    return f.withColumn("first", first).select(F.col("doc").alias("doc_id"), F.inline(versions))


def parse(docs):
    house = report_text.parse_text(docs.filter("source = 'house_clerk'").select("doc_id", "body"))
    senate = report_html.parse_html(docs.filter("source = 'senate_efd'").select("doc_id", "body"))
    return house.unionByName(senate)


def known(spark, d):
    return filings(spark, d).filter("year = 1997").select(F.expr(DOC).alias("doc_id"))


def run_parts(spark, d):
    return index(spark, d), landed(spark, d), parse, known(spark, d)


def work(spark):
    return scratch_path(spark, "ingest")


# a House page without text is a scan; a Senate page without rows is a filing without lines
OUTCOME_SQL = f"""with listed as (select *, {DOC} as doc, case when amends_filing_id is not null then 2 else 1 end as copies from filings),
    judged as (select id, doc, source, year, cast(copies as bigint) as copies, filing_date, cast(created_at as date) as day, last_name,
        case when id % 37 = 0 then 0 when source = 'senate_efd' then 1 else 2 end as lines, not (coalesce(suffix, '') = 'Jr.' and year = 1998) as present,
        not (coalesce(suffix, '') = 'Jr.' and year = 1998) and year <> 1997
          and not regexp_full_match(doc, case source when 'senate_efd' then '[0-9]+' else '[0-9]{{7}}' end) as arrived,
        case when regexp_full_match(doc, case source when 'senate_efd' then '[0-9]+' else '[0-9]{{7}}' end) then 'scanned_skipped'
          when year = 1997 then 'skipped' when suffix = 'Jr.' and year = 1998 then 'download_failed'
          when id % 37 = 0 and source <> 'senate_efd' then 'scanned_skipped'
          when id % 41 = 0 and id % 37 <> 0 then 'parse_failed'
          when source = 'senate_efd' and filing_date is null and id % 37 <> 0 then 'store_failed' else 'new' end as outcome
      from listed)"""


@query("a10_ingest_outcomes", OUTCOME_SQL + """ select doc as doc_id, source, year, copies, outcome,
    case outcome when 'download_failed' then 'no landed document' when 'parse_failed' then 'unreadable trade line'
      when 'store_failed' then 'no notification date' end as error,
    id % 7 = 0 and id % 37 <> 0 and arrived as conflict from judged""", ("filings",))
def a10(spark, d):
    listed, docs, reader, stored = run_parts(spark, d)
    return ingest.decide(listed, docs, reader, stored, work(spark)).outcomes.select("doc_id", "source", "year", "copies", "outcome", "error", "conflict")


@query("s10_landed_versions", OUTCOME_SQL + """ select doc as doc_id, 'a/' || doc || '.txt' as path, lines > 0 as has_text,
    cast(1 + case when id % 7 = 0 then 1 else 0 end + case when id % 5 = 0 then 2 else 0 end as bigint) as landed, id % 7 = 0 and id % 37 <> 0 as conflict
    from judged where present""", ("filings",))
def s10_versions(spark, d):
    """The version of every landed document that counts, and whether there are others."""
    first = documents.first_landed(landed(spark, d))
    return first.select("doc_id", "path", F.col("body").rlike(r"\S").alias("has_text"), "landed", "conflict")


ACCOUNT_SQL = """, counted as (select source, year, cast(sum(copies) as bigint) as filings_indexed,
    cast(count(*) filter (where outcome = 'new') as bigint) as filings_new,
    cast(coalesce(sum(copies) filter (where outcome = 'skipped'), 0) + coalesce(sum(copies - 1) filter (where outcome = 'new'), 0) as bigint) as filings_skipped,
    cast(coalesce(sum(copies) filter (where outcome = 'scanned_skipped'), 0) as bigint) as scanned_skipped,
    cast(coalesce(sum(copies) filter (where outcome = 'download_failed'), 0) as bigint) as download_failed,
    cast(coalesce(sum(copies) filter (where outcome = 'parse_failed'), 0) as bigint) as parse_failed,
    cast(coalesce(sum(lines) filter (where outcome = 'new'), 0) as bigint) as transactions_stored,
    case when count(*) filter (where outcome in ('download_failed', 'parse_failed', 'store_failed')) > 0 then 'partial' else 'success' end as status,
    'store_failures=' || cast(nullif(coalesce(sum(copies) filter (where outcome = 'store_failed'), 0), 0) as varchar) as error
    from judged {where} group by source, year)
    select * from counted
    union all select t.source, t.year, 0, 0, 0, 0, 0, 0, 0, 'success', null from targets t
      where not exists (select 1 from counted c where c.source = t.source and c.year = t.year)
    union all select 'house_clerk', 2003, 0, 0, 0, 0, 0, 0, 0, 'failed', 'failed to fetch 2003 index: no archive'"""
TARGET_SQL = """, targets as (select s.source, cast(y.year as integer) as year from (select 'house_clerk' as source union all select 'senate_efd') s,
    (select unnest(range({low}, {high} + 1)) as year) y where not (s.source = 'house_clerk' and y.year = 2003))"""


def targets(spark, years):
    return spark.createDataFrame([(s, y) for s in ("house_clerk", "senate_efd") for y in years], "source string, year int")


def failures(spark):
    return spark.createDataFrame([("house_clerk", 2003, "no archive")], "source string, year int, message string")


@query("k2_run_accounting", OUTCOME_SQL + TARGET_SQL.format(low=1990, high=2003) + ACCOUNT_SQL.format(where=""), ("filings",))
def k2(spark, d):
    listed, docs, reader, stored = run_parts(spark, d)
    judged, parsed = ingest.decide(listed, docs, reader, stored, work(spark))
    return ingest.run_account(judged, listed, parsed, targets(spark, range(1990, 2004)), failures(spark))


LINES_SQL = """, flagged as (select *, coalesce(day > filing_date, false) as late from judged where outcome = 'new' and lines > 0),
    stored as (select doc as doc_id, cast(0 as int) as sequence, last_name || case source when 'senate_efd' then '' else ' (Q1)' end as asset_name,
      case source when 'senate_efd' then 'Q2' else 'Q1' end as ticker, 'P' as txn_type, day as txn_date,
      case source when 'senate_efd' then filing_date else day end as notification_date,
      cast(case source when 'senate_efd' then 1000 else 1001 end as bigint) as amount_min,
      cast(case source when 'senate_efd' then null else 15000 end as bigint) as amount_max,
      array_to_string([x for x in [case when late then 'transaction_date_after_filing' end,
        case when day > date '2000-06-30' then 'transaction_date_after_ingestion_date' end,
        case when late and source <> 'senate_efd' then 'notification_date_after_filing' end] if x is not null], ',') as quality_flags from flagged
    union all select doc, 1, 'Second asset', null, 'S', day, day, 15001, 50000,
      array_to_string([x for x in [case when late then 'transaction_date_after_filing' end,
        case when day > date '2000-06-30' then 'transaction_date_after_ingestion_date' end,
        case when late then 'notification_date_after_filing' end] if x is not null], ',') from flagged where source <> 'senate_efd')"""
LINE_COLUMNS = ("doc_id", "sequence", "asset_name", "ticker", "txn_type", "txn_date", "notification_date", "amount_min", "amount_max")


def flat(lines, filed):
    doc = filed.select("doc_id", F.col("id").alias("filing_id"))
    return lines.join(doc, "filing_id").select(*LINE_COLUMNS, F.array_join("quality_flags", ",").alias("quality_flags"))


@query("c17_ingested_lines", OUTCOME_SQL + LINES_SQL + " select * from stored", ("filings",))
def c17(spark, d):
    listed, docs, reader, stored = run_parts(spark, d)
    done = ingest.ingest(listed, docs, reader, stored, RUN_DAY, work(spark))
    return flat(done.lines, done.filings)


@query("c17_repeated_run", OUTCOME_SQL.replace("when year = 1997 then 'skipped' ", "") + LINES_SQL + """ select s.*, cast(1 as bigint) as runs from stored s""",
       ("filings",))
def c17_repeated(spark, d):
    """A run into the store, the same batch again, and a further run that finds nothing new: the lines are those of the first."""
    root = scratch_path(spark, "run")
    listed, docs, reader, _ = run_parts(spark, d)
    for batch in (0, 0, 1):
        ingest.run(spark, root, listed, docs, reader, RUN_DAY, batch_no=batch)
    lines, filed = (tables.read_batches(spark, root, n, s) for n, s in (("transactions", schema.TRANSACTIONS), ("filings", schema.FILINGS)))
    runs = lines.groupBy("filing_id", "sequence").agg(F.count(F.lit(1)).alias("runs"))
    return flat(lines.join(runs, ["filing_id", "sequence"]).select(*schema.TRANSACTIONS.names, "runs"), filed).join(
        filed.select("doc_id", F.col("id").alias("filing_id")).join(runs, "filing_id").select("doc_id", "sequence", "runs"), ["doc_id", "sequence"])


@query("c18_backfill_years", OUTCOME_SQL + TARGET_SQL.format(low=1996, high=2003) + ACCOUNT_SQL.format(where="where year >= 1996 and filing_date >= date '1999-03-01'").replace(
    "cast(sum(copies) as bigint) as filings_indexed", "(select cast(sum(j.copies) as bigint) from judged j where j.source = judged.source and j.year = judged.year) as filings_indexed").replace(
    "select t.source, t.year, 0, 0,", "select t.source, t.year, coalesce((select cast(sum(j.copies) as bigint) from judged j where j.source = t.source and j.year = t.year), 0), 0,"),
       ("filings",))
def c18(spark, d):
    listed, docs, reader, stored = run_parts(spark, d)
    years = ingest.target_years(None, True, 1996, 2003)
    wanted = listed.filter(F.col("year").isin(years))
    judged, parsed = ingest.decide(wanted, docs, reader, stored, work(spark), since="1999-03-01")
    return ingest.run_account(judged, wanted, parsed, targets(spark, years), failures(spark))


# --- idempotent store -------------------------------------------------------------

LINE = T.StructType([schema.TRANSACTIONS[c] for c in ("sequence", "asset_name", "txn_type", "txn_date", "notification_date",
                                                      "amount_min", "amount_max", "amount_raw", "quality_flags")])


def reports(spark, d):
    """Filings with their lines as an array; each order is one report of two lines."""
    f = filings(spark, d)
    day = F.to_date("created_at")
    line = lambda n, low: F.struct(
        F.lit(n).alias("sequence"), F.col("last_name").alias("asset_name"), F.lit("P").alias("txn_type"), day.alias("txn_date"),
        day.alias("notification_date"), F.lit(low).cast("long").alias("amount_min"), F.lit(None).cast("long").alias("amount_max"),
        F.lit("Over").alias("amount_raw"), F.array().cast("array<string>").alias("quality_flags"))
    named = ["doc_id", "year", "prefix", "first_name", "last_name", "suffix", "state_district", "filing_date", "doc_kind", "pdf_url",
             "source"]
    return f.select(*named, F.lit(1).alias("version"), F.array(line(0, 100), line(1, 250)).alias("lines"))


STORED_SQL = """select doc_id, first_name, nullif(suffix, '') as suffix, cast(2 as bigint) as line_count, cast(350 as bigint) as total_min,
    true as sound from filings"""


def stored_reports(spark, root):
    """Stored filings with their lines; ``sound`` says ids are unique and every line has a filing."""
    f = tables.read_table(spark, root, "filings", schema.FILINGS)
    t = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS)
    per = t.groupBy("filing_id").agg(F.count(F.lit(1)).alias("line_count"), F.sum("amount_min").alias("total_min"),
                                     F.count_if(F.col("id").isNull()).alias("_no_id"))
    same_id = f.groupBy("id").agg(F.count(F.lit(1)).alias("_same"))
    return (f.join(per, f["id"] == per["filing_id"]).join(same_id, "id")
            .select("doc_id", "first_name", "suffix", "line_count", "total_min",
                    ((F.col("_same") == 1) & (F.col("_no_id") == 0)).alias("sound")))


@query("k1_idempotent_store", STORED_SQL, ("filings",))
def k1(spark, d):
    root = scratch_path(spark, "store")
    rows = reports(spark, d)
    altered = rows.withColumn("first_name", F.lit("later copy")).withColumn("version", F.lit(2))
    batches = (rows.filter("source = 'senate_efd'"), rows.unionByName(altered), altered)
    for number, batch in enumerate(batches):
        lines = batch.select("doc_id", "version", F.inline("lines"))
        store.store(spark, root, batch.drop("lines"), lines, number, ["version"])
    return stored_reports(spark, root)


@query("k3_store_refresh", """with lines as (select doc_id, cast(0 as int) as sequence, cast(created_at as date) as day, false as late from filings
      union all select doc_id, 1, cast(created_at as date), filing_date is not null from filings)
    select doc_id, sequence, array_to_string([x for x in [case when day > date '2000-06-30' then 'transaction_date_after_ingestion_date' end,
      case when late then 'notification_date_after_filing' end] if x is not null], ',') as quality_flags, cast(1 as bigint) as version from lines""", ("filings",))
def k3_refresh(spark, d):
    """Lines stored without flags, recomputed, written as new versions of their batches and read back."""
    root = scratch_path(spark, "refresh")
    store_in_two(spark, d, root)
    recompute.recompute(spark, root, RUN_DAY)
    lines = tables.read_batches(spark, root, "transactions", schema.TRANSACTIONS)
    docs = tables.read_table(spark, root, "filings", schema.FILINGS).select(F.col("id").alias("filing_id"), "doc_id")
    return lines.join(docs, "filing_id").select("doc_id", "sequence", F.array_join("quality_flags", ",").alias("quality_flags"), "version")


PATCH_SQL = """with lines as (select doc_id, cast(0 as int) as sequence, cast(created_at as date) as day, false as late, id from filings
      union all select doc_id, 1, cast(created_at as date), filing_date is not null, id from filings)
    select doc_id, sequence, array_to_string([x for x in [case when day > date '2000-06-30' then 'transaction_date_after_ingestion_date' end,
        case when late then 'notification_date_after_filing' end] if x is not null], ',') as quality_flags,
      case when sequence = 0 and id % 9 = 0 and id % 18 <> 0 then day - 1 end as verified_transaction_date,
      case when sequence = 0 and id % 9 = 0 and id % 18 <> 0 then 'high' end as verification_confidence,
      cast({version} as bigint) as version from lines"""


def store_in_two(spark, d, root):
    """All reports stored without flags, the notices of some lines late."""
    noted = reports(spark, d).withColumn("lines", F.transform("lines", lambda x: x.withField(
        "notification_date", F.date_add(x["notification_date"], x["sequence"] * 3))))
    for number, batch in enumerate((noted.filter("source = 'senate_efd'"), noted.filter("source <> 'senate_efd'"))):
        store.store(spark, root, batch.drop("lines"), batch.select("doc_id", "version", F.inline("lines")), number, ["version"])


def patched(spark, d, root):
    """Flags recomputed and some first lines verified, a part of these cleared again; three patches and no batch written anew."""
    store_in_two(spark, d, root)
    recompute.recompute(spark, root, RUN_DAY, rewrite=False)
    chosen = filings(spark, d).filter("id % 9 = 0")
    decision = lambda frame, action: frame.select(
        F.col("id").alias("decision_no"), F.lit(action).alias("action"), F.lit(None).cast("long").alias("transaction_id"), "doc_id", F.lit(0).alias("sequence"),
        F.date_sub(F.to_date("created_at"), 1).alias("verified_transaction_date"), F.lit("manual_review").alias("method"), F.lit("high").alias("confidence"),
        F.lit("seen").alias("source_doc_id"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("timestamp").alias("verified_at"))
    curate.store_verifications(spark, root, decision(chosen, "verify"))
    curate.store_verifications(spark, root, decision(chosen.filter("id % 18 = 0"), "clear"))


def patched_lines(spark, root):
    lines = tables.read_batches(spark, root, "transactions", schema.TRANSACTIONS)
    docs = tables.read_table(spark, root, "filings", schema.FILINGS).select(F.col("id").alias("filing_id"), "doc_id")
    return lines.join(docs, "filing_id").select("doc_id", "sequence", F.array_join("quality_flags", ",").alias("quality_flags"),
                                                "verified_transaction_date", "verification_confidence", "version")


@query("k3_patch_read", PATCH_SQL.format(version=0), ("filings",))
def k3_patch(spark, d):
    """Changed lines stored as patches beside their batches and laid over them when read."""
    root = scratch_path(spark, "patch")
    patched(spark, d, root)
    return patched_lines(spark, root)


@query("k3_patch_compacted", PATCH_SQL.format(version=4), ("filings",))
def k3_compacted(spark, d):
    """The same lines once the patches are folded into new versions of their batches."""
    root = scratch_path(spark, "compact")
    patched(spark, d, root)
    tables.compact(spark, root, "transactions", schema.TRANSACTIONS)
    return patched_lines(spark, root)


@query("t1_ingest_stream", STORED_SQL, ("filings",))
def t1(spark, d):
    rows = reports(spark, d)
    altered = rows.withColumn("first_name", F.lit("later copy")).withColumn("version", F.lit(2))
    landed_path = landing.land_parquet(rows.unionByName(altered), "reports")
    root, checkpoint = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-checkpoint")
    # a second stream without the first one's checkpoint replays everything
    for attempt in range(2):
        stream = stream_ingest.stream_reports(spark, landed_path, rows.schema)
        done = stream_ingest.ingest_stream(stream, root, f"{checkpoint}-{attempt}", ["version"], first_batch=attempt * 1000)
        done.awaitTermination()
    return stored_reports(spark, root)


# --- scans by manifest and key folders ------------------------------------------------

def laid_out_store(spark, d, label):
    """Filings and lines of the given tables, stored in two batches with manifests and key folders."""
    root = scratch_path(spark, label)
    filing, line = adapters.shown(adapters.FILINGS), adapters.shown(adapters.TRANSACTIONS)
    # the given columns are joined once for both batches; the columns of the stored tables, several times as wide, are worked out as they are written
    filed = working_table(adapters.filing_sources(spark, d).withColumn("senate", F.expr(filing["source"]) == "senate_efd"), "filed")
    senate = filed.filter("senate").select(F.expr(filing["id"]).alias("senate_id")).distinct()
    given = adapters.table(spark, d, "lineitem").select(*adapters.TRANSACTIONS_OF)
    marked = given.join(senate, F.expr(line["filing_id"]) == F.col("senate_id"), "left").withColumn("senate", F.col("senate_id").isNotNull()).drop("senate_id")
    part = adapters.table(spark, d, "part").select("p_partkey", "p_name")
    lines = working_table(marked.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey"), "lines")
    for number, of in enumerate(("senate", "not senate")):
        f, t = filed.filter(of).drop("senate"), lines.filter(of).drop("senate")
        tables.write_batch(spark, root, number, {stored_keys.NAME: "key_bucket"}, lambda name: name in manifest.LAYOUT and manifest.write(spark, root, name, number),
                           filings=store.fit(manifest.laid_out(f, "filings", filing), schema.FILINGS),
                           transactions=store.fit(manifest.laid_out(t, "transactions", line), schema.TRANSACTIONS),
                           **{stored_keys.NAME: stored_keys.of(f.select(F.expr(filing["doc_id"]).alias("doc_id")))})
    return root


TICKERS, SCAN_DOCS = ("P1", "P149", "P300", "P1501", "none"), ("1", "7", "32", "4999", "14000", "no such")


@query("s9_pruned_scan", f"""select id, ticker, txn_date, amount_min, asset_name from transactions
    where ticker in {TICKERS} and txn_date >= date '1994-01-01' and txn_date < date '1997-07-01'""", ("transactions",))
def s9_scan(spark, d):
    """Lines of some tickers and days from the files that can hold them."""
    root = laid_out_store(spark, d, "pruned")
    found = manifest.pruned(spark, root, "transactions", schema.TRANSACTIONS, {"txn_date": ("1994-01-01", "1997-06-30")}, {"ticker": list(TICKERS)})
    return found.filter(F.col("ticker").isin(*TICKERS) & (F.col("txn_date") >= "1994-01-01") & (F.col("txn_date") < "1997-07-01")).select(
        "id", "ticker", "txn_date", "amount_min", "asset_name")


@query("s9_pruned_documents", f"""select f.doc_id, f.filing_date, t.id, t.sequence from filings f join transactions t on t.filing_id = f.id
    where f.doc_id in {SCAN_DOCS}""", FT)
def s9_documents(spark, d):
    """Chosen documents with their lines: the manifest finds the filings by id, and their lines by the ids of the filings."""
    root = laid_out_store(spark, d, "documents")
    chosen = manifest.pruned(spark, root, "filings", schema.FILINGS, keys={"doc_id": list(SCAN_DOCS)}).filter(F.col("doc_id").isin(*SCAN_DOCS))
    ids = [r["id"] for r in chosen.select("id").collect()]  # at most as many as were asked for
    lines = manifest.pruned(spark, root, "transactions", schema.TRANSACTIONS, keys={"filing_id": ids or [-1]})
    return lines.join(chosen.select(F.col("id").alias("filing_id"), "doc_id", "filing_date"), "filing_id").select("doc_id", "filing_date", "id", "sequence")


@query("j10_stored_keys", """select doc_id, true as stored from filings where doc_kind = 'efiled'
    union all select 'new-' || doc_id, false from filings where doc_kind = 'efiled'""", ("filings",))
def j10_keys(spark, d):
    """Which of many documents are stored, asked in the key folders of two batches, one of them merged into a generation."""
    root = laid_out_store(spark, d, "keys")
    stored_keys.merge(spark, root)
    known = filings(spark, d).filter("doc_kind = 'efiled'").select("doc_id")
    asked = known.unionByName(known.select(F.concat(F.lit("new-"), "doc_id").alias("doc_id")))
    found = stored_keys.stored_among(spark, root, asked, schema.FILINGS).withColumn("stored", F.lit(True))
    return asked.join(found, "doc_id", "left").select("doc_id", F.coalesce("stored", F.lit(False)).alias("stored"))


# --- burst streams -------------------------------------------------------------------

TRADE = T.StructType([T.StructField("txn_type", T.StringType()), T.StructField("ticker", T.StringType()),
                      T.StructField("txn_time", T.TimestampType()), T.StructField("person_key", T.StringType())])


def trades(spark, d):
    t, f = transactions(spark, d).filter("ticker is not null"), filings(spark, d)
    who = person_key(F.col("state_district"), F.col("first_name"), F.col("last_name"))
    return joins.lines(t, f).select("txn_type", "ticker", F.col("txn_date").cast("timestamp").alias("txn_time"), who.alias("person_key"))


def run_bursts(spark, source, checkpoint, out):
    stream = spark.readStream.schema(TRADE).parquet(source)
    bursts.write_closed_bursts(stream, out, checkpoint).awaitTermination()


BURSTS_SQL = f"""with trades as (select txn_type, ticker, txn_date, {sql_key()} as person_key from transactions t join filings f on f.id = t.filing_id
      where ticker is not null {{keep}}),
    stepped as (select *, case when txn_date - lag(txn_date) over (partition by txn_type, ticker order by txn_date) <= 7 then 0 else 1 end as opens from trades),
    numbered as (select *, sum(opens) over (partition by txn_type, ticker order by txn_date) as burst_id from stepped),
    found as (select txn_type, ticker, min(txn_date) as start_date, max(txn_date) as end_date,
      cast(max(txn_date) - min(txn_date) as int) as span_days, cast(count(*) as bigint) as transaction_count,
      cast(count(distinct person_key) as bigint) as politician_count from numbered group by txn_type, ticker, burst_id)
    select * from found where end_date + 7 <= (select max(txn_date) - 45 from transactions where ticker is not null)"""


@query("t2_burst_stream", BURSTS_SQL.format(keep=""), FT)
def t2(spark, d):
    source = landing.land_parquet(trades(spark, d), "trades")
    out = scratch_path(spark, "bursts")
    run_bursts(spark, source, scratch_path(spark, "bursts-checkpoint"), out)
    return bursts.with_people(spark.read.parquet(out), spark.read.schema(TRADE).parquet(source))


ALL_BURSTS_SQL = BURSTS_SQL.format(keep="").rpartition(" where end_date")[0]


@query("c1_incremental", ALL_BURSTS_SQL, FT)
def c1_incremental(spark, d):
    """Bursts kept up to date over three batches of trades, the earliest days last."""
    root = scratch_path(spark, "burst-log")
    rows = trades(spark, d).withColumn("txn_date", F.to_date("txn_time"))
    parts = (F.col("txn_date") >= "1996-01-01", (F.col("txn_date") < "1996-01-01") & (F.col("txn_date") >= "1993-01-01"), F.col("txn_date") < "1993-01-01")
    for number, part in enumerate(parts):
        burst_log.add_trades(spark, root, rows.filter(part), number)
    return burst_log.current(spark, root).drop("revision")


@query("t3_corrections", ALL_BURSTS_SQL, FT)
def t3_corrections(spark, d):
    """Exchanges arrive after everything else, most of them behind any watermark; the log ends as a job over all trades would."""
    rows = trades(spark, d)
    root, source, checkpoint = (scratch_path(spark, n) for n in ("corrected-log", "corrected-trades", "corrected-checkpoint"))
    for part in (F.col("txn_type") != "E", F.col("txn_type") == "E"):
        rows.filter(part).write.mode("append").parquet(source)
        bursts.log_bursts(spark.readStream.schema(TRADE).parquet(source), root, checkpoint).awaitTermination()
    return burst_log.current(spark, root).drop("revision")


LATE_SQL = "and (txn_type <> 'E' or txn_date + 7 > (select max(txn_date) - 45 from transactions where ticker is not null and txn_type <> 'E' and txn_date <= date '2000-01-01'))"


@query("t3_late_trades", BURSTS_SQL.format(keep=LATE_SQL), FT)
def t3(spark, d):
    """Exchanges arrive after everything else; those behind the watermark come too late."""
    rows = trades(spark, d)
    early = (F.col("txn_type") != "E") & (F.col("txn_time") <= "2000-01-01")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("late-trades", "late-bursts", "late-checkpoint"))
    for part in (rows.filter(early), rows.filter(~early)):
        part.write.mode("append").parquet(source)
        run_bursts(spark, source, checkpoint, out)
    return bursts.with_people(spark.read.parquet(out), spark.read.schema(TRADE).parquet(source))
