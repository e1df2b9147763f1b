"""Renders rows of the given tables as landed files and documents.

Everything is rendered row by row: a document stands for one order or one line, so rendering
never gathers a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import dollars
from ..session import scratch_path
from . import adapters


def us(col: str) -> Column:
    return F.date_format(col, "MM/dd/yyyy")


def text(*parts) -> Column:
    """Concatenation where NULL parts vanish."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


# --- roster and records -------------------------------------------------------

def roster(spark: SparkSession, d: str) -> DataFrame:
    """Typed House roster (the Senate one is the same without alternates)."""
    term = lambda start, end: F.struct(F.col(start).alias("start"), F.col(end).alias("end"),
                                       F.lit(1).cast("long").alias("district"))
    return adapters.members(spark, d).select(
        "bioguide_id", "last_name", "first_name", "given_name",
        F.array_compact(F.array("alternate")).alias("last_name_alts"), "state", "party",
        F.array(term("start1", "end1"), term("start2", "end2")).alias("terms"))


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    def term(kind: Column, start: str, end: Column, state: Column) -> Column:
        return F.struct(kind.alias("type"), F.lit(start).alias("start"), end.alias("end"),
                        F.col("district"), state.alias("state"), F.col("party"))

    terms = F.array(
        term(F.col("late"), "2003-01-07", F.col("late_end"), F.col("state")),
        term(F.lit("rep"), "1999-01-06", F.lit("2001-01-03"), F.lit("XX")),
        term(F.col("early"), "1997-01-03", F.lit("1999-01-03"), F.col("state")),
        term(F.lit("sen"), "2030-01-03", F.lit(None).cast("string"), F.col("state")))
    return adapters.records(spark, d).select(
        F.struct(F.col("bioguide_id").alias("bioguide")).alias("id"),
        F.struct("first", "middle", "last", F.lit(None).cast("string").alias("suffix"), "official_full").alias("name"),
        terms.alias("terms"))


# --- report text ---------------------------------------------------------------

TABLE_HEAD = "ID Owner Asset Transaction Date Notification Amount Cap.\nType Date Gains >\n$200?\n"


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text report per trade line: the line, a wrapped second trade and a block without a code."""
    t = adapters.transactions(spark, d, assets=True, deal=True)
    owner = F.when(F.col("owner_token") != "Self", F.concat("owner_token", F.lit(" ")))
    ticker = F.when(F.col("ticker") != "--", F.concat(F.lit(" ("), "ticker", F.lit(")")))
    code = F.when(F.length("asset_type_code") == 2, F.lower("asset_type_code")).otherwise("st")
    amount = F.when(F.col("amount_max").isNull(), dollars(F.col("amount_min"))).otherwise(
        F.concat(dollars(F.col("amount_min")), F.lit(" -\n"), dollars(F.col("amount_max"))))
    spine = F.concat(F.col("txn_type"), F.lit(" "), us("txn_date"), F.lit("  "), us("notification_date"), F.lit(" "))
    status = F.concat(F.lit("F S: "), "filing_status", F.lit("\n"))
    note = F.concat(F.lit("D : "), "notes", F.lit("\nwith $5 more\n"))
    body = text(
        "Filing ID #", F.col("id").cast("string"), "\nName: Hon. Test\n", TABLE_HEAD,
        F.concat("txn_source_id", F.lit(" ")), owner, F.col("asset_name"), ticker, " [", code, "] ", spine, amount,
        "\n", status, "S O: Some Account\n", note,
        "JT Long asset - part one ", spine, "$1,001 -\n[ct] $15,000\nF S: Amended\nC: comment\n",
        "No code here P 01/02/2020 01/03/2020 $5\nF S: Lost\n",
        "* For the complete list of asset types\nX [ST] P 01/02/2020 01/03/2020 $7\n")
    return t.select(F.col("id").cast("string").alias("doc_id"), body.alias("body"))


def senate_pages(spark: SparkSession, d: str) -> DataFrame:
    """One HTML page per trade line with two trades and rows that are none."""
    t = adapters.transactions(spark, d, assets=True, deal=True)
    label = (F.when(F.col("amount_min") % 97 == 0, "Barter").when(F.col("txn_type") == "P", "Purchase")
             .when(F.col("txn_type") == "S", "Sale (Full)").when(F.col("txn_type") == "E", "Exchange")
             .otherwise("Sale (Partial)"))
    amount = F.when(F.col("amount_max").isNull(), F.concat(F.lit("Over "), dollars(F.col("amount_min")))).otherwise(
        F.concat(dollars(F.col("amount_min")), F.lit(" - "), dollars(F.col("amount_max"))))
    cells = lambda *values: text("<tr>", *[text("<td>\n  ", v, "\n</td>") for v in values], "</tr>\n")
    muted = '<div class="small text-muted">Option <div>$75.00</div> Expires: 2026-08-21</div>'
    first = cells("1", us("txn_date"), F.col("owner_token"),
                  text('<a href="/q">', F.col("ticker"), "</a>"),
                  text(F.col("asset_name"), " &amp; <b>Co</b>", muted), F.col("asset_type_code"), label, amount, F.col("notes"))
    second = cells("702", us("notification_date"), "Joint", "WMB", "Williams", "Stock", "exchange", "Over $50,000,000", "--")
    skipped = cells("x", us("txn_date"), "", "", "Total", "", "Purchase", "$1", "")
    short, undated = cells("3", us("txn_date"), "Joint"), cells("4", "13/45/2020", "", "", "A", "", "Purchase", "$1", "")
    body = text('<table class="table"><thead><tr><th>#</th><th>Transaction Date</th></tr></thead><tbody>', first, skipped,
                short, undated, second, "</tbody></table>")
    return t.select(F.col("id").cast("string").alias("doc_id"), body.alias("body"))


def report_words(spark: SparkSession, d: str) -> DataFrame:
    """Positioned words of a two-page report per filing; the second page repeats no header."""
    f = adapters.filings(spark, d, deal=True)
    word = lambda page, value, x0, top: F.struct(
        F.lit(page).alias("page"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("text"),
        F.lit(float(x0)).alias("x0"), F.lit(float(top)).alias("top"))
    day = us("created_at")
    head = [word(1, t, x, 100) for t, x in (("iD", 20), ("owner", 60), ("Asset", 100), ("Transaction", 300),
                                            ("Date", 360), ("Notification", 420), ("Amount", 490), ("Cap.", 560))]
    band = [word(1, "Type", 300, 112), word(1, "Date", 420, 112), word(1, "$200?", 560, 124)]
    lead = [word(1, "Name:", 20, 40), word(1, F.col("last_name"), 60, 41.5)]
    first = [word(1, F.when(F.col("suffix").isNotNull(), "sp").otherwise("DC"), 60, 140), word(1, F.col("first_name"), 100, 141.5),
             word(1, "Fund", 180, 140), word(1, "s", 300, 140), word(1, "(Partial)", 315, 140), word(1, day, 360, 142),
             word(1, day, 420, 140), word(1, "$1,001", 490, 140), word(1, "-", 540, 140),
             word(1, "-", 90, 152), word(1, F.concat(F.lit("(Q"), "doc_id", F.lit(")")), 110, 153), word(1, "[sT]", 170, 152),
             word(1, "$15,000", 490, 154)]
    status = [word(1, "F", 100, 164), word(1, "S:", 112, 164), word(1, F.col("doc_kind"), 130, 164)]
    note = [word(1, "D:", 100, 176), word(1, "first", 130, 176), word(1, "note", 160, 177)]
    page2 = [word(2, "more", 100, 50), word(2, "$99", 490, 50),
             word(2, "Other", 100, 62), word(2, "[gs]", 140, 62), word(2, "E", 300, 62), word(2, day, 360, 62),
             word(2, day, 420, 62), word(2, "$15.00", 490, 62),
             word(2, "*", 20, 74), word(2, "For", 40, 74), word(2, "the", 60, 74), word(2, "complete", 80, 74),
             word(2, "list", 120, 74), word(2, "lost", 100, 90), word(2, "$7", 490, 90)]
    return f.select("doc_id", F.explode(F.array(*lead, *head, *band, *first, *status, *note, *page2)).alias("w")).select(
        "doc_id", "w.page", "w.text", "w.x0", "w.top")


# --- landed files ---------------------------------------------------------------

def index_table(spark: SparkSession, d: str) -> DataFrame:
    """Filings in the columns of the House listing, all text."""
    f = adapters.filings(spark, d)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return f.select(
        value("prefix").alias("Prefix"), value("last_name").alias("Last"), value("first_name").alias("First"),
        value("suffix").alias("Suffix"), F.when(F.col("doc_kind") == "scanned", "C").otherwise("P").alias("FilingType"),
        F.col("state_district").alias("StateDst"), value("year").alias("Year"),
        F.coalesce(F.date_format("filing_date", "M/d/yyyy"), F.lit("")).alias("FilingDate"), F.col("doc_id").alias("DocID"))


def land_xml(rows: DataFrame, label: str, root: str, row: str) -> str:
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("rootTag", root).option("rowTag", row).option("nullValue", "").xml(path)
    return path


def land_tsv(rows: DataFrame, label: str) -> str:
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return path


def land_json(rows: DataFrame, label: str) -> str:
    path = scratch_path(rows.sparkSession, label)
    rows.write.json(path)
    return path


def land_parquet(rows: DataFrame, label: str) -> str:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return path


def senate_listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages of up to 100 consecutive filings each."""
    f = adapters.filers(spark, d)
    path = F.when(F.col("office").contains("Former"), "paper").otherwise("ptr")
    link = text('<a href="/search/view/', path, "/", F.col("doc_id"), '/" target="_blank">Report</a>')
    office = text(F.regexp_replace("last", ",", ""), ", ", F.col("given"), " (Senator)")
    cells = F.array(F.col("first"), F.col("last"), office, link, F.coalesce(F.date_format("filing_date", "MM/dd/yyyy"), F.lit("")))
    page = F.floor(F.col("doc_id").cast("long") / 100)
    return f.groupBy(page.alias("draw")).agg(F.collect_list(cells).alias("data"), F.count(F.lit(1)).alias("recordsTotal"))


def roster_snapshots(spark: SparkSession, d: str, house: bool) -> DataFrame:
    """Snapshot objects of up to 500 consecutive members each."""
    members = roster(spark, d)
    term = lambda t: F.struct(t["start"].cast("string").alias("start"), t["end"].cast("string").alias("end"),
                              *([t["district"].alias("district")] if house else []))
    fields = ["bioguide_id", "last_name", "first_name", "given_name", *(["last_name_alts"] if house else []),
              "state", "party", F.transform("terms", term).alias("terms")]
    part = F.floor(F.substring("bioguide_id", 2, 9).cast("long") / 500)
    return members.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias("members")).select(
        F.lit("test").alias("source"), "members")
