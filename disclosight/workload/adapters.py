"""The given tables seen as filings, trade lines, roster members and filers.

Every view is a list of column expressions that Spark and DuckDB read alike, so both engines work
on the same rows. Nothing is generated: each row stands for one row of orders, lineitem or
customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2000-06-30"

FILINGS = {
    "id": "o_orderkey",
    "doc_id": "cast(o_orderkey as string)",
    "year": "cast(year(o_orderdate) as int)",
    "prefix": "case when o_orderkey % 5 = 0 then 'Hon.' end",
    "first_name": "case when o_orderkey % 7 = 0 then lower(c_mktsegment) else c_mktsegment end",
    "last_name": "c_name",
    "suffix": "case when o_orderkey % 11 = 0 then 'Jr.' when o_orderkey % 11 = 1 then '' end",
    "state_district": "concat(substr(r_name, 1, 2), lpad(cast(n_nationkey as string), 2, '0'))",
    "filing_date": "case when o_orderkey % 97 <> 0 then cast(o_orderdate as date) end",
    "doc_kind": "case when o_orderkey % 1999 = 7 then 'fax' when o_orderkey % 10 = 0 then 'scanned' else 'efiled' end",
    "pdf_url": "concat('https://docs.example/', cast(o_orderkey as string), '.pdf')",
    "downloaded_at": "o_orderdate",
    "created_at": "o_orderdate",
    "source": "case when o_orderkey % 4 = 0 then 'senate_efd' else 'house_clerk' end",
    "amends_filing_id": "case when o_orderkey % 50 = 1 then o_orderkey - 1 when o_orderkey % 4999 = 17 then o_orderkey end",
    "amendment_method": "case when o_orderkey % 350 = 1 then 'guess' when o_orderkey % 50 = 1 then 'manual_review' end",
    "amendment_confidence": "case when o_orderkey % 250 = 1 then null when o_orderkey % 50 = 1 then 'medium' end",
    "amendment_note": "case when o_orderkey % 100 = 1 then 'restated' end",
    "amendment_verified_at": "case when o_orderkey % 50 = 1 then o_orderdate end",
}
#: Columns of the given tables that the view is made of.
FILINGS_OF = ("o_orderkey", "o_orderdate", "c_mktsegment", "c_name", "n_nationkey", "r_name")
FILINGS_FROM = """orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

TRANSACTIONS = {
    "id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
    "filing_id": "l_orderkey",
    "sequence": "l_linenumber",
    "txn_source_id": "case when l_partkey % 4 = 0 then concat('20', lpad(cast(l_partkey as string), 8, '0')) end",
    "owner_token": "case l_suppkey % 5 when 0 then 'SP' when 1 then 'JT' when 2 then 'DC' when 3 then 'Self' end",
    "asset_name": "p_name",
    "ticker": "case when l_partkey % 50 = 0 then '--' when l_partkey % 53 <> 0 then concat('P', cast(l_partkey as string)) end",
    "asset_type_code": "case l_partkey % 7 when 0 then 'ST' when 1 then 'OP' when 2 then 'GS' when 3 then 'CT'"
                       " when 4 then 'Stock Option' when 5 then 'EF' end",
    "txn_type": "case when l_returnflag = 'N' then 'P' when l_returnflag = 'R' then 'S'"
                " when l_linestatus = 'F' then 'S (partial)' else 'E' end",
    "txn_date": "cast(l_shipdate as date)",
    "notification_date": "cast(l_shipdate as date) + (cast(l_quantity as int) - 10)",
    "amount_min": "cast(floor(l_extendedprice) as bigint)",
    "amount_max": "case when l_extendedprice <= 100000 then cast(floor(l_extendedprice) as bigint) + 14999 end",
    "amount_raw": "concat('$', cast(cast(floor(l_extendedprice) as bigint) as string))",
    "cap_gains_flag": "cast(null as boolean)",
    "filing_status": "case l_suppkey % 4 when 0 then 'New' when 1 then 'Amended' end",
    "ownership_source": "cast(null as string)",
    "notes": "case when l_partkey % 13 = 0 then 'see attachment' end",
    "quality_flags": "case when cast(l_quantity as int) < 10 and l_partkey % 3 <> 0"
                     " then {array}('transaction_date_after_notification') else {no_flags} end",
    "verified_transaction_date": "case when l_partkey % 29 = 0 then cast(l_shipdate as date) - 1 end",
    "verification_method": "case when l_partkey % 29 = 0 then 'manual_review' end",
    "verification_confidence": "case when l_partkey % 58 = 0 then 'high' when l_partkey % 29 = 0 then 'sure' end",
    "verification_source_doc_id": "case when l_partkey % 290 = 0 then ' ' when l_partkey % 58 = 0 then 'unknown'"
                                  " when l_partkey % 29 = 0 then cast(l_orderkey + 7 as string) end",
    "verification_note": "case when l_partkey % 87 = 0 then 'checked' end",
    "verified_at": "case when l_partkey % 29 = 0 then l_shipdate end",
}
TRANSACTIONS_OF = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice")
TRANSACTIONS_FROM = "lineitem join part on l_partkey = p_partkey"

_GIVEN = ("case c_custkey % 8 when 0 then 'James' when 1 then 'William' when 2 then 'Robert' when 3 then 'Michael'"
          " when 4 then 'Andrew' when 5 then 'Stephen' when 6 then 'Theodore' else 'Edward' end")
_SHORT = ("case c_custkey % 8 when 0 then 'Jim' when 1 then 'Bill' when 2 then 'Bob' when 3 then 'Mike'"
          " when 4 then 'Drew' when 5 then 'Steve' else 'Ted' end")
_FAMILY = "cast(cast(floor(c_custkey / 3) as bigint) as string)"
_TERM1 = "date '1995-01-01' + cast(c_custkey % 400 as int)"

MEMBERS = {
    "bioguide_id": "concat('C', lpad(cast(c_custkey as string), 9, '0'))",
    "last_name": f"concat('Peña', {_FAMILY})",
    "first_name": _GIVEN,
    "given_name": f"case when c_custkey % 4 = 1 then concat('J. ', {_GIVEN}) else {_GIVEN} end",
    "alternate": "case when c_custkey % 6 = 0 then concat('Alt', cast(c_custkey as string)) end",
    "state": "substr(r_name, 1, 2)",
    "party": "case when c_custkey % 2 = 0 then 'R' else 'D' end",
    "start1": _TERM1,
    "end1": f"{_TERM1} + 500",
    "start2": f"{_TERM1} + 600",
    "end2": f"case when c_custkey % 5 <> 0 then {_TERM1} + 1200 end",
}
MEMBERS_FROM = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"

FILERS = {
    "doc_id": "cast(o_orderkey as string)",
    "last": f"case o_orderkey % 4 when 0 then concat('PENA', {_FAMILY}) when 1 then concat('Peña', {_FAMILY}, ', MD.')"
            f" when 2 then concat('Peña', {_FAMILY}, ' II') else concat('Alt', cast(c_custkey as string)) end",
    "first": f"case o_orderkey % 3 when 0 then {_GIVEN} when 1 then {_SHORT} else concat('X. ', {_GIVEN}, ' Jr.') end",
    "given": f"case o_orderkey % 3 when 1 then {_SHORT} else {_GIVEN} end",
    "custkey": "c_custkey",
    "state_district": "case when o_orderkey % 101 = 0 then 'X' when o_orderkey % 103 = 0 then 'ZZ01'"
                      " else concat(substr(r_name, 1, 2), lpad(cast(n_nationkey as string), 2, '0')) end",
    "filing_date": "case when o_orderkey % 97 <> 0 then cast(o_orderdate as date) end",
    "office": "case when o_orderkey % 2 = 0 then 'Name (Former Senator)' else 'Name (Senator)' end",
}
FILERS_FROM = FILINGS_FROM

_FIRST, _ID6 = _GIVEN, "c_custkey % 6"
RECORDS = {
    "bioguide_id": "concat('C', lpad(cast(c_custkey as string), 9, '0'))",
    "first": _FIRST,
    "middle": f"case when {_ID6} = 4 then 'Lee' end",
    "last": f"case when {_ID6} = 3 then concat('McClain Peña', {_FAMILY}) else concat('Peña', {_FAMILY}) end",
    "official_full": f"case {_ID6} when 0 then concat({_FIRST}, ' Peña', {_FAMILY})"
                     f" when 1 then concat({_FIRST}, ' Q. Peña', {_FAMILY}, ', Jr.')"
                     f" when 2 then concat({_FIRST}, ' Pena Smith', {_FAMILY})"
                     f" when 3 then concat({_FIRST}, ' McClain Peña', {_FAMILY})"
                     f" when 5 then concat({_FIRST}, ' Paul Peña', {_FAMILY}, ' Extra III') end",
    "shape": f"cast({_ID6} as int)",
    "family": _FAMILY,
    "state": "substr(r_name, 1, 2)",
    "early": "case when c_custkey % 2 = 0 then 'rep' else 'sen' end",
    "late": "case when c_custkey % 3 = 0 then 'rep' else 'sen' end",
    "late_end": "case when c_custkey % 5 = 0 then '' else '2005-01-03' end",
    "district": "c_custkey % 50",
    "party": "case when c_custkey % 2 = 0 then 'R' else '' end",
}

_SQL_WORDS = {"array": "list_value", "no_flags": "cast([] as varchar[])"}
_SPARK_WORDS = {"array": "array", "no_flags": "cast(array() as array<string>)"}

VIEWS = {
    "filings": (FILINGS, FILINGS_FROM),
    "transactions": (TRANSACTIONS, TRANSACTIONS_FROM),
    "members": (MEMBERS, MEMBERS_FROM),
    "filers": (FILERS, FILERS_FROM),
    "records": (RECORDS, MEMBERS_FROM),
}


def _columns(view: dict[str, str], words: dict[str, str]) -> list[str]:
    return [f"{expr.format(**words)} as {name}" for name, expr in view.items()]


def shown(view: dict[str, str]) -> dict[str, str]:
    """The columns of a view as Spark expressions."""
    return {name: expr.format(**_SPARK_WORDS) for name, expr in view.items()}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """``sql`` with the named views in front; ``sql`` may start with its own WITH list."""
    ctes = [f"{v} as (select {', '.join(_columns(VIEWS[v][0], _SQL_WORDS))} from {VIEWS[v][1]})" for v in views]
    body = sql.strip()
    if body.lower().startswith("with "):
        ctes.append(body[5:])
        return "with " + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to the session's shuffle partitions by a key, ahead of rendering them as documents."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _filing_rows(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    orders = dealt(orders, "o_orderkey") if deal else orders
    return (orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
            .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
            .join(region, nation["n_regionkey"] == region["r_regionkey"]))


def filing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filing with the given columns that ``FILINGS`` shows."""
    return _filing_rows(spark, sf_dir).select(*FILINGS_OF)


def filings(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return _filing_rows(spark, sf_dir, deal).selectExpr(*_columns(FILINGS, _SPARK_WORDS))


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filing_rows(spark, sf_dir).selectExpr(*_columns(FILERS, _SPARK_WORDS))


def transactions(spark: SparkSession, sf_dir: str, assets: bool = False, deal: bool = False) -> DataFrame:
    """Trade lines; the asset name costs a join with ``part`` and is left out unless asked for."""
    lines = table(spark, sf_dir, "lineitem")
    lines = dealt(lines, "l_orderkey") if deal else lines
    view = TRANSACTIONS
    if assets:
        part = table(spark, sf_dir, "part")
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    else:
        view = {k: v for k, v in view.items() if k != "asset_name"}
    return lines.selectExpr(*_columns(view, _SPARK_WORDS))


def _member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    customer = dealt(customer, "c_custkey")  # names are heavy per row
    return (customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
            .join(region, nation["n_regionkey"] == region["r_regionkey"]))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer seen as a roster member, both terms side by side."""
    return _member_rows(spark, sf_dir).selectExpr(*_columns(MEMBERS, _SPARK_WORDS))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer seen as a raw legislator record, not yet nested."""
    return _member_rows(spark, sf_dir).selectExpr(*_columns(RECORDS, _SPARK_WORDS))
