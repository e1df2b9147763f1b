"""Date flags, constraints and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, quality
from .adapters import AS_OF, filings, table, transactions
from .registry import query

FT = ("filings", "transactions")
FLAGS_SQL = f"""with flagged as (select t.*, f.doc_id, f.filing_date, [x for x in [
      case when t.txn_date > t.notification_date then 'transaction_date_after_notification' end,
      case when t.txn_date > f.filing_date then 'transaction_date_after_filing' end,
      case when t.txn_date > date '{AS_OF}' then 'transaction_date_after_ingestion_date' end,
      case when t.notification_date > f.filing_date then 'notification_date_after_filing' end] if x is not null] as computed
    from transactions t join filings f on f.id = t.filing_id)"""


def recomputed(spark, d):
    return quality.recomputed_flags(transactions(spark, d), filings(spark, d), AS_OF)


@query("q1_date_flags", FLAGS_SQL + " select id, array_to_string(computed, ',') as flags from flagged", FT)
def q1(spark, d):
    return recomputed(spark, d).select("id", F.array_join("computed_flags", ",").alias("flags"))


@query("q2_recompute_flags", FLAGS_SQL + """ select cast(count(*) as bigint) as examined,
    cast(count(*) filter (where computed <> quality_flags) as bigint) as changed from flagged""", FT)
def q2(spark, d):
    return quality.recompute_summary(recomputed(spark, d))


@query("a9_flag_histogram", FLAGS_SQL + """, one as (select unnest(computed) as flag from flagged where computed <> quality_flags)
    select flag, cast(count(*) as bigint) as n from one group by flag""", FT)
def a9(spark, d):
    return quality.flag_histogram(recomputed(spark, d))


@query("a9_affected_documents", FLAGS_SQL + " select distinct doc_id from flagged where computed <> quality_flags", FT)
def a9_docs(spark, d):
    return quality.affected_documents(recomputed(spark, d))


@query("k3_update_changed_flags", FLAGS_SQL + " select id, array_to_string(computed, ',') as quality_flags, amount_min from flagged", FT)
def k3(spark, d):
    done = quality.with_new_flags(transactions(spark, d), filings(spark, d), AS_OF)
    return done.select("id", F.array_join("quality_flags", ",").alias("quality_flags"), "amount_min")


@query("q3_filing_rules", """
    select id, 'doc_kind_domain' as rule from filings where doc_kind not in ('efiled', 'scanned')
    union all select id, 'no_self_amendment' from filings where amends_filing_id = id
    union all select id, 'amendment_method_domain' from filings where amendment_method not in ('explicit_source', 'amendment_match', 'manual_review')
    union all select id, 'amendment_needs_provenance' from filings where amends_filing_id is not null
      and (amendment_method is null or amendment_confidence is null)""", ("filings",))
def q3_filings(spark, d):
    return quality.row_violations(filings(spark, d), quality.FILING_RULES, quality.FILING_REQUIRED, ["id"])


@query("q3_transaction_rules", """
    select id, 'verification_confidence_domain' as rule from transactions where verification_confidence not in ('high', 'medium', 'low')
    union all select id, 'evidence_not_blank' from transactions where trim(verification_source_doc_id) = ''
    union all select id, 'verified_date_needs_provenance' from transactions where verified_transaction_date is not null
      and trim(verification_source_doc_id) = ''""", ("transactions",))
def q3_transactions(spark, d):
    required = quality.TRANSACTION_REQUIRED
    return quality.row_violations(transactions(spark, d, True), quality.TRANSACTION_RULES, required, ["id"])


@query("q3_duplicate_sequences", """select filing_id, cast(sequence as int) as sequence, cast(count(*) as bigint) as n
    from transactions group by all having count(*) > 1""", ("transactions",))
def q3_duplicates(spark, d):
    return quality.duplicate_keys(transactions(spark, d), ["filing_id", "sequence"])


@query("q3_unique_documents", """select doc_id, count(*) as n from (select cast(o_custkey as varchar) as doc_id from orders) group by all
    having count(*) > 1""")
def q3_documents(spark, d):
    """Document ids that are not unique, over listings that are known to repeat theirs."""
    return quality.duplicate_keys(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id")), ["doc_id"])


@query("q3_orphan_lines", """select id from transactions where filing_id not in (select id from filings where source = 'house_clerk')""", FT)
def q3_orphans(spark, d):
    return quality.orphans(transactions(spark, d), filings(spark, d).filter("source = 'house_clerk'")).select("id")


# Decisions come from customers and their orders: one per order, some of them unusable.
DECISIONS = {
    "decision_no": "l_partkey * 1000000 + l_orderkey * 10 + l_linenumber",
    "action": "case when l_returnflag = 'A' then 'clear' when l_suppkey % 17 = 0 then 'guess' else 'verify' end",
    "transaction_id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
                      " + case when l_suppkey % 13 = 0 then 1 else 0 end",
    "doc_id": "cast(null as string)",
    "sequence": "cast(null as int)",
    "verified_transaction_date": "case when l_suppkey % 11 <> 0 then cast(l_shipdate as date) - 3 end",
    "method": "case when l_suppkey % 7 = 0 then 'hunch' else 'explicit_source' end",
    "confidence": "case when l_suppkey % 9 = 0 then null else 'high' end",
    "source_doc_id": "case when l_suppkey % 6 = 0 then '  ' else cast(l_orderkey as string) end",
    "note": "cast(null as string)",
    "verified_at": "l_shipdate",
}
DECISIONS_SQL = "with decisions as (select " + ", ".join(
    f"{e} as {n}" for n, e in DECISIONS.items()) + """ from lineitem where l_linestatus = 'F'),
    judged as (select decisions.*, case
      when action not in ('verify', 'clear') then 'unknown action'
      when action = 'verify' and verified_transaction_date is null then 'verified date is required'
      when action = 'verify' and method <> 'explicit_source' then 'invalid method'
      when action = 'verify' and confidence is null then 'invalid confidence'
      when action = 'verify' and trim(source_doc_id) = '' then 'evidence document is required'
      when transaction_id not in (select id from transactions) then 'unknown transaction' end as reason from decisions)"""


def decisions(spark, d):
    return table(spark, d, "lineitem").filter("l_linestatus = 'F'").selectExpr(*[f"{e} as {n}" for n, e in DECISIONS.items()])


@query("q4_apply_verifications", DECISIONS_SQL + """, last as (select * from judged where reason is null
      qualify row_number() over (partition by transaction_id order by decision_no desc) = 1)
    select t.id, case when l.action is null then t.verified_transaction_date when l.action = 'verify' then l.verified_transaction_date end as verified_transaction_date,
      case when l.action is null then t.verification_method when l.action = 'verify' then l.method end as verification_method,
      case when l.action is null then t.verification_source_doc_id when l.action = 'verify' then l.source_doc_id end as verification_source_doc_id,
      array_to_string(t.quality_flags, ',') as quality_flags
    from transactions t left join last l on l.transaction_id = t.id""", FT)
def q4(spark, d):
    done = curation.apply_verifications(transactions(spark, d), filings(spark, d), decisions(spark, d))
    return done.table.select("id", "verified_transaction_date", "verification_method", "verification_source_doc_id",
                             F.array_join("quality_flags", ",").alias("quality_flags"))


@query("q4_rejected_decisions", DECISIONS_SQL + " select decision_no, reason from judged where reason is not null", FT)
def q4_rejected(spark, d):
    return curation.apply_verifications(transactions(spark, d), filings(spark, d), decisions(spark, d)).rejected


@query("q4_locate_lines", """select doc_id, cast(sequence as int) as sequence, min(t.id) as transaction_id
    from transactions t join filings f on f.id = t.filing_id group by all
    union all select doc_id, 99, null from filings""", FT)
def q4_locate(spark, d):
    t, f = transactions(spark, d), filings(spark, d)
    named = (t.join(f.select(F.col("id").alias("filing_id"), "doc_id"), "filing_id").select("doc_id", "sequence").distinct()
             .unionByName(f.select("doc_id", F.lit(99).alias("sequence"))))
    asked = named.withColumn("transaction_id", F.lit(None).cast("long"))
    return curation.locate_lines(asked, t, f).select("doc_id", "sequence", "transaction_id")


@query("q5_clear_verification", """select id, case when amount_max is not null then verified_transaction_date end as verified_transaction_date,
    case when amount_max is not null then verification_confidence end as verification_confidence from transactions""", FT)
def q5(spark, d):
    t, f = transactions(spark, d), filings(spark, d)
    blank = lambda kind: F.lit(None).cast(kind)
    clear = t.filter("amount_max is null").select(
        F.col("id").alias("decision_no"), F.lit("clear").alias("action"), F.col("id").alias("transaction_id"),
        blank("string").alias("doc_id"), blank("int").alias("sequence"), blank("date").alias("verified_transaction_date"),
        *[blank("string").alias(c) for c in ("method", "confidence", "source_doc_id", "note")],
        F.col("verified_at"))
    return curation.apply_verifications(t, f, clear).table.select("id", "verified_transaction_date", "verification_confidence")


LINKS = {
    "decision_no": "o_orderkey",
    "action": "case when o_orderkey % 3 = 0 then 'clear' else 'link' end",
    "amended_doc_id": "cast(o_orderkey as string)",
    "original_doc_id": "case when o_orderstatus = 'P' then cast(o_orderkey as string)"
                       " when o_orderpriority = '5-LOW' then concat('gone', cast(o_orderkey as string)) else cast(o_custkey as string) end",
    "method": "case when o_orderpriority = '1-URGENT' then 'guess' else 'amendment_match' end",
    "confidence": "'low'",
    "note": "o_orderpriority",
    "verified_at": "o_orderdate",
}
LINKS_SQL = "with links as (select " + ", ".join(f"{e} as {n}" for n, e in LINKS.items()) + """ from orders),
    judged as (select l.*, o.id as original_id, case when action = 'link' and method = 'guess' then 'invalid method'
      when action = 'link' and amended_doc_id = original_doc_id then 'a filing cannot amend itself'
      when action = 'link' and o.id is null then 'unknown original filing' end as reason
      from links l left join filings o on o.doc_id = l.original_doc_id)"""


def links(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{e} as {n}" for n, e in LINKS.items()])


@query("q6_apply_amendment_links", LINKS_SQL + """ select f.id, case when j.reason is not null then f.amends_filing_id
      when j.action = 'link' then j.original_id end as amends_filing_id,
      case when j.reason is not null then f.amendment_method when j.action = 'link' then j.method end as amendment_method,
      case when j.reason is not null then f.amendment_note when j.action = 'link' then j.note end as amendment_note
    from filings f join judged j on j.amended_doc_id = f.doc_id""", ("filings",))
def q6(spark, d):
    done = curation.apply_amendment_links(filings(spark, d), links(spark, d))
    return done.table.select("id", "amends_filing_id", "amendment_method", "amendment_note")


@query("q6_rejected_links", LINKS_SQL + " select decision_no, reason from judged where reason is not null", ("filings",))
def q6_rejected(spark, d):
    return curation.apply_amendment_links(filings(spark, d), links(spark, d)).rejected


@query("a8_amended_unlinked", """select distinct f.doc_id from filings f join transactions t on t.filing_id = f.id
    where t.filing_status = 'Amended' and f.amends_filing_id is null""", FT)
def a8(spark, d):
    return curation.amendment_candidates(filings(spark, d), transactions(spark, d))


@query("q7_amendment_candidates", """select f.doc_id, cast(null as varchar) as original_doc_id from filings f
    where f.amends_filing_id is null and exists (select 1 from transactions t where t.filing_id = f.id
      and t.filing_status = 'Amended')""", FT)
def q7(spark, d):
    return curation.amendment_candidates(filings(spark, d), transactions(spark, d)).withColumn(
        "original_doc_id", F.lit(None).cast("string")).orderBy("doc_id")


@query("q8_unresolved_lines", """select doc_id, cast(sequence as int) as sequence, txn_date, notification_date,
    array_to_string(quality_flags, ',') as quality_flags from transactions t join filings f on f.id = t.filing_id
    where len(quality_flags) > 0 and verified_transaction_date is null""", FT)
def q8(spark, d):
    return curation.unresolved_lines(filings(spark, d), transactions(spark, d)).withColumn(
        "quality_flags", F.array_join("quality_flags", ","))
