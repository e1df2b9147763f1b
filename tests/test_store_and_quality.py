import datetime as dt

from pyspark.sql import functions as F

from disclosight import schema
from disclosight.functions.ids import with_batch_ids
from disclosight.operators import curation, filters, quality, store
from disclosight.plans import ingest
from disclosight.plans.recompute import recompute
from disclosight.sources import tables
from disclosight.streaming import bursts

D = dt.date


def test_flag_order_and_null_filing_date(make_tables):
    filings, lines = make_tables([
        {"txn_date": D(2026, 12, 26), "notification_date": D(2026, 1, 21), "filing_date": D(2026, 1, 9)},
        {"txn_date": D(2025, 1, 1), "notification_date": D(2025, 1, 1), "filing_date": D(2025, 1, 1)},
        {"txn_date": D(2026, 12, 26), "notification_date": D(2026, 12, 27), "filing_date": None}])
    rows = quality.recomputed_flags(lines, filings, D(2026, 3, 1)).orderBy("id").collect()
    assert rows[0]["computed_flags"] == ["transaction_date_after_notification", "transaction_date_after_filing",
                                         "transaction_date_after_ingestion_date", "notification_date_after_filing"]
    assert rows[1]["computed_flags"] == [] and not rows[1]["changed"]
    assert rows[2]["computed_flags"] == ["transaction_date_after_ingestion_date"]


def test_recompute_is_idempotent(make_tables):
    filings, lines = make_tables([{"txn_date": D(2026, 1, 2), "filing_date": D(2026, 1, 1)}])
    done = quality.with_new_flags(lines, filings, D(2026, 3, 1))
    assert quality.recompute_summary(quality.recomputed_flags(done, filings, D(2026, 3, 1))).first()["changed"] == 0


def test_verification_by_name_last_decision_wins_and_sources_stay(make_tables, spark):
    filings, lines = make_tables([{"doc_id": "a"}, {"doc_id": "b"}])
    decisions = spark.createDataFrame([
        (1, "verify", 10, None, None, D(2024, 1, 1), "manual_review", "high", "ev", None, None),
        (2, "verify", None, "a", 0, D(2024, 1, 2), "manual_review", "low", "ev", "n", None),
        (3, "verify", 20, None, None, None, "manual_review", "low", "ev", None, None),
        (4, "verify", 99, None, None, D(2024, 1, 1), "manual_review", "low", "ev", None, None),
        (5, "clear", 20, None, None, None, None, None, None, None, None)],
        "decision_no long, action string, transaction_id long, doc_id string, sequence int, verified_transaction_date date, method string, "
        "confidence string, source_doc_id string, note string, verified_at timestamp")
    done = curation.apply_verifications(lines, filings, decisions)
    first, second = done.table.orderBy("id").collect()
    assert (first["verified_transaction_date"], first["verification_confidence"], first["txn_date"]) == (D(2024, 1, 2), "low", D(2024, 3, 1))
    assert second["verified_transaction_date"] is None
    assert {(r[0], r[1]) for r in done.rejected.collect()} == {(3, "verified date is required"), (4, "unknown transaction")}


def test_amended_status_never_links(make_tables):
    filings, lines = make_tables([{"filing_status": "Amended"}, {"filing_status": "New"}])
    assert [r[0] for r in curation.amendment_candidates(filings, lines).collect()] == ["00000001"]
    assert filings.filter("amends_filing_id is not null").count() == 0


def test_constraints(make_tables):
    filings, lines = make_tables([{"amends_filing_id": 1, "amendment_method": "x"}, {}])
    broken = {r["rule"] for r in quality.row_violations(filings, quality.FILING_RULES, quality.FILING_REQUIRED, ["id"]).collect()}
    assert broken == {"no_self_amendment", "amendment_method_domain", "amendment_needs_provenance"}


def test_ranges_are_checked(make_tables):
    import pytest
    _, lines = make_tables([{"amount_min": 5}, {"amount_min": 9}])
    assert filters.amount_between(lines, 5, 5).count() == 1
    with pytest.raises(ValueError):
        filters.between_dates(lines, "txn_date", "2025-01-02", "2025-01-01")


def test_batch_ids_are_unique_and_repeatable(spark):
    df = spark.range(20000).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    once, again = with_batch_ids(df, ["doc_id"], 3), with_batch_ids(df.repartition(7), ["doc_id"], 3)
    other = with_batch_ids(df, ["doc_id"], 4)
    assert once.union(other).select("id").distinct().count() == 40000
    assert once.join(again, ["doc_id", "id"]).count() == 20000


def report(doc, name, version):
    return (doc, 2024, "", name, "L", "", "CA01", D(2024, 1, 1), "efiled", "u", "house_clerk", version)


REPORT = ("doc_id string, year int, prefix string, first_name string, last_name string, suffix string, state_district string, filing_date date, "
          "doc_kind string, pdf_url string, source string, version int")
LINE = ("doc_id string, version int, sequence int, asset_name string, txn_type string, txn_date date, notification_date date, amount_min long, "
        "amount_raw string, quality_flags array<string>")


def line(doc, version, n):
    return (doc, version, n, f"{doc}v{version}", "P", D(2024, 1, 1), D(2024, 1, 2), 1, "$1", [])


def test_store_first_wins_and_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    put = lambda number, docs, lines: store.store(spark, root, spark.createDataFrame(docs, REPORT), spark.createDataFrame(lines, LINE), number, ["version"])
    put(0, [report("a", "one", 1), report("a", "two", 2)], [line("a", 1, 0), line("a", 1, 1), line("a", 2, 0)])
    second = ([report("a", "three", 1), report("b", "four", 1)], [line("a", 1, 0), line("b", 1, 0)])
    put(1, *second)
    put(1, *second)
    f = tables.read_table(spark, root, "filings", schema.FILINGS)
    t = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS)
    assert {(r["doc_id"], r["first_name"], r["prefix"]) for r in f.collect()} == {("a", "one", None), ("b", "four", None)}
    assert sorted(r["asset_name"] for r in t.collect()) == ["av1", "av1", "bv1"]
    assert quality.orphans(t, f).count() == 0
    # an uncommitted batch is invisible
    f.limit(1).write.parquet(f"{root}/filings/batch_no=9/version=0")
    assert tables.read_table(spark, root, "filings", schema.FILINGS).count() == 2


def test_recompute_rewrites_only_changed_batches(spark, tmp_path):
    root = str(tmp_path / "store")
    late = ("b", 1, 0, "b", "P", D(2024, 6, 1), D(2024, 1, 2), 1, "$1", [])
    store.store(spark, root, spark.createDataFrame([report("a", "x", 1)], REPORT), spark.createDataFrame([line("a", 1, 0)], LINE), 0, ["version"])
    store.store(spark, root, spark.createDataFrame([report("b", "x", 1)], REPORT), spark.createDataFrame([late], LINE), 1, ["version"])
    before = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).select("id", "asset_name").collect()
    dry = recompute(spark, root, D(2024, 7, 1), dry_run=True)
    assert (dry.examined, dry.changed) == (2, 2)
    assert tables.next_version(spark, root, "transactions") == 1
    done = recompute(spark, root, D(2024, 7, 1))
    assert [r[0] for r in done.affected_documents.collect()] == ["a", "b"]
    flags = {r["asset_name"]: r["quality_flags"] for r in tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).collect()}
    assert flags == {"av1": ["notification_date_after_filing"],
                     "b": ["transaction_date_after_notification", "transaction_date_after_filing", "notification_date_after_filing"]}
    assert sorted(before) == sorted(tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).select("id", "asset_name").collect())
    assert recompute(spark, root, D(2024, 7, 1)).changed == 0
    assert recompute(spark, root, D(2024, 5, 1)).changed == 1
    versions = {(r["batch_no"], r["version"]) for r in tables.commits(spark, root).filter("table = 'transactions'").collect()}
    assert versions == {(0, 1), (1, 2)}


def test_ingest_run(spark, tmp_path):
    from disclosight.plans import report_html, report_text
    index = spark.createDataFrame([
        ("house_clerk", "20000001", 2024, D(2024, 1, 9), "Ann", "Doe", "CA01"), ("house_clerk", "20000001", 2024, D(2024, 1, 9), "Ann", "Doe", "CA01"),
        ("house_clerk", "8000001", 2024, D(2024, 1, 9), "Ann", "Doe", "CA01"), ("house_clerk", "20000002", 2024, D(2024, 1, 9), "Ann", "Doe", "CA01"),
        ("house_clerk", "20000003", 2024, None, "Ann", "Doe", "CA01"), ("senate_efd", "u-1", 2024, D(2024, 1, 9), "Al", "Arm", "OK00"),
        ("senate_efd", "u-2", 2024, None, "Al", "Arm", "OK00"), ("senate_efd", "u-3", 2024, D(2024, 1, 9), "Al", "Arm", "OK00")],
        "source string, doc_id string, year int, filing_date date, first string, last string, state_district string")
    head = "ID Owner Asset Transaction Date Notification Amount Cap.\n"
    html = "<tr>" + "".join(f"<td>{c}</td>" for c in ("1", "01/02/2024", "Self", "AB", "A", "Stock", "Purchase", "Over $5", "--")) + "</tr>"
    house = spark.createDataFrame([("20000001", head + "A (A) [ST] P 02/01/2024 01/02/2024 $1 - $2"),
                                   ("20000003", head + "A (A) [ST] P 02/30/2024 01/02/2024 $1")], "doc_id string, body string")
    senate = spark.createDataFrame([("u-1", html), ("u-2", html), ("u-3", " ")], "doc_id string, body string")
    docs, seen = house.unionByName(senate), []

    def parse(fresh):
        seen.append(sorted(r["doc_id"] for r in fresh.collect()))
        house = report_text.parse_text(fresh.filter("source = 'house_clerk'").select("doc_id", "body"))
        return house.unionByName(report_html.parse_html(fresh.filter("source = 'senate_efd'").select("doc_id", "body")))

    root = str(tmp_path / "run")
    targets = spark.createDataFrame([("house_clerk", 2024), ("house_clerk", 2019)], "source string, year int")
    failures = spark.createDataFrame([("senate_efd", 2020, "timed out")], "source string, year int, message string")
    every = ingest.run(spark, root, index, docs, parse, D(2024, 1, 15), targets=targets, failures=failures).collect()
    runs = {r["source"]: r for r in every if r["year_targets"] == ["2024"]}
    other = {(r["source"], r["year_targets"][0]): r for r in every if r["year_targets"] != ["2024"]}
    assert (other["house_clerk", "2019"]["status"], other["house_clerk", "2019"]["filings_indexed"]) == ("success", 0)
    assert (other["senate_efd", "2020"]["status"], other["senate_efd", "2020"]["error"]) == ("failed", "failed to fetch 2020 index: timed out")
    h, s = runs["house_clerk"], runs["senate_efd"]
    assert (h["filings_indexed"], h["filings_new"], h["filings_skipped"], h["scanned_skipped"], h["download_failed"], h["parse_failed"],
            h["transactions_stored"], h["status"]) == (5, 1, 1, 1, 1, 1, 1, "partial")
    assert (s["filings_new"], s["transactions_stored"], s["status"], s["error"]) == (2, 1, "partial", "store_failures=1")
    assert seen == [["20000001", "20000003", "u-1", "u-2", "u-3"]]
    lines = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).orderBy("asset_name", "owner_token").collect()
    flags = {r["ticker"]: r["quality_flags"] for r in lines}
    assert flags["A"] == ["transaction_date_after_notification", "transaction_date_after_filing", "transaction_date_after_ingestion_date"]
    assert [r["notification_date"] for r in lines if r["ticker"] == "AB"] == [D(2024, 1, 9)]
    filings, stored = (tables.read_table(spark, root, n, t).orderBy("id").collect() for n, t in (("filings", schema.FILINGS), ("transactions", schema.TRANSACTIONS)))
    # the same batch again changes nothing and reads nothing
    assert ingest.run(spark, root, index, docs, parse, D(2024, 1, 15), batch_no=0).count() == len(every) and len(seen) == 1
    # a further run reads only what is not stored yet
    again = ingest.run(spark, root, index, docs, parse, D(2024, 1, 16))
    assert again.count() == len(every) + 2 and seen[1] == ["20000003", "u-2"]
    assert tables.read_table(spark, root, "filings", schema.FILINGS).orderBy("id").collect() == filings
    assert tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).orderBy("id").collect() == stored


def test_a_failing_batch_leaves_the_old_rows(spark, tmp_path):
    import pytest
    root = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    kind = rows().schema
    tables.write_batch(spark, root, 0, things=rows(1, 2))
    bad = rows(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    for batch in (0, 1):
        if batch:
            with pytest.raises(Exception, match="lost"):
                tables.write_batch(spark, root, batch, things=rows(4), others=bad)
        else:
            tables.write_batch(spark, root, batch, things=bad)  # committed already
        assert sorted(r[0] for r in tables.read_table(spark, root, "things", kind).collect()) == [1, 2]
    tables.write_batch(spark, root, 1, things=rows(5))
    assert sorted(r[0] for r in tables.read_table(spark, root, "things", kind).collect()) == [1, 2, 5]
    assert tables.next_batch_no(spark, root) == 2 and tables.next_batch_no(spark, str(tmp_path / "none")) == 0


def test_ids_do_not_wrap(spark):
    import pytest
    from disclosight.functions import ids
    df = spark.range(3).select(F.col("id").cast("string").alias("doc_id"))
    top = with_batch_ids(df, ["doc_id"], (1 << ids.BATCH_BITS) - 1).agg(F.min("id"), F.max("id")).first()
    assert 0 < top[0] <= top[1]
    for bad in (1 << ids.BATCH_BITS, -1):
        with pytest.raises(ValueError):
            with_batch_ids(df, ["doc_id"], bad)
        with pytest.raises(Exception, match="does not fit"):
            with_batch_ids(df, ["doc_id"], F.lit(bad)).collect()


def test_target_years():
    assert ingest.target_years(None, True, 2022, 2024) == [2022, 2023, 2024]
    assert ingest.target_years(2020, False, 2022, 2024) == [2020]


def test_sessions_merge_at_the_gap(spark):
    rows = [("P", "A", dt.datetime(2024, 1, d), p) for d, p in ((1, "x"), (8, "y"), (15, "z"), (23, "x"))]
    df = spark.createDataFrame(rows, "txn_type string, ticker string, txn_time timestamp, person_key string")
    counted = bursts.with_people(bursts.session_bursts(df), df)
    found = counted.orderBy("start_date").collect()
    assert [(r["span_days"], r["politician_count"]) for r in found] == [(14, 3), (0, 1)]
    assert bursts.qualifying(counted).count() == 1


def test_a_document_landed_twice_is_one(spark, tmp_path):
    from disclosight.plans import report_text
    index = spark.createDataFrame([("house_clerk", f"2000000{n}", 2024, D(2024, 3, 9), "Ann", "Doe", "CA01") for n in (1, 2, 3)],
                                  "source string, doc_id string, year int, filing_date date, first string, last string, state_district string")
    head = "ID Owner Asset Transaction Date Notification Amount Cap.\n"
    body = lambda name: f"{head}{name} ({name}) [ST] P 01/02/2024 01/03/2024 $1 - $2"
    docs = spark.createDataFrame([("20000001", body("FOO"), "b"), ("20000001", body("FOO"), "a"), ("20000002", body("NEW"), "b"), ("20000002", body("OLD"), "a"),
                                  ("20000002", body("OLD"), "a"), ("20000003", body("ONE"), "a")], "doc_id string, body string, path string")
    parse = lambda fresh: report_text.parse_text(fresh.select("doc_id", "body"))
    judged = ingest.decide(index, docs, parse, spark.createDataFrame([], "doc_id string"), str(tmp_path / "work")).outcomes
    assert {r["doc_id"]: (r["outcome"], r["conflict"]) for r in judged.collect()} == {
        "20000001": ("new", False), "20000002": ("new", True), "20000003": ("new", False)}
    root = str(tmp_path / "twice")
    account = ingest.run(spark, root, index, docs, parse, D(2024, 3, 15)).first()
    assert (account["filings_new"], account["transactions_stored"]) == (3, 3)
    lines = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).collect()
    assert sorted((r["ticker"], r["sequence"]) for r in lines) == [("FOO", 0), ("OLD", 0), ("ONE", 0)]


def folder_size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_patches_are_laid_over_their_batches(spark, tmp_path):
    import pytest
    root = str(tmp_path / "store")
    docs = [f"d{n:05d}" for n in range(3000)]
    for number, part in enumerate((docs[:2000], docs[2000:])):
        store.store(spark, root, spark.createDataFrame([report(d, "x", 1) for d in part], REPORT), spark.createDataFrame([line(d, 1, 0) for d in part], LINE),
                    number, ["version"])
    read = lambda: {r["asset_name"]: r for r in tables.read_batches(spark, root, "transactions", schema.TRANSACTIONS).collect()}
    before = read()
    batch_bytes = folder_size(tmp_path / "store" / "transactions")
    change = lambda rows, kind: spark.createDataFrame([(before[name]["batch_no"], before[name]["id"], *values) for name, *values in rows], f"batch_no long, id long, {kind}")
    flags = change([("d00001v1", ["f"]), ("d02500v1", ["g"])], "quality_flags array<string>")
    assert tables.write_patch(flags, root, "transactions", ["quality_flags"]) == 1
    assert folder_size(tmp_path / "store" / "transactions-patches") < batch_bytes / 10
    note = change([("d00001v1", "n1", "low"), ("d00002v1", "n2", None)], "verification_note string, verification_confidence string")
    tables.write_patch(note, root, "transactions", ["verification_note", "verification_confidence"])
    tables.write_patch(change([("d00001v1", None)], "verification_note string"), root, "transactions", ["verification_note"])
    # an attempt that never committed stays invisible
    flags.withColumn("_set", F.array(F.lit("quality_flags"))).write.partitionBy("batch_no").parquet(f"{root}/transactions-patches/version=9")
    after = read()
    shown = lambda r: (r["quality_flags"], r["verification_note"], r["verification_confidence"], r["version"])
    assert shown(after["d00001v1"]) == (["f"], None, "low", 0) and shown(after["d00002v1"]) == ([], "n2", None, 0) and shown(after["d02500v1"]) == (["g"], None, None, 0)
    assert {n: r for n, r in after.items() if n not in ("d00001v1", "d00002v1", "d02500v1")} == {
        n: r for n, r in before.items() if n not in ("d00001v1", "d00002v1", "d02500v1")}
    with pytest.raises(ValueError, match="never change"):
        tables.write_patch(flags, root, "transactions", ["asset_name"])
    # a patch of one batch compacts that batch only, and later patches lie over the new version
    assert tables.compact(spark, root, "transactions", schema.TRANSACTIONS) == 2
    folded = read()
    assert {n: shown(r)[:3] for n, r in folded.items()} == {n: shown(r)[:3] for n, r in after.items()} and {r["version"] for r in folded.values()} == {4}
    tables.write_patch(change([("d02999v1", ["h"])], "quality_flags array<string>"), root, "transactions", ["quality_flags"])
    assert read()["d02999v1"]["quality_flags"] == ["h"] and read()["d00001v1"]["quality_flags"] == ["f"]
    assert tables.compact(spark, root, "transactions", schema.TRANSACTIONS) == 1 and tables.compact(spark, root, "transactions", schema.TRANSACTIONS) == 0
    assert {r["version"] for r in read().values()} == {4, 6}


def test_recompute_as_patch_equals_the_rewrite(spark, tmp_path):
    late = ("b", 1, 0, "b", "P", D(2024, 6, 1), D(2024, 1, 2), 1, "$1", [])
    results = []
    for rewrite in (True, False):
        root = str(tmp_path / f"store-{rewrite}")
        store.store(spark, root, spark.createDataFrame([report("a", "x", 1), report("b", "x", 1)], REPORT), spark.createDataFrame([line("a", 1, 0), late], LINE), 0, ["version"])
        assert recompute(spark, root, D(2024, 7, 1), rewrite=rewrite).changed == 2
        assert recompute(spark, root, D(2024, 7, 1), rewrite=rewrite).changed == 0
        results.append(sorted(tables.read_table(spark, root, "transactions", schema.TRANSACTIONS).collect()))
    assert results[0] == results[1]


def test_links_as_patch(spark, tmp_path):
    from disclosight.plans import curate
    root = str(tmp_path / "store")
    store.store(spark, root, spark.createDataFrame([report("a", "x", 1), report("b", "x", 1)], REPORT), spark.createDataFrame([line("a", 1, 0)], LINE), 0, ["version"])
    kind = ("decision_no long, action string, amended_doc_id string, original_doc_id string, method string, confidence string, note string, verified_at timestamp")
    links = lambda *rows: curate.store_amendment_links(spark, root, spark.createDataFrame(list(rows), kind))
    bad = links((1, "link", "b", "a", "manual_review", "high", None, None), (2, "link", "b", "zz", "manual_review", "high", None, None))
    assert [r["reason"] for r in bad.collect()] == ["unknown original filing"]
    stored = lambda: {r["doc_id"]: r for r in tables.read_table(spark, root, "filings", schema.FILINGS).collect()}
    assert stored()["b"]["amends_filing_id"] == stored()["a"]["id"] and stored()["b"]["amendment_method"] == "manual_review"
    links((3, "clear", "b", None, None, None, None, None))
    assert stored()["b"]["amends_filing_id"] is None and stored()["b"]["amendment_method"] is None
    assert links((4, "link", "q", "a", "manual_review", "high", None, None)).count() == 1 and tables.next_version(spark, root, "filings") == 3
