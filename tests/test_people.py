import datetime as dt

import pytest
from pyspark.sql import functions as F

from disclosight.functions import names
from disclosight.plans import resolve, roster

MEMBER = ("bioguide_id string, last_name string, first_name string, given_name string, last_name_alts array<string>, state string, "
          "party string, terms array<struct<start:date,end:date,district:bigint>>")


def day(text):
    return dt.date.fromisoformat(text) if text else None


def members(spark, *rows):
    return spark.createDataFrame([(i, last, first, given or first, alts, state, None, [(day(s), day(e), 1) for s, e in terms])
                                  for i, last, first, given, alts, state, terms in rows], MEMBER)


ROSTER = [
    ("P1", "Payne", "Donald", "Donald M.", [], "NJ", [("1989-01-03", "2012-03-06")]),
    ("P2", "Payne", "Donald", "Donald M.", [], "NJ", [("2012-11-15", "2024-04-24")]),
    ("S1", "Sánchez", "Linda", "Linda T.", [], "CA", [("2003-01-07", None)]),
    ("L1", "Luna", "Anna", "Anna Paulina", ["Paulina Luna"], "FL", [("2023-01-03", None)]),
    ("H1", "O’Halleran", "Thomas", "Tom", [], "AZ", [("2017-01-03", "2023-01-03")]),
    ("G1", "Green", "Mark", "Mark E.", [], "TN", [("2019-01-03", "2021-01-03"), ("2022-01-03", "2025-07-20")]),
]


def house(spark, *filers):
    df = spark.createDataFrame([(f"d{i}", *f[:3], day(f[3])) for i, f in enumerate(filers)],
                               "doc_id string, state_district string, last string, first string, filing_date date")
    rows = resolve.resolve_house(df, members(spark, *ROSTER)).orderBy("doc_id").collect()
    return [(r["status"], r["bioguide_id"]) for r in rows]


def test_house_decisions(spark):
    assert house(
        spark, ("NJ10", "Payne", "Donald", "2011-06-01"), ("NJ10", "Payne", "Donald", None), ("NJ10", "Payne", "Donald", "2012-06-01"),
        ("CA38", "SANCHEZ", "Linda", "2024-01-01"), ("FL13", "Paulina Luna", "Anna", "2024-01-01"), ("AZ01", "O'Halleran, MD, FACS", "Tom", "2023-01-03"),
        ("AZ01", "O'Halleran", "Tommy", "2023-01-04"), ("TN07", "Green", "Mark", "2021-06-01"), ("X", "Green", "Mark", "2024-01-01"),
    ) == [("resolved", "P1"), ("ambiguous", None), ("ambiguous", None), ("resolved", "S1"), ("resolved", "L1"), ("resolved", "H1"),
          ("resolved_post_service", "H1"), ("not_serving", None), ("no_state", None)]


def test_house_never_guesses(spark):
    assert house(spark, ("CA38", "Sanchez", "L.", "2024-01-01"), ("CA38", "Sanches", "Linda", "2024-01-01"),
                 ("NY01", "Luna", "Anna", "2024-01-01")) == [("no_match", None)] * 3


def test_strict_fails(spark):
    df = spark.createDataFrame([("d", "TN07", "Nobody", "Mark", day("2020-01-01"))],
                               "doc_id string, state_district string, last string, first string, filing_date date")
    with pytest.raises(Exception, match="no_match"):
        resolve.resolve_house(df, members(spark, *ROSTER), strict=True).collect()


def test_senate_decisions(spark):
    roster_ = members(spark, ("A", "Mullin", "Markwayne", "Markwayne", [], "OK", [("2023-01-03", "2026-03-23")]),
                      ("B", "Justice", "James", "Jim", [], "WV", [("2025-01-14", None)]),
                      ("C", "Graham", "Lindsey", "Lindsey", [], "SC", [("2003-01-07", "2026-07-11")]))
    current = spark.createDataFrame([("graham", "darline", "SC"), ("smith", "jim", "AA"), ("smith", "james", "BB")],
                                    "last_key string, first_key string, state string")
    filers = spark.createDataFrame([
        ("1", "Graham", "Darline", "x (Senator)", day("2026-08-01")), ("2", "Mullin", "Markwayne", "x (Senator)", day("2026-03-23")),
        ("3", "Mullin", "Markwayne", "x (Former Senator)", day("2026-05-01")), ("4", "Mullin", "Markwayne", "x (Senator)", day("2026-05-01")),
        ("5", "Justice II", "James", "x (Senator)", day("2025-02-01")), ("6", "Smith", "James", "x (Senator)", day("2025-02-01")),
        ("7", "Nobody", "Al", "x (Senator)", None)], "doc_id string, last string, first string, office string, filing_date date")
    rows = resolve.resolve_senate(filers, current, roster_).orderBy("doc_id").collect()
    assert [(r["status"], r["state_district"]) for r in rows] == [
        ("resolved_current", "SC00"), ("resolved", "OK00"), ("resolved_post_service", "OK00"), ("unresolved", None), ("resolved", "WV00"),
        ("ambiguous", None), ("unresolved", None)]


def test_given_names(spark):
    pairs = [("A. Mitchell Jr.", "Mitch", None, True), ("Dana", "Dan", None, False), ("J.D.", "James David", "J.D.", True),
             ("Patrick", "Patrick", "Pat", True), ("Chris", "Christopher", None, True), ("Ted", "Edward", None, True),
             ("C.", "Charles", "C. Scott", False), ("", "Al", None, False), ("B", "B", None, True)]
    df = spark.createDataFrame([p[:3] for p in pairs], "f string, o string, g string")
    fold = lambda c: names.fold_name(F.coalesce(F.col(c), F.lit("")))
    got = [r[0] for r in df.select(names.given_names_agree(fold("f"), fold("o"), fold("g"))).collect()]
    assert got == [p[3] for p in pairs]


def test_fold_and_surname_keys(spark):
    df = spark.createDataFrame([("  Luján  Ñ",), ("O’HALLERAN",), ("ﬁeld",), ("Dunn, MD, FACS",), ("MD",), ("Justice II",), ("III",)], "n string")
    rows = df.select(names.fold_name(df["n"]).alias("k")).select("k", names.house_surname(F.col("k")), names.senate_surname(F.col("k"))).collect()
    assert [r[0] for r in rows[:3]] == ["lujan n", "o'halleran", "field"]
    assert (rows[3][1], rows[4][1]) == ("dunn", "md") and (rows[5][2], rows[6][2]) == ("justice", "iii")


def record(i, first, last, full, terms, middle=None):
    return ((i,), (first, middle, last, None, full), terms)


RAW = ("id struct<bioguide:string>, name struct<first:string,middle:string,last:string,suffix:string,official_full:string>, "
       "terms array<struct<type:string,start:string,end:string,district:bigint,state:string,party:string>>")


def test_house_snapshot(spark):
    rep = lambda s, e, d=1, st="XX": ("rep", s, e, d, st, "")
    raw = spark.createDataFrame([
        record("M1", "Joe", "Manchin", "Joe Manchin, III", [rep("2001-01-03", "2003-01-03"), rep("1999-01-06", "2000-01-01", 2)]),
        record("M2", "April", "McClain Delaney", "April McClain Delaney", [rep("2025-01-03", None)], "Lynn"),
        record("M3", "Anna", "Luna", "Anna Paulina Luna", [rep("2023-01-03", "")]),
        record("M4", "Old", "Timer", "Old Timer", [rep("1990-01-03", "1999-12-31")]),
        record("M5", "Eric", "Massa", None, [rep("2009-01-03", "2010-03-08")], "J. J.")], RAW)
    rows = {r["bioguide_id"]: r for r in roster.house_snapshot(raw, "2026-01-01").collect()}
    assert set(rows) == {"M1", "M2", "M3", "M5"}
    assert rows["M1"]["last_name"] == "Manchin" and [t["start"] for t in rows["M1"]["terms"]] == ["1999-01-06", "2001-01-03"]
    assert (rows["M2"]["given_name"], rows["M2"]["last_name_alts"]) == ("April", ["Delaney"])
    assert rows["M3"]["last_name_alts"] == ["Paulina Luna"] and rows["M3"]["terms"][0]["end"] is None and rows["M3"]["party"] is None
    assert (rows["M5"]["given_name"], rows["M5"]["last_name_alts"]) == ("Eric J. J.", [])


def test_unusable_records_and_stale_corrections_fail(spark):
    bad = spark.createDataFrame([record("M1", "A", "B", "A B", [("rep", "2001-01-03", None, None, "XX", "")])], RAW)
    with pytest.raises(Exception, match="unusable term"):
        roster.house_snapshot(bad, "2026-01-01").collect()
    sen = spark.createDataFrame([record("V000137", "J", "Vance", "J Vance", [("sen", "2023-01-04", "2025-01-09", None, "OH", "R")])], RAW)
    with pytest.raises(Exception, match="stale service correction"):
        roster.senate_snapshot(sen, "2026-01-01", roster.verified_corrections(spark)).collect()


def test_bucket_diff(spark):
    """The differences of two large snapshots, from the buckets that differ alone."""
    rows = [(f"M{i}", f"Name{i % 50}", None if i % 9 == 0 else "Ann", "A", [], "NJ", "I" if i % 7 else None, [(day("2001-01-03"), None, i % 12)]) for i in range(3000)]
    old = spark.createDataFrame(rows, MEMBER)
    assert roster.differing_buckets(old, old.repartition(5), roster.HOUSE_FIELDS, 64).count() == 0
    assert roster.bucket_diff(old, old.repartition(5)).count() == 0
    changed = [list(r) for r in rows if r[0] not in ("M5", "M6")] + [["N1", "New", "Eve", "E", [], "TX", None, []]]
    changed[0][2], changed[0][6] = "I", "I"
    changed[20][7] = [(day("2001-01-03"), day("2005-01-03"), 20 % 12)]
    changed[30][5], changed[30][6] = None, "NJ"
    changed[31][4] = ["not compared"]
    new = spark.createDataFrame(changed, MEMBER)
    for fields in (roster.HOUSE_FIELDS, roster.SENATE_FIELDS):
        want = {tuple(r) for r in roster.snapshot_diff(old, new, fields).collect()}
        for buckets in (1, 64, 4096):
            got = [tuple(r) for r in roster.bucket_diff(old, new, fields, buckets).collect()]
            assert set(got) == want and len(got) == len(want)
    assert {(r[0], r[1]) for r in want} == {("M5", "removed"), ("M6", "removed"), ("N1", "added"), (changed[0][0], "changed"), (changed[20][0], "changed"), (changed[30][0], "changed")}
    open_ = roster.differing_buckets(old, new, roster.HOUSE_FIELDS, 4096)
    assert open_.count() <= 6
    empty = old.limit(0)
    assert roster.bucket_diff(empty, empty).count() == 0
    assert {r.kind for r in roster.bucket_diff(empty, old).collect()} == {"added"} and roster.bucket_diff(old, empty).count() == 3000


def test_bucket_diff_filters_before_the_join(spark, capsys):
    """Both sides are filtered by the sent table of differing buckets, and nothing is compared row by row with all rows."""
    old = spark.createDataFrame([(f"M{i}", "A", "B", "B", [], "NJ", None, []) for i in range(200)], MEMBER)
    new = old.withColumn("party", F.when(F.col("bioguide_id") == "M7", "I").otherwise(F.col("party")))
    roster.bucket_diff(old, new).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin [bucket") + plan.count("LeftSemi") >= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
