"""Roster snapshots from raw legislator records, service corrections and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import names
from ..functions.checks import fail_closed, settle


def _text(path: str) -> Column:
    return F.trim(F.coalesce(F.col(path), F.lit("")))


def overlapping_terms(terms: Column, kind: str, start: str, end: Column) -> Column:
    """Terms of one chamber that touch the inclusive ISO range."""
    blank = F.lit("")
    def touches(t: Column) -> Column:
        first, last = F.trim(F.coalesce(t["start"], blank)), F.trim(F.coalesce(t["end"], blank))
        return ((F.trim(t["type"]) == kind) & (first != "") & (first <= end)
                & ((last == "") | (last >= start)))
    return F.filter(F.coalesce(terms, F.array().cast(f"array<{_TERM}>")), touches)


_TERM = "struct<type:string,start:string,end:string,district:bigint,state:string,party:string>"


def _members(records: DataFrame, kind: str, as_of, history_start: str) -> DataFrame:
    end = F.lit(as_of if isinstance(as_of, str) else as_of.isoformat())
    surname = names.official_surname(F.col("name.last"), F.col("name.official_full"))
    given = names.official_given(F.col("name.first"), F.col("name.middle"), F.col("name.last"),
                                 F.col("name.official_full"))
    base = records.select(
        _text("id.bioguide").alias("bioguide_id"), surname.alias("last_name"),
        _text("name.first").alias("first_name"), given.alias("_given"),
        F.col("name.official_full").alias("_full"), "terms",
        overlapping_terms(F.col("terms"), kind, history_start, end).alias("_kept"))
    identified = (F.col("bioguide_id") != "") & (F.col("first_name") != "") & (F.col("last_name") != "")
    dated = F.forall("_kept", lambda t: t["start"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    if kind == "rep":
        dated = dated & F.forall("_kept", lambda t: t["district"].isNotNull())
    fail = lambda text: F.raise_error(F.concat(F.lit(text), "bioguide_id")).cast("boolean")
    keep = (F.when(~identified, fail("record without id or name: ")).when(~dated, fail("unusable term of "))
            .otherwise(F.size("_kept") > 0))
    sample = F.try_element_at(F.filter("terms", lambda t: t["type"] == kind), F.lit(1))
    return (settle(base, keep)
            .withColumn("state", F.trim(F.coalesce(sample["state"], F.lit(""))))
            .withColumn("party", F.nullif(F.trim(F.coalesce(sample["party"], F.lit(""))), F.lit(""))))


def _terms(district: bool) -> Column:
    def one(t: Column) -> Column:
        fields = [t["start"].alias("start"), F.nullif(t["end"], F.lit("")).alias("end")]
        return F.struct(*fields, *([t["district"].alias("district")] if district else []))
    return F.array_sort(F.transform("_kept", one), lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1).otherwise(0))


def house_snapshot(records: DataFrame, as_of, history_start: str = fv.ROSTER_HISTORY_START) -> DataFrame:
    """Members with House service since ``history_start``; no shuffle, one record at a time."""
    members = _members(records, "rep", as_of, history_start)
    return members.select(
        "bioguide_id", "last_name", "first_name", F.array_join("_given", " ").alias("given_name"),
        names.alternate_surnames(F.col("_given"), F.col("last_name"), F.col("_full")).alias("last_name_alts"),
        "state", "party", _terms(True).alias("terms"))


def senate_snapshot(records: DataFrame, as_of, corrections: DataFrame | None = None,
                    history_start: str = fv.ROSTER_HISTORY_START) -> DataFrame:
    """Members with Senate service since ``history_start``, with verified term ends applied."""
    members = _members(records, "sen", as_of, history_start)
    given = F.coalesce(F.nullif(F.array_join("_given", " "), F.lit("")), F.col("first_name"))
    out = members.select("bioguide_id", "last_name", "first_name", given.alias("given_name"), "state",
                         "party", _terms(False).alias("terms"))
    return out if corrections is None else apply_corrections(out, corrections)


def verified_corrections(spark) -> DataFrame:
    return spark.createDataFrame(list(fv.SENATE_SERVICE_CORRECTIONS),
                                 "bioguide_id string, start string, end string")


def apply_corrections(members: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace the end of the term a correction names.

    Fails when a member of the snapshot no longer has that term. A member has a handful of
    corrections at most, so they travel as one small array per member.
    """
    per_member = corrections.groupBy("bioguide_id").agg(
        F.collect_list(F.struct("start", "end")).alias("_fixes"))
    joined = members.join(per_member, "bioguide_id", "left")
    stale = F.exists("_fixes", lambda c: ~F.exists("terms", lambda t: t["start"] == c["start"]))
    checked = fail_closed(joined, ~F.coalesce(stale, F.lit(False)),
                          F.concat(F.lit("stale service correction of "), "bioguide_id"))

    def fixed(t: Column) -> Column:
        match = F.filter("_fixes", lambda c: c["start"] == t["start"])
        return F.struct(t["start"].alias("start"),
                        F.coalesce(F.try_element_at(match, F.lit(1))["end"], t["end"]).alias("end"))
    return (checked.withColumn("terms", F.when(F.col("_fixes").isNull(), F.col("terms"))
                               .otherwise(F.transform("terms", fixed))).select(*members.columns))


HOUSE_FIELDS = ("last_name", "first_name", "state", "party", "terms")
SENATE_FIELDS = ("last_name", "first_name", "given_name", "state", "party", "terms")


def snapshot_diff(committed: DataFrame, fresh: DataFrame, fields: tuple[str, ...] = HOUSE_FIELDS) -> DataFrame:
    """Added, removed and changed members: one row per member and differing field."""
    old = committed.select("bioguide_id", F.struct(*fields).alias("old"))
    new = fresh.select("bioguide_id", F.struct(*fields).alias("new"))
    both = old.join(new, "bioguide_id", "full_outer")
    shown = lambda side, f: F.to_json(F.struct(F.col(f"{side}.{f}").alias("v")))
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")),
               F.struct(F.lit(f).alias("field"), shown("old", f).alias("committed"), shown("new", f).alias("fresh")))
        for f in fields]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("committed"),
                             F.lit(None).cast("string").alias("fresh")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return (both.select("bioguide_id", kind.alias("kind"),
                        F.explode(F.when(kind == "changed", changed).otherwise(whole)).alias("_d"))
            .select("bioguide_id", "kind", "_d.*"))


def bucket_digests(members: DataFrame, fields: tuple[str, ...], buckets: int) -> DataFrame:
    """``(bucket, n, low, high)``: per hash bucket of the id the rows and the sums of two 60-bit digests of them.

    Sums combine on the map side: at most ``buckets`` rows a task cross the network, whatever the snapshot holds.
    """
    shown = F.md5(F.to_json(F.struct("bioguide_id", *fields), {"ignoreNullFields": "false"}))
    part = lambda start: F.conv(F.substring(shown, start, 15), 16, 10).cast("decimal(20,0)")
    return (members.select(_bucket(buckets), part(1).alias("low"), part(17).alias("high")).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("bioguide_id"), F.lit(buckets)).cast("int").alias("bucket")


def differing_buckets(committed: DataFrame, fresh: DataFrame, fields: tuple[str, ...], buckets: int) -> DataFrame:
    """``(bucket)``: hash buckets whose rows are not the same on both sides, at most ``buckets`` rows."""
    both = bucket_digests(committed, fields, buckets).alias("o").join(
        bucket_digests(fresh, fields, buckets).alias("f"), "bucket", "full_outer")
    same = F.lit(True)
    for c in ("n", "low", "high"):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}"))
    return both.where(~same).select("bucket")


def bucket_diff(committed: DataFrame, fresh: DataFrame, fields: tuple[str, ...] = HOUSE_FIELDS, buckets: int = 4096) -> DataFrame:
    """``snapshot_diff`` of large snapshots that are mostly the same: only members of buckets that differ are joined.

    Both snapshots are read twice, first for one digest row per bucket; members of equal buckets do not reach a shuffle. The table of
    differing buckets has at most ``buckets`` rows and is sent to every task. Choose several times as many buckets as
    members change. An id appears once a snapshot and is never NULL, as ``snapshot_diff`` has it.
    """
    open_ = F.broadcast(differing_buckets(committed, fresh, fields, buckets))
    kept = lambda side: side.withColumn("bucket", _bucket(buckets)).join(open_, "bucket", "left_semi").drop("bucket")
    return snapshot_diff(kept(committed), kept(fresh), fields)
