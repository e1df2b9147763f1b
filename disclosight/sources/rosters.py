"""Membership rosters: stored snapshots and the raw legislator records behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.checks import fail_closed

ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _iso(col: Column) -> Column:
    return F.when(col.rlike(ISO_DAY), F.try_to_date(col, "yyyy-MM-dd"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def check_members(members: DataFrame, house: bool) -> DataFrame:
    """Member rows with typed terms; the job fails on the first unusable member."""
    bad_term = lambda t: (_iso(t["start"]).isNull()
                          | (t["end"].isNotNull() & _iso(t["end"]).isNull())
                          | (t["district"].isNull() if house else F.lit(False)))
    problem = F.coalesce(
        F.when(~(_filled("bioguide_id") & _filled("last_name") & _filled("first_name") & _filled("state")),
               F.lit("missing identity")),
        F.when(F.coalesce(F.size("terms"), F.lit(0)) <= 0, F.lit("no terms")),
        F.when(F.exists("terms", lambda t: t.isNull()), F.lit("non-object term")),
        F.when(F.exists("terms", bad_term), F.lit("malformed term")))
    if house:
        problem = F.coalesce(
            problem, F.when(F.col("last_name_alt").isNotNull(), F.lit("retired last_name_alt field")),
            F.when(F.exists(F.coalesce("last_name_alts", F.array().cast("array<string>")),
                            lambda a: F.coalesce(F.trim(a), F.lit("")) == ""), F.lit("malformed last_name_alts")))
    checked = fail_closed(members, problem.isNull(), F.concat(
        F.lit("roster member "), F.coalesce("bioguide_id", F.lit("?")), F.lit(": "), F.coalesce(problem, F.lit(""))))
    fields = lambda t: [_iso(t["start"]).alias("start"), _iso(t["end"]).alias("end"),
                        *([t["district"].alias("district")] if house else [])]
    alts = [F.transform(F.coalesce("last_name_alts", F.array().cast("array<string>")),
                        lambda a: F.trim(a)).alias("last_name_alts")]
    return checked.select(
        "bioguide_id", "last_name", "first_name",
        F.coalesce(F.nullif("given_name", F.lit("")), "first_name").alias("given_name"),
        *(alts if house else []), "state", "party",
        F.transform("terms", lambda t: F.struct(*fields(t))).alias("terms"))


def _read_snapshot(spark: SparkSession, path: str, house: bool, multi_line: bool) -> DataFrame:
    term = schema.HOUSE_TERM if house else schema.SENATE_TERM
    raw = spark.read.schema(schema.roster_snapshot(term)).option("multiLine", multi_line).json(path)
    usable = F.col("_corrupt_record").isNull() & (F.coalesce(F.size("members"), F.lit(0)) > 0)
    snapshot = fail_closed(raw, usable, "roster snapshot is malformed or holds no members")
    return check_members(snapshot.select(F.inline("members")), house)


def read_house_roster(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Members of snapshot files; ``multi_line=False`` reads one snapshot object per line."""
    return _read_snapshot(spark, path, True, multi_line)


def read_senate_roster(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _read_snapshot(spark, path, False, multi_line)


def read_raw_records(spark: SparkSession, historical: str, current: str, multi_line: bool = True) -> DataFrame:
    """Raw legislator records of both files (JSON arrays, or one record per line), by origin."""
    def read(path: str, origin: int) -> DataFrame:
        raw = spark.read.schema(schema.RAW_RECORD).option("multiLine", multi_line).json(path)
        checked = fail_closed(raw, F.col("_corrupt_record").isNull(), f"{path} is not an array of records")
        return checked.drop("_corrupt_record").withColumn("origin", F.lit(origin))
    return read(historical, 0).unionByName(read(current, 1))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Members in name order, as JSON lines."""
    (snapshot.orderBy(F.lower("last_name"), F.lower("first_name"), "bioguide_id")
     .write.mode("overwrite").json(path))
