"""Filer names to roster members: exact surname, bounded given-name relation, service dates.

Names are matched by equality on (state, surname key, given-name token). Both sides are exploded
to the few tokens a name has, nickname relations included on the roster side, so the join only
meets pairs whose names really agree. Filers are de-duplicated first: one person filing a third of
all reports is one row per filing date here. How many members match is decided by comparing the
smallest and the largest matching id, so no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.checks import fail_closed
from ..functions.documents import is_former_senator

RESOLVED = ("resolved", "resolved_post_service", "resolved_current")


def serves_on(terms: Column, day: Column) -> Column:
    """Some term covers ``day``; both ends count and a missing end is open."""
    return F.exists(terms, lambda t: (t["start"] <= day) & (t["end"].isNull() | (day <= t["end"])))


def ended_before(terms: Column, day: Column) -> Column:
    """Every term had ended before ``day``."""
    return F.forall(terms, lambda t: t["end"].isNotNull() & (t["end"] < day))


def _filer_tokens(filers: DataFrame, key: list[str], surname) -> DataFrame:
    folded = filers.select(*key).distinct().withColumn("_last", names.fold_name(F.col("last"))).withColumn(
        "_first", names.fold_name(F.col("first")))
    return folded.withColumn("surname", surname(F.col("_last"))).withColumn(
        "token", F.explode(names.given_tokens(F.col("_first")))).drop("_first")


def _member_tokens(members: DataFrame, surname, spellings: Column) -> DataFrame:
    """One row per member, surname spelling and given-name token a filer may use."""
    spelled = members.withColumn("_spelling", F.explode(F.array_distinct(spellings)))
    folded = spelled.select(
        "bioguide_id", "state", "terms", surname(names.fold_name(F.col("_spelling"))).alias("surname"),
        names.fold_name(F.col("first_name")).alias("_first"), names.fold_name(F.col("given_name")).alias("_given"))
    tokens = names.expand_tokens(names.official_tokens(F.col("_first"), F.col("_given")))
    return folded.withColumn("token", F.explode(tokens)).drop("_first", "_given")


def _match_summary(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Per filer: smallest and largest id of all agreeing members and of those in service."""
    in_service = F.col("filing_date").isNull() | serves_on(F.col("terms"), F.col("filing_date"))
    who = F.struct("bioguide_id", "state")
    serving = F.when(in_service, who)
    return pairs.groupBy(*key).agg(
        F.min(who).alias("ident_low"), F.max(who).alias("ident_high"),
        F.min(serving).alias("hit_low"), F.max(serving).alias("hit_high"),
        F.bool_and(F.coalesce(ended_before(F.col("terms"), F.col("filing_date")), F.lit(False))).alias("all_ended"))


def _none(low: str) -> Column:
    return F.col(low).isNull()


def _one(low: str, high: str) -> Column:
    return F.coalesce(F.col(f"{low}.bioguide_id") == F.col(f"{high}.bioguide_id"), F.lit(False))


def _attach(filers: DataFrame, summary: DataFrame, key: list[str]) -> DataFrame:
    right = summary.select(*[F.col(c).alias(f"_k_{c}") for c in key],
                           *[c for c in summary.columns if c not in key])
    same = F.lit(True)
    for column in key:
        same = same & filers[column].eqNullSafe(right[f"_k_{column}"])
    return filers.join(right, same, "left").drop(*[f"_k_{c}" for c in key])


def _house_pairs(filers: DataFrame, members: DataFrame) -> DataFrame:
    spellings = F.concat(F.array("last_name"), F.col("last_name_alts"))
    roster = _member_tokens(members, names.house_surname, spellings)
    wanted = _filer_tokens(filers.filter(F.length("state") == 2), HOUSE_KEY, names.house_surname)
    return wanted.join(roster, ["state", "surname", "token"])


HOUSE_KEY = ["state", "last", "first", "filing_date"]


def _with_state(filers: DataFrame) -> DataFrame:
    state = F.upper(F.substring(F.trim(F.coalesce("state_district", F.lit(""))), 1, 2))
    return filers.withColumn("state", state)


def serving_matches(filers: DataFrame, members: DataFrame) -> DataFrame:
    """Per filed document the smallest and largest id of matching members in service that day."""
    keyed = _with_state(filers)
    summary = _match_summary(_house_pairs(keyed, members), HOUSE_KEY).filter(F.col("hit_low").isNotNull())
    return _attach(keyed, summary, HOUSE_KEY).filter(F.col("hit_low").isNotNull()).select(
        "doc_id", F.col("hit_low.bioguide_id").alias("low"), F.col("hit_high.bioguide_id").alias("high"))


def resolve_house(filers: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``status`` and ``bioguide_id`` to House filers.

    ``filers`` needs state_district, last, first and filing_date. A member whose whole service
    ended before the filing date resolves as post-service. ``strict`` fails the job on the first
    filer that is not resolved.
    """
    keyed = _with_state(filers)
    joined = _attach(keyed, _match_summary(_house_pairs(keyed, members), HOUSE_KEY), HOUSE_KEY)
    one_hit, one_ident = _one("hit_low", "hit_high"), _one("ident_low", "ident_high")
    status = (F.when(F.length("state") < 2, "no_state").when(one_hit, "resolved")
              .when(~_none("hit_low"), "ambiguous").when(_none("ident_low"), "no_match")
              .when(~one_ident, "ambiguous").when(F.col("all_ended"), "resolved_post_service")
              .otherwise("not_serving"))
    out = joined.withColumn("status", status).withColumn(
        "bioguide_id", F.when(F.col("status").isin(*RESOLVED),
                              F.coalesce("hit_low.bioguide_id", "ident_low.bioguide_id")))
    return _finish(out, filers.columns, ["status", "bioguide_id"], strict)


def resolve_senate(filers: DataFrame, current: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``status`` and ``state_district`` (state and ``00``) to Senate filers.

    ``filers`` needs last, first, office and filing_date. ``current`` is the listing of sitting
    senators; a unique match there wins, then the roster with service dates decides.
    """
    key = ["last", "first", "filing_date"]
    wanted = _filer_tokens(filers, key, lambda folded: folded)
    listing = current.select(
        F.col("last_key").alias("surname"), "first_key", F.col("state").alias("listed_state"),
        F.explode(names.expand_tokens(names.official_tokens(F.col("first_key"), F.lit("")))).alias("token"))
    entry = F.struct("first_key", "listed_state")
    listed = (wanted.join(listing, ["surname", "token"]).groupBy(*key)
              .agg(F.min(entry).alias("listed_low"), F.max(entry).alias("listed_high")))

    roster = _member_tokens(members, names.senate_surname, F.array("last_name"))
    by_surname = wanted.withColumn("surname", names.senate_surname(F.col("_last")))
    summary = _match_summary(by_surname.join(roster, ["surname", "token"]), key)

    joined = _attach(_attach(filers, listed, key), summary, key)
    one_listed = F.coalesce(F.col("listed_low.first_key") == F.col("listed_high.first_key"), F.lit(False))
    one_hit, one_ident = _one("hit_low", "hit_high"), _one("ident_low", "ident_high")
    former = (F.col("filing_date").isNotNull() & _none("hit_low")
              & is_former_senator(F.col("office")))
    status = (F.when(one_listed, "resolved_current").when(one_hit, "resolved")
              .when(~_none("hit_low"), "ambiguous")
              .when(former & one_ident & F.col("all_ended"), "resolved_post_service")
              .when(former & ~_none("ident_low") & ~one_ident, "ambiguous")
              .when(_none("listed_low"), "unresolved").otherwise("ambiguous"))
    state = (F.when(F.col("status") == "resolved_current", F.col("listed_low.listed_state"))
             .when(F.col("status") == "resolved", F.col("hit_low.state"))
             .when(F.col("status") == "resolved_post_service", F.col("ident_low.state")))
    out = joined.withColumn("status", status).withColumn("state_district", F.concat(state, F.lit("00")))
    return _finish(out, [c for c in filers.columns if c != "state_district"], ["status", "state_district"], strict)


def _finish(df: DataFrame, columns: list[str], added: list[str], strict: bool) -> DataFrame:
    out = df.select(*columns, *added)
    if not strict:
        return out
    message = F.concat_ws(" ", F.lit("filer"), F.col("first"), F.col("last"), F.col("status"))
    return fail_closed(out, F.col("status").isin(*RESOLVED), message)
