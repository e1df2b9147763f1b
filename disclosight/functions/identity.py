"""Derived person identity and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERSON_ID_PATTERN = r"^([A-Za-z]{2}[0-9]{1,2})_(.+)\z"


def key_part(col: Column) -> Column:
    stripped = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)^\s+|\s+\z", "")
    return F.regexp_replace(F.lower(stripped), r"(?U)[\s_]+", "_")


def name_key(first: Column, last: Column) -> Column:
    return F.concat_ws("_", key_part(first), key_part(last))


def person_key(state_district: Column, first: Column, last: Column) -> Column:
    """The public person id, e.g. ``zz09_ada_example``."""
    return F.concat_ws("_", key_part(state_district), name_key(first, last))


def split_person_id(person_id: Column) -> tuple[Column, Column]:
    """``(district, name key)`` of a person id; both NULL when it has no district prefix.

    The district is upper-cased; the rest keeps its case and loses trailing underscores.
    """
    prefix = F.regexp_extract(person_id, PERSON_ID_PATTERN, 1)
    rest = F.regexp_replace(F.regexp_extract(person_id, PERSON_ID_PATTERN, 2), r"_+\z", "")
    known = prefix != ""
    return F.when(known, F.upper(prefix)), F.when(known, rest)


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(first, F.lit(" "), last))


def filing_name(prefix: Column, first: Column, last: Column, suffix: Column) -> Column:
    """Non-empty parts joined by single spaces."""
    return F.trim(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (prefix, first, last, suffix)]))


def resolve_person_ids(person_ids: DataFrame, filings: DataFrame) -> DataFrame:
    """Match a table of ``person_id`` with the persons of ``filings``.

    Adds ``state_district, first_name, last_name`` (NULL when unknown). Spellings that share
    one key give one deterministic representative, the smallest.
    """
    persons = (
        filings.groupBy(F.col("state_district").alias("_sd"),
                        name_key(F.col("first_name"), F.col("last_name")).alias("_name_key"))
        .agg(F.min(F.struct("first_name", "last_name")).alias("_who"))
    )
    district, rest = split_person_id(F.col("person_id"))
    wanted = person_ids.withColumn("_district", district).withColumn("_rest", rest)
    same = (F.col("_district") == F.col("_sd")) & (F.col("_rest") == F.col("_name_key"))
    return wanted.join(persons, same, "left").select(
        *person_ids.columns, F.col("_sd").alias("state_district"),
        F.col("_who.first_name").alias("first_name"), F.col("_who.last_name").alias("last_name"))
