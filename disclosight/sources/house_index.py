"""House index listings: one row per filing, from XML or tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.checks import fail_closed
from ..functions.dates import lenient_us_date

ROOT_TAG, ROW_TAG = "FinancialDisclosure", "Member"
TAGS = schema.HOUSE_INDEX_ROW.names


def _problem(required: bool) -> Column:
    """Why a raw row is unusable, or NULL."""
    checks = []
    if required:
        checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"missing {c}"))
                  for c in ("Last", "FilingType", "DocID")]
    year = F.coalesce(F.trim("Year"), F.lit(""))
    return F.coalesce(*checks, F.when(~year.rlike(r"^[0-9]+\z"), F.lit("invalid Year")))


def to_filings(raw: DataFrame, required: bool = True) -> DataFrame:
    """Trimmed index rows plus ``problem``, NULL for usable rows."""
    text = {tag: F.trim(F.coalesce(F.col(tag), F.lit(""))) for tag in TAGS}
    return raw.select(
        text["Prefix"].alias("prefix"), text["Last"].alias("last"), text["First"].alias("first"),
        text["Suffix"].alias("suffix"), text["FilingType"].alias("filing_type"),
        text["StateDst"].alias("state_district"),
        F.when(text["Year"].rlike(r"^[0-9]+\z"), text["Year"].try_cast("int")).alias("year"),
        lenient_us_date(text["FilingDate"]).alias("filing_date"), text["DocID"].alias("doc_id"),
        _problem(required).alias("problem"))


def strict(rows: DataFrame) -> DataFrame:
    """Usable rows only; the job fails if there is any other."""
    message = F.concat(F.lit("index row "), F.coalesce("doc_id", F.lit("-")), F.lit(": "), F.coalesce("problem", F.lit("")))
    return fail_closed(rows, F.col("problem").isNull(), message).drop("problem")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the XML listing. Files without the expected root give an error row each."""
    raw = spark.read.schema(schema.HOUSE_INDEX_ROW).option("rowTag", ROW_TAG).option("nullValue", "\u0000").xml(path)
    rows = to_filings(raw)
    wrong = check_xml_roots(spark, path).select(F.concat(F.lit("unexpected root element "), "root").alias("problem"))
    return rows.unionByName(wrong, allowMissingColumns=True)


def check_xml_roots(spark: SparkSession, path: str, expected: str = ROOT_TAG) -> DataFrame:
    """Files whose root element is not the expected one (looked up in the opening lines).

    Lines up to and including the first element are enough; every file is read by its own task.
    """
    first_element = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w.-]*)"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    root = F.regexp_extract(F.ltrim("value"), first_element, 1)
    return files.select("file", root.alias("root")).filter(F.col("root") != expected)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the text listing; columns are found by header name, in any order.

    A leading byte-order mark is removed by the reader and undecodable bytes are replaced.
    """
    # header only: the reader takes the names from the first line
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    missing = [tag for tag in TAGS if tag not in names]
    if missing:
        raise ValueError(f"index header lacks {missing}")
    return to_filings(raw.select(*[F.col(f"`{names[tag]}`").alias(tag) for tag in TAGS]), required=False)


def prefer_xml(xml_rows: DataFrame, txt_rows: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """The text listing of a year counts only where that year has no XML listing.

    Wanted ``years(year)`` that neither listing covers give an error row each.
    """
    # calendar years only, so the broadcast side has 9999 rows at most
    have = xml_rows.select("year").filter(F.col("year").between(1, 9999)).distinct()
    rows = xml_rows.unionByName(txt_rows.join(F.broadcast(have), "year", "left_anti"))
    if years is None:
        return rows
    lost = missing_years(rows, years).select("year", F.concat(F.lit("no listing of "), "year").alias("problem"))
    return rows.unionByName(lost, allowMissingColumns=True)


def missing_years(rows: DataFrame, years: DataFrame) -> DataFrame:
    """Wanted years that neither listing covers."""
    have = rows.select("year").filter(F.col("year").between(1, 9999)).distinct()
    return years.join(F.broadcast(have), "year", "left_anti")
