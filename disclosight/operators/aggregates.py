"""Aggregations whose details matter: open-ended sums, modes and person roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


def open_ended_sum(amount: Column) -> Column:
    """Sum, or NULL as soon as one input is NULL (no upper bound was disclosed)."""
    return F.when(F.count_if(amount.isNull()) == 0, F.sum(amount))


def most_common(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent non-NULL value per group, the smallest one on ties.

    Values are counted first, so a huge group only ever moves its distinct values, and the
    winner is a plain minimum that combines on the map side.
    """
    counted = (df.filter(F.col(column).isNotNull()).groupBy(*keys, column)
               .agg(F.count(F.lit(1)).alias("_n")))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(column))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


PERSON = ["first_name", "last_name", "state_district"]


def politician_rollup(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Filings and lines per person spelling.

    Lines are counted per filing first; a filing then contributes one row, so the distinct
    filing count is a plain count.
    """
    counted = joins.with_line_counts(filings.select("id", *PERSON), transactions)
    return counted.groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("filing_count"), F.sum("transaction_count").alias("transaction_count"))


def politician_total(filings: DataFrame) -> DataFrame:
    """Persons counted with names folded to lower case but districts as written."""
    return total(filings.select("state_district", F.lower("first_name"), F.lower("last_name")).distinct())


def persons_of_district(filings: DataFrame, districts: DataFrame) -> DataFrame:
    wanted = districts.select("state_district").distinct()
    return filings.join(wanted, "state_district", "left_semi").select(
        "state_district", "first_name", "last_name").distinct()
