"""Bursts of same-ticker trades: runs of trading days with no gap above a limit.

Burst borders depend on the distinct trading days of a ticker only. Windows therefore run over
one row per (type, ticker, day), which is bounded by the calendar however many trades a ticker
has, and trades are joined to their day afterwards. A ticker holding a third of all rows is
reduced on the map side before it reaches a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["txn_type", "ticker"]
DAY = [*SERIES, "txn_date"]


def trading_days(trades: DataFrame) -> DataFrame:
    """One row per series and day with its number of trades and lowest trade id."""
    return trades.groupBy(*DAY).agg(F.count(F.lit(1)).alias("day_trades"),
                                    F.min("id").alias("first_id"))


def number_bursts(days: DataFrame, max_gap_days: int | Column) -> DataFrame:
    """Adds ``prev_day`` and ``burst_id`` (1, 2, … per series); the largest gap may depend on the row's series."""
    by_day = Window.partitionBy(*SERIES).orderBy("txn_date")
    gap = F.datediff(F.col("txn_date"), F.col("prev_day"))
    opens = F.when(F.col("prev_day").isNull() | (gap > max_gap_days), 1).otherwise(0)
    running = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (days.withColumn("prev_day", F.lag("txn_date").over(by_day))
            .withColumn("burst_id", F.sum(opens).over(running)))


def burst_spans(numbered: DataFrame) -> DataFrame:
    """First day, last day, span and number of trades of every burst."""
    spans = numbered.groupBy(*SERIES, "burst_id").agg(
        F.min("txn_date").alias("start_date"), F.max("txn_date").alias("end_date"),
        F.sum("day_trades").alias("transaction_count"))
    return spans.withColumn("span_days", F.datediff("end_date", "start_date"))


def qualifying_days(numbered: DataFrame, max_span_days: int | Column, min_trades: int | Column) -> DataFrame:
    """Days of bursts that are short and busy enough to matter, with their burst's span."""
    whole = Window.partitionBy(*SERIES, "burst_id")
    spanned = (numbered.withColumn("start_date", F.min("txn_date").over(whole))
               .withColumn("end_date", F.max("txn_date").over(whole))
               .withColumn("_trades", F.sum("day_trades").over(whole)))
    return (spanned.filter((F.datediff("end_date", "start_date") <= max_span_days)
                           & (F.col("_trades") >= min_trades))
            .select(*DAY, "burst_id", "start_date", "end_date"))


def previous_trade(trades: DataFrame, max_gap_days: int) -> DataFrame:
    """Per trade: ``prev_date`` of the series in (date, id) order and its ``burst_id``.

    Only the first trade of a day looks back a day; all others follow a trade of the same day.
    """
    days = number_bursts(trading_days(trades), max_gap_days).select(
        *DAY, "first_id", "prev_day", "burst_id")
    joined = trades.join(days, DAY)
    return (joined.withColumn("prev_date", F.when(F.col("id") == F.col("first_id"), F.col("prev_day"))
                              .otherwise(F.col("txn_date")))
            .drop("first_id", "prev_day"))
