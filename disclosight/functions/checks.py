"""Checks and filters that Catalyst can neither prune away nor copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fail_closed(df: DataFrame, holds: Column, message: str | Column) -> DataFrame:
    """``df`` unchanged, or a failed job at the first row where ``holds`` is not true.

    The check sits in a generator: it stays in the plan whichever columns a caller selects, and
    no later filter can drop an offending row before it is seen.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return settle(df, F.when(F.coalesce(holds, F.lit(False)), F.lit(True))
                  .otherwise(F.raise_error(text).cast("boolean")))


def settle(df: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep`` holds, with every column worked out exactly once.

    A plain filter over long derived columns would be pushed below them, and Catalyst would copy
    their whole definition into the pushed condition. A generator stops that.
    """
    row = F.array(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(F.inline(F.when(keep, row)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it.

    Catalyst copies the definition of a struct to wherever one of its fields is read; it does not copy out of a lambda.
    """
    return F.transform(F.array(value), use)[0]


def squeeze(col: Column) -> Column:
    """Trim and collapse every run of (Unicode) whitespace to one space."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))
