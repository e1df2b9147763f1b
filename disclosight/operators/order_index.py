"""An order kept as ranges, for pages that lie far behind.

An offset makes Spark sort all rows before the page. An order index stores the sort keys once in ranges of the
whole key, the unique last one included, so that no value of a leading key, however common, has to fit into one
range. Pages then read only the ranges that they touch, and the number of all rows is known.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ordering import PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX, nulls_last


class OrderIndex(NamedTuple):
    """Keys ``k0, k1, …`` by ``range``, whether each descends, and the rows of every range in order."""

    table: DataFrame
    descending: tuple[bool, ...]
    counts: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.counts)

    @property
    def order(self) -> list[Column]:
        return [nulls_last(F.col(f"k{i}"), down) for i, down in enumerate(self.descending)]


def build(df: DataFrame, keys: list[tuple[Column, bool]], ranges: int = 256) -> OrderIndex:
    """The index of ``df`` under ``keys``, (expression, descending) pairs of which the last is unique; NULLs come last in each.

    The rows are read twice, for the cuts and for their keys; only keys are shuffled. One count per range reaches
    the driver. Choose ``ranges`` so that a range is about as large as a task's input.
    """
    plain = df.select(*(col.alias(f"k{i}") for i, (col, _) in enumerate(keys)))
    order = [nulls_last(F.col(f"k{i}"), down) for i, (_, down) in enumerate(keys)]
    path = scratch_path(df.sparkSession, "order-index")
    laid = plain.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    laid.write.partitionBy("range").parquet(path)
    table = df.sparkSession.read.schema(laid.schema).parquet(path)
    found = {r["range"]: r["count"] for r in table.groupBy("range").count().collect()}
    return OrderIndex(table, tuple(down for _, down in keys), tuple(found.get(i, 0) for i in range(ranges)))


def touched(index: OrderIndex, limit: int, offset: int) -> tuple[list[int], int]:
    """The ranges that hold rows of a page, and the number of rows before the first of them."""
    ends = list(accumulate(index.counts))
    wanted = [i for i, end in enumerate(ends) if index.counts[i] and end > offset and end - index.counts[i] < offset + limit]
    return wanted, ends[wanted[0]] - index.counts[wanted[0]] if wanted else 0


def page_keys(index: OrderIndex, limit: int = PAGE_LIMIT_DEFAULT, offset: int = 0) -> DataFrame:
    """The keys of one page, from the ranges that it touches; behind the last row it is empty."""
    if not 1 <= limit <= PAGE_LIMIT_MAX or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    wanted, before = touched(index, limit, offset)
    return (index.table.where(F.col("range").isin(wanted) if wanted else F.lit(False)).drop("range")
            .orderBy(*index.order).offset(offset - before if wanted else 0).limit(limit))


def page(df: DataFrame, unique: str, index: OrderIndex, limit: int = PAGE_LIMIT_DEFAULT, offset: int = 0) -> DataFrame:
    """The rows of ``df`` on one page, in no order: at most ``limit`` ids are sent to the scan."""
    last = f"k{len(index.descending) - 1}"
    ids = page_keys(index, limit, offset).select(F.col(last).alias(unique))
    return df.join(F.broadcast(ids), unique, "left_semi")
