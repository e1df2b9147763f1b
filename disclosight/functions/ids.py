"""Surrogate ids that are unique by construction and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 27 + 12 + 24 bits of a positive long: a stream that fires every second takes four years to use up the batches, and
#: a batch holds up to 68 billion rows.
BATCH_BITS, BUCKET_BITS, ROW_BITS = 27, 12, 24


def with_batch_ids(df: DataFrame, key: list[str], batch_no: int | Column, name: str = "id") -> DataFrame:
    """Number the rows of one batch by ``key``, which must be unique in it.

    id = batch | bucket of the key hash | position in the bucket. The hash spreads every
    batch over 4096 independent windows, so no task numbers more than a small share, and
    the same batch always gets the same ids. A batch number or position that does not fit fails
    the job instead of wrapping around.
    """
    if isinstance(batch_no, int) and not 0 <= batch_no < 1 << BATCH_BITS:
        raise ValueError(f"batch number {batch_no} does not fit into an id")
    bucket = F.pmod(F.xxhash64(*key), F.lit(1 << BUCKET_BITS))
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key)).cast("long")
    batch = (batch_no if isinstance(batch_no, Column) else F.lit(batch_no)).cast("long")
    fits = batch.between(0, (1 << BATCH_BITS) - 1) & (F.col("_position") < 1 << ROW_BITS)
    value = (F.shiftleft(batch, BUCKET_BITS + ROW_BITS) + F.shiftleft(F.col("_bucket").cast("long"), ROW_BITS) + F.col("_position"))
    checked = F.when(fits, value).otherwise(F.raise_error(F.lit("batch number or row position does not fit into an id")).cast("long"))
    return (df.withColumn("_bucket", bucket).withColumn("_position", position)
            .withColumn(name, checked).drop("_bucket", "_position"))


def batch_of(number: Column) -> Column:
    """The batch that an id was given in."""
    return F.shiftright(number, BUCKET_BITS + ROW_BITS)
