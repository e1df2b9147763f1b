"""Bursts kept up to date while trades arrive, late ones too.

The log holds two tables. ``burst_days`` are the trades seen so far, reduced to one row per series (type, ticker), day
and person, dealt to ``BUCKETS`` folders by a hash of the series. ``bursts`` are revisions: every batch appends the bursts that
its trades touch, with the batch as revision, and retracts those that became part of another one. The latest revision of a
burst counts, so the log answers at any time what a job over all trades would. ``burst_clock`` has the newest day of every batch:
a burst whose gap lies further behind it than the lateness is closed, and a revision of a closed one is a correction.

A batch reads the folders of its own series only, and of these the series it touches. Both tables of a batch become visible
together, and a committed batch is never added again, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..operators import bursts
from ..operators.bursts import DAY, SERIES
from ..session import working_table
from ..sources import tables

BUCKETS = 64
DAYS, LOG, CLOCK = "burst_days", "bursts", "burst_clock"
_FOLDER = [T.StructField("bucket", T.IntegerType())]
_SERIES = [T.StructField(c, T.StringType()) for c in SERIES]
CLOCK_ROWS = T.StructType([T.StructField("newest", T.DateType())])
DAY_ROWS = T.StructType([*_SERIES, T.StructField("txn_date", T.DateType()), T.StructField("person_key", T.StringType()),
                         T.StructField("trades", T.LongType()), *_FOLDER])
BURST = [*SERIES, "start_date"]
BURST_ROWS = T.StructType([*_SERIES, T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType()), T.StructField("span_days", T.IntegerType()),
                           T.StructField("transaction_count", T.LongType()), T.StructField("politician_count", T.LongType()),
                           T.StructField("retracted", T.BooleanType()), T.StructField("corrects", T.BooleanType()), *_FOLDER])


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*SERIES), F.lit(BUCKETS)).cast("int")


def _rows(spark: SparkSession, root: str, name: str, schema: T.StructType, touched: list[int] | None, before: int | None) -> DataFrame:
    placed = T.StructType([*schema.fields, *tables.PLACE.fields])
    rows = tables.read_or_none(spark, placed, f"{root}/{name}")
    if touched is not None:
        rows = rows.where(F.col("bucket").isin(touched))
    return rows.join(tables.latest_versions(spark, root, name, before), ["batch_no", "version"], "left_semi")


def current(spark: SparkSession, root: str, touched: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The bursts as of the last batch, in the columns of ``streaming.bursts`` and with their ``revision``."""
    value = [c for c in BURST_ROWS.names if c not in (*BURST, "bucket")]
    last = _rows(spark, root, LOG, BURST_ROWS, touched, before).groupBy(*BURST).agg(
        F.max_by(F.struct(*value), F.col("batch_no")).alias("_b"), F.max("batch_no").alias("revision"))
    return last.where("not _b.retracted").select(*BURST, "_b.end_date", "_b.span_days", "_b.transaction_count", "_b.politician_count", "revision")


def corrections(spark: SparkSession, root: str) -> DataFrame:
    """Revisions that changed, or retracted, a burst that was closed when they came."""
    rows = _rows(spark, root, LOG, BURST_ROWS, None, None).where("corrects")
    return rows.select(*BURST, "end_date", "span_days", "transaction_count", "politician_count", "retracted", F.col("batch_no").alias("revision"))


def add_trades(spark: SparkSession, root: str, trades: DataFrame, batch_no: int, max_gap_days: int = fv.MAX_GAP_DAYS, lateness_days: int = 45) -> None:
    """Add a batch of ``trades(txn_type, ticker, txn_date, person_key)``.

    Bursts that the batch does not touch are neither read nor written. Counts per person and day combine before the
    shuffle, so a ticker with a third of all trades is reduced to its days and persons first.
    """
    if tables.is_committed(spark, root, batch_no):
        return
    work = f"{root}/work/bursts-{batch_no}"
    (trades.groupBy(*DAY, "person_key").agg(F.count(F.lit(1)).alias("trades")).withColumn("bucket", _bucket())
     .select(*DAY_ROWS.names).write.mode("overwrite").parquet(work))
    fresh = spark.read.schema(DAY_ROWS).parquet(work)
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
    series = fresh.select(*SERIES).distinct()
    earlier = _rows(spark, root, DAYS, DAY_ROWS, touched, batch_no).join(series, SERIES, "left_semi").select(*DAY_ROWS.names)
    # each of these tables is read several times, so it is worked out once
    days = working_table(earlier.unionByName(fresh).groupBy(*DAY, "person_key").agg(F.sum("trades").alias("trades")), "burst-days")
    numbered = working_table(bursts.number_bursts(days.groupBy(*DAY).agg(F.sum("trades").alias("day_trades")), max_gap_days), "burst-numbers")
    mine = [*SERIES, "burst_id"]
    hit = numbered.join(fresh.select(*DAY).distinct(), DAY, "left_semi").select(*mine).distinct()
    chosen = working_table(numbered.join(hit, mine, "left_semi"), "burst-chosen")
    spans = bursts.burst_spans(chosen)
    people = (days.join(chosen.select(*DAY, "burst_id"), DAY).select(*mine, "person_key").distinct()
              .groupBy(*mine).agg(F.count(F.lit(1)).alias("politician_count")))
    # one row per batch
    clock = tables.read_table(spark, root, CLOCK, CLOCK_ROWS, before=batch_no)
    newest = clock.agg(F.max("newest")).first()[0]
    closed = F.coalesce(F.date_add("end_date", max_gap_days) < F.date_sub(F.lit(newest).cast("date"), lateness_days), F.lit(False))
    changed = working_table(spans.join(people, mine).select(*BURST, "end_date", "span_days", "transaction_count", "politician_count"), "burst-changes")
    around = changed.select(*SERIES, F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    # what the log says so far about the stretches of the changed bursts
    before = (current(spark, root, touched, batch_no).withColumn("_closed", closed).join(around, SERIES)
              .where((F.col("start_date") >= F.col("_from")) & (F.col("start_date") <= F.col("_to"))))
    late = before.groupBy(*SERIES, F.col("_from").alias("start_date")).agg(F.bool_or("_closed").alias("corrects"))
    revised = changed.join(late, BURST, "left").withColumn("corrects", F.coalesce("corrects", F.lit(False))).withColumn("retracted", F.lit(False))
    absorbed = before.where(F.col("start_date") > F.col("_from")).withColumn("corrects", F.col("_closed")).withColumn("retracted", F.lit(True))
    log = [f.withColumn("bucket", _bucket()).select(*BURST_ROWS.names) for f in (revised, absorbed)]
    tables.write_batch(spark, root, batch_no, {DAYS: "bucket", LOG: "bucket"}, **{
        DAYS: fresh.hint("rebalance", "bucket"), LOG: log[0].unionByName(log[1]).hint("rebalance", "bucket"),
        CLOCK: fresh.agg(F.max("txn_date").alias("newest"))})
