"""Which documents are stored already, without reading the filings.

Every batch writes the ids it stores a second time, dealt to ``BUCKETS`` folders by a hash and committed together with
the batch. A later batch asks only in the folders that its own ids fall into, and a batch of few documents in few of them. Many small
batches leave many small files; ``merge`` writes the ids of all batches up to now as one generation that takes their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

#: The table of stored ids, and the folders of each batch in it.
NAME, BUCKETS = "filing_keys", 64
KEYS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("key_bucket", T.IntegerType())])
#: The table in which generations are committed: batch_no is the first batch that a generation leaves out.
MERGED = "filing_keys-merged"


def bucket(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def of(filings: DataFrame) -> DataFrame:
    """The ids of a batch with their buckets; a folder gets few files, and a large one is split at run time."""
    return filings.select("doc_id", bucket().alias("key_bucket")).hint("rebalance", "key_bucket")


def _generation(spark: SparkSession, root: str, before: int | None) -> int | None:
    """The latest committed generation that leaves out no batch it should hold."""
    done = tables.latest_versions(spark, root, MERGED)
    if before is not None:
        done = done.filter(F.col("batch_no") <= before)
    return done.agg(F.max("batch_no")).first()[0]


def keys(spark: SparkSession, root: str, before: int | None = None, touched: list[int] | None = None) -> DataFrame:
    """Committed ids, of the ``touched`` folders only if these are given."""
    schema = T.StructType([*KEYS.fields, *tables.PLACE.fields])
    from_batch = _generation(spark, root, before)
    latest = tables.latest_versions(spark, root, NAME, before)
    rows = tables.read_or_none(spark, schema, f"{root}/{NAME}")
    if touched is not None:
        rows = rows.where(F.col("key_bucket").isin(touched))
    if from_batch is not None:
        rows = rows.where(F.col("batch_no") >= from_batch)
    rows = rows.join(latest, ["batch_no", "version"], "left_semi").select("doc_id", "key_bucket")
    if from_batch is not None:
        merged = spark.read.schema(KEYS).parquet(f"{root}/{MERGED}/batch_no={from_batch}/version=0")
        rows = rows.unionByName(merged if touched is None else merged.where(F.col("key_bucket").isin(touched)))
    return rows


def stored_among(spark: SparkSession, root: str, documents: DataFrame, schema: T.StructType, before: int | None = None) -> DataFrame:
    """``doc_id`` of the given documents that a committed batch has stored.

    At most ``BUCKETS`` numbers come to the driver, to choose the folders. Filings of batches that wrote no keys are read themselves.
    """
    if tables.latest_versions(spark, root, "filings", before).isEmpty():
        return documents.select("doc_id").limit(0)
    asked = documents.select("doc_id").distinct().withColumn("key_bucket", bucket())
    touched = [r[0] for r in asked.select("key_bucket").distinct().collect()]
    known = keys(spark, root, before, touched)
    without = tables.latest_versions(spark, root, "filings", before).join(
        tables.latest_versions(spark, root, NAME).select("batch_no"), "batch_no", "left_anti").select("batch_no")
    if not without.isEmpty():
        old = tables.read_batches(spark, root, "filings", schema, before).join(without, "batch_no", "left_semi")
        known = known.unionByName(old.select("doc_id", bucket().alias("key_bucket")))
    return asked.join(known, ["key_bucket", "doc_id"], "left_semi").select("doc_id")


def merge(spark: SparkSession, root: str) -> None:
    """Write the ids of all committed batches as one generation."""
    upto = tables.next_batch_no(spark, root)
    path = f"{root}/{MERGED}/batch_no={upto}/version=0"
    keys(spark, root, upto).hint("rebalance", "key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(path)
    done = spark.createDataFrame([(MERGED, upto, 0)], "table string, batch_no long, version long")
    tables.commit(done, f"{root}/commits/{MERGED}-{upto}")
