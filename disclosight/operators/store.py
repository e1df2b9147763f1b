"""Idempotent store of finished filings: the first record of a document id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.ids import with_batch_ids
from ..sources import stored_keys, tables


def survivors(new_filings: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """New filings not stored yet, one row per document id: the first by ``order``.

    Copies combine on the map side, so a document repeated in a third of all rows is reduced
    before it is shuffled.
    """
    rest = [c for c in new_filings.columns if c != "doc_id"]
    first = new_filings.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    kept = first.select("doc_id", "_f.*").select(*new_filings.columns)
    return kept.join(stored.select("doc_id"), "doc_id", "left_anti")


def store(spark: SparkSession, root: str, new_filings: DataFrame, new_lines: DataFrame, batch_no: int,
          order: list[str]) -> None:
    """Append filings and lines of one batch; ``new_lines`` refers to filings by ``doc_id``.

    Lines must carry the ``order`` columns of the filing version they belong to. A committed batch
    is not stored again; one that failed before its commit is. Of the documents stored before, only the key folders
    that the new ones fall into are read.
    """
    if tables.is_committed(spark, root, batch_no):
        return
    stored = stored_keys.stored_among(spark, root, new_filings, schema.FILINGS, before=batch_no)
    kept = survivors(new_filings, stored, order)
    numbered = with_batch_ids(kept, ["doc_id"], batch_no)
    for name in ("prefix", "suffix"):
        numbered = numbered.withColumn(name, F.nullif(F.col(name), F.lit("")))
    # worked out once for filings, lines and keys
    work = f"{root}/work/store-{batch_no}"
    numbered.write.mode("overwrite").parquet(work)
    numbered = spark.read.schema(numbered.schema).parquet(work)
    parents = numbered.select("doc_id", *order, F.col("id").alias("filing_id"))
    lines = with_batch_ids(new_lines.join(parents, ["doc_id", *order]), ["filing_id", "sequence"], batch_no)
    tables.write_batch(spark, root, batch_no, {stored_keys.NAME: "key_bucket"}, filings=fit(numbered, schema.FILINGS),
                       transactions=fit(lines, schema.TRANSACTIONS), **{stored_keys.NAME: stored_keys.of(numbered)})


def fit(df: DataFrame, target) -> DataFrame:
    """The columns of ``target`` in order, NULL where ``df`` has none."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in target.fields])
