"""Recompute the quality flags of stored lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import quality
from ..sources import tables


class Report(NamedTuple):
    examined: int
    changed: int
    flag_counts: DataFrame
    affected_documents: DataFrame


def recompute(spark: SparkSession, root: str, as_of, dry_run: bool = False, rewrite: bool = True) -> Report:
    """Bring stored flags in line with the rules as of a day.

    With ``rewrite`` the batches with a changed line are written anew, as one new version; without, the changed lines alone
    are written, as a patch. Without a change, or in a dry run, nothing is written. The lists of the report are tables, in document order.
    """
    filings = tables.read_table(spark, root, "filings", schema.FILINGS)
    lines = tables.read_batches(spark, root, "transactions", schema.TRANSACTIONS)
    done = quality.recomputed_flags(lines, filings, as_of)
    version = tables.next_version(spark, root, "transactions")
    work = f"{root}/work/recompute-{version}"
    done.filter("changed").select("id", "doc_id", "sequence", "batch_no", "computed_flags", "changed").write.mode("overwrite").parquet(work)
    changed = spark.read.parquet(work)
    report = Report(lines.count(), changed.count(), quality.flag_histogram(changed),
                    quality.affected_documents(changed).orderBy("doc_id"))
    if report.changed and not dry_run and not rewrite:
        tables.write_patch(changed.withColumn("quality_flags", F.col("computed_flags")), root, "transactions", ["quality_flags"])
    elif report.changed and not dry_run:
        touched = changed.select("batch_no").distinct()
        fresh = done.withColumn("quality_flags", F.col("computed_flags")).join(touched, "batch_no", "left_semi")
        tables.rewrite_batches(fresh.select(*schema.TRANSACTIONS.names, "batch_no"), root, "transactions", version)
    return report
