"""Reviewed corrections of the stored tables, written as patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..functions.ids import batch_of
from ..operators import curation
from ..sources import tables


def store_verifications(spark: SparkSession, root: str, decisions: DataFrame) -> DataFrame:
    """Attach or clear verified dates of stored lines; the rejected decisions.

    Only the lines that a valid decision names are written.
    """
    lines = tables.read_table(spark, root, "transactions", schema.TRANSACTIONS)
    filings = tables.read_table(spark, root, "filings", schema.FILINGS)
    return _store(curation.apply_verifications(lines, filings, decisions), root, "transactions", curation.VERIFICATION)


def store_amendment_links(spark: SparkSession, root: str, decisions: DataFrame) -> DataFrame:
    """Link stored filings to what they amend, or clear the links; the rejected decisions."""
    filings = tables.read_table(spark, root, "filings", schema.FILINGS)
    return _store(curation.apply_amendment_links(filings, decisions), root, "filings", curation.AMENDMENT)


def _store(applied: curation.Applied, root: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    changes = applied.changes.withColumn("batch_no", batch_of(applied.changes["id"]))
    if not changes.isEmpty():
        tables.write_patch(changes, root, name, list(columns))
    return applied.rejected
