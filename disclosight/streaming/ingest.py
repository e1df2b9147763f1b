"""Incremental ingestion as a stream: first record of a document id wins, across replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store as st


def stream_reports(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Landed report rows (parquet files) as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def ingest_stream(reports: DataFrame, root: str, checkpoint: str, order: list[str],
                  trigger: dict | None = None, first_batch: int = 0) -> StreamingQuery:
    """Store a stream of reports, each a filing with its ``lines`` array.

    The batch number is ``first_batch`` plus the epoch: a repeated epoch replaces the same folders,
    and documents an earlier batch stored are left out, so a replay changes nothing. A stream that
    starts over with a new checkpoint needs a ``first_batch`` beyond the batches already stored.
    """
    def one_batch(batch: DataFrame, epoch: int) -> None:
        filings = batch.drop("lines")
        lines = batch.select("doc_id", *order, F.inline("lines"))
        st.store(batch.sparkSession, root, filings, lines, first_batch + epoch, order)

    writer = reports.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
