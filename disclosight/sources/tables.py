"""The stored tables: append-only batches that become visible once committed.

A batch writes its filings and its lines into folders of its own and then one commit file.
Readers take the latest committed version of every batch only, so the tables change together and a
failed batch leaves nothing visible. A committed batch is never written again: repeating it does
nothing.

Stored rows change in two ways. A *patch* holds new values of some columns for some rows, by id, in a file of its own, so
what is written follows the number of changed rows; readers lay the committed patches over the batches, the latest
value of each column counting. A *rewrite* commits a new version of whole batches; versions and patches of a table are numbered together, so a version
takes in all patches with smaller numbers. ``compact`` rewrites just the batches that have open patches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MUTABLE

#: What the folder of a table's patches is called after its name.
PATCHES = "-patches"
COMMIT = T.StructType([T.StructField("table", T.StringType()), T.StructField("batch_no", T.LongType()),
                       T.StructField("version", T.LongType()), T.StructField("committed_at", T.TimestampType())])
PLACE = T.StructType([T.StructField("batch_no", T.LongType()), T.StructField("version", T.LongType())])


def read_or_none(spark: SparkSession, structure: T.StructType, path: str) -> DataFrame:
    """The rows below ``path``, none if nothing was written yet."""
    try:
        return spark.read.schema(structure).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], structure)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Latest version per table and batch."""
    rows = read_or_none(spark, COMMIT, f"{root}/commits/*")
    return rows.groupBy("table", "batch_no").agg(F.max("version").alias("version"))


def is_committed(spark: SparkSession, root: str, batch_no: int) -> bool:
    """Whether the batch is visible; a look at its commit file only."""
    return not read_or_none(spark, COMMIT, f"{root}/commits/batch-{batch_no}").isEmpty()


def latest_versions(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """``(batch_no, version)`` of the committed batches of a table, one row per ingestion run."""
    latest = commits(spark, root).filter(F.col("table") == name).select("batch_no", "version")
    return latest if before is None else latest.filter(F.col("batch_no") < before)


def read_batches(spark: SparkSession, root: str, name: str, schema: T.StructType,
                 before: int | None = None) -> DataFrame:
    """Committed rows of a stored table with their ``batch_no`` and ``version``, patches laid over them."""
    placed = T.StructType([*schema.fields, *PLACE.fields])
    latest = latest_versions(spark, root, name, before)
    rows = read_or_none(spark, placed, f"{root}/{name}").join(latest, ["batch_no", "version"], "left_semi").select(*placed.names)
    return overlaid(rows, root, name, schema)


def _patch_schema(schema: T.StructType, name: str) -> T.StructType:
    own = [T.StructField(f.name, f.dataType) for f in schema.fields if f.name in MUTABLE.get(name, ())]
    return T.StructType([T.StructField("id", T.LongType()), T.StructField("_set", T.ArrayType(T.StringType())), *own, *PLACE.fields])


def open_patches(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Committed patch rows that no version of their batch has taken in yet."""
    done = read_or_none(spark, COMMIT, f"{root}/commits/*").filter(F.col("table") == name + PATCHES).select("batch_no", "version").distinct()
    taken = latest_versions(spark, root, name).withColumnRenamed("version", "_taken")
    due = done.join(taken, "batch_no").filter(F.col("version") > F.col("_taken")).select("batch_no", "version")
    return read_or_none(spark, _patch_schema(schema, name), f"{root}/{name}{PATCHES}").join(due, ["batch_no", "version"], "left_semi")


def overlaid(rows: DataFrame, root: str, name: str, schema: T.StructType) -> DataFrame:
    """``rows`` of a table, with ``batch_no`` and id, as its open patches leave them. A table that never had a patch is not joined."""
    spark = rows.sparkSession
    try:
        spark.read.schema(_patch_schema(schema, name)).parquet(f"{root}/{name}{PATCHES}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    columns = [c for c in schema.names if c in MUTABLE.get(name, ())]
    number = lambda c: F.when(F.array_contains("_set", c), F.col("version"))
    last = open_patches(spark, root, name, schema).groupBy("batch_no", "id").agg(
        *[F.max_by(F.struct(F.col(c).alias("value")), number(c)).alias(f"_new_{c}") for c in columns])
    joined = rows.join(last, ["batch_no", "id"], "left")
    return joined.select(*[F.when(F.col(f"_new_{c}").isNull(), F.col(c)).otherwise(F.col(f"_new_{c}.value")).alias(c) if c in columns else F.col(c)
                           for c in rows.columns])


def write_patch(changes: DataFrame, root: str, name: str, columns: list[str]) -> int:
    """Commit new values of ``columns`` for the rows that ``batch_no`` and ``id`` name; the number of the patch."""
    beyond = set(columns) - set(MUTABLE.get(name, ()))
    if beyond:
        raise ValueError(f"columns of {name} that never change: {sorted(beyond)}")
    spark = changes.sparkSession
    number = next_version(spark, root, name)
    path = f"{root}/{name}{PATCHES}/version={number}"
    (changes.select("id", F.array(*[F.lit(c) for c in columns]).alias("_set"), *columns, "batch_no")
     .write.mode("overwrite").partitionBy("batch_no").parquet(path))
    touched = read_or_none(spark, T.StructType([PLACE["batch_no"]]), path).distinct()
    commit(touched.select(F.lit(name + PATCHES).alias("table"), "batch_no", F.lit(number).cast("long").alias("version")), f"{root}/commits/{name}-patch-{number}")
    return number


def compact(spark: SparkSession, root: str, name: str, schema: T.StructType) -> int:
    """Rewrite the batches with open patches; the number of these batches."""
    batches = open_patches(spark, root, name, schema).select("batch_no").distinct()
    count = batches.count()
    if count:
        whole = read_batches(spark, root, name, schema).join(batches, "batch_no", "left_semi")
        rewrite_batches(whole.select(*schema.names, "batch_no"), root, name, next_version(spark, root, name))
    return count


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType,
               before: int | None = None) -> DataFrame:
    """Committed rows, optionally only of batches numbered below ``before``."""
    return read_batches(spark, root, name, schema, before).drop("batch_no", "version")


def commit(rows: DataFrame, path: str) -> None:
    rows.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(path)


def write_batch(spark: SparkSession, root: str, batch_no: int, folders: dict[str, str] | None = None,
                written: Callable[[str], None] | None = None, **frames: DataFrame) -> None:
    """Write every named table of the batch, then commit them together; a committed batch stays as it is.

    ``folders`` names a column by which a table is cut into folders; ``written`` is called for each table before the commit.
    """
    if is_committed(spark, root, batch_no):
        return
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite")
        if folders and name in folders:
            writer = writer.partitionBy(folders[name])
        writer.parquet(f"{root}/{name}/batch_no={batch_no}/version=0")
        if written is not None:
            written(name)
    done = spark.createDataFrame([(name, batch_no, 0) for name in frames], "table string, batch_no long, version long")
    commit(done, f"{root}/commits/batch-{batch_no}")


def rewrite_batches(rows: DataFrame, root: str, name: str, version: int) -> None:
    """Commit ``version`` of the batches in ``rows``, which holds each of them completely."""
    spark = rows.sparkSession
    out = rows.withColumn("version", F.lit(version).cast("long"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_no", "version").parquet(f"{root}/{name}"))
    written = spark.read.schema(PLACE).parquet(f"{root}/{name}").filter(F.col("version") == version).distinct()
    commit(written.select(F.lit(name).alias("table"), "batch_no", "version"), f"{root}/commits/{name}-version-{version}")


def next_batch_no(spark: SparkSession, root: str) -> int:
    # generations of merged keys are no batches
    last = commits(spark, root).filter(~F.col("table").endswith("-merged")).agg(F.max("batch_no")).first()[0]
    return 0 if last is None else last + 1


def next_version(spark: SparkSession, root: str, name: str) -> int:
    last = commits(spark, root).filter(F.col("table").isin(name, name + PATCHES)).agg(F.max("version")).first()[0]
    return 0 if last is None else last + 1


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
