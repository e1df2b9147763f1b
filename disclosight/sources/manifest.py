"""What the files of the stored tables hold, so that a scan reads only files that can have wanted rows.

When a batch is laid out, a manifest of its files is written beside it: row counts, the least and largest value of
every range column and, for key columns, a bitmap of hashed keys (a Bloom filter with one hash). A batch is laid out
in ranges, so a ticker or a stretch of days lies in few files; a ticker with a third of all lines is cut by day.

``pruned`` turns conditions into a list of files and reads these only. Files without a manifest, of batches that were written
without one, are always read, so a scan may read too much but never too little; the conditions themselves
are still to be applied to the rows. Only columns that never change can be used, as patches are not in the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MUTABLE
from . import tables

#: How rows are ordered over the files of a batch, and what the manifest knows about them.
LAYOUT = {"transactions": ("ticker", "txn_date", "id"), "filings": ("filing_date", "doc_id")}
RANGES = {"transactions": ("ticker", "txn_date", "id"), "filings": ("filing_date", "doc_id", "id")}
KEYS = {"transactions": ("ticker", "filing_id"), "filings": ("doc_id", "id")}
#: Bits of one bitmap, and the most bitmaps for one column of one file (2^23 bits, eight for each of a million rows).
BITS, MOST_BUCKETS = 1 << 15, 256

_PLACE = [T.StructField("batch_no", T.LongType()), T.StructField("version", T.LongType()), T.StructField("file", T.StringType())]
FILES = T.StructType([*_PLACE, T.StructField("rows", T.LongType()), T.StructField("column", T.StringType()),
                      T.StructField("low", T.StringType()), T.StructField("high", T.StringType()), T.StructField("has_null", T.BooleanType())])
BITMAPS = T.StructType([*_PLACE, T.StructField("column", T.StringType()), T.StructField("buckets", T.IntegerType()),
                        T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def laid_out(rows: DataFrame, name: str, view: dict[str, str] | None = None) -> DataFrame:
    """The rows of a batch in ranges, so that its files hold different stretches of them.

    ``view`` gives the columns of the table as expressions over ``rows``: they are worked out behind the shuffle, which so moves no more
    than the columns of ``rows``.
    """
    order = [c for c in LAYOUT.get(name, ()) if c in (view or rows.columns)]
    shown = [F.expr(e).alias(c) for c, e in view.items()] if view else ["*"]
    if not order:
        return rows.select(*shown)
    if not view:
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = rows.repartitionByRange(*[F.expr(view[c]) for c in order]).select("*", *[F.expr(view[c]).alias(f"_by_{c}") for c in order])
    return placed.sortWithinPartitions(*[f"_by_{c}" for c in order]).select(*shown)


def _text(column: str, kind: T.DataType) -> Column:
    """A value as text that sorts like the value: whole numbers are padded, as ids are never negative."""
    return F.lpad(F.col(column).cast("string"), 20, "0") if isinstance(kind, T.IntegralType) else F.col(column).cast("string")


def _hash(value: Column) -> Column:
    return F.xxhash64(value.cast("string"))


def _bucket(hashed: Column, buckets: Column) -> Column:
    return F.pmod(F.shiftright(hashed, 15), buckets).cast("int")


def write(spark: SparkSession, root: str, name: str, batch_no: int, version: int = 0) -> None:
    """The manifest of a written batch, from one read of the columns it is about. Must come before the commit of the batch."""
    path = f"{root}/{name}/batch_no={batch_no}/version={version}"
    written = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    place = [F.lit(batch_no).cast("long").alias("batch_no"), F.lit(version).cast("long").alias("version"), "file"]
    kind = {f.name: f.dataType for f in written.schema.fields}
    ranges = [c for c in RANGES.get(name, ()) if c in kind]
    bounds = written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.min(_text(c, kind[c])).alias("low"), F.max(_text(c, kind[c])).alias("high"), (F.count(c) < F.count(F.lit(1))).alias("has_null")).alias(c) for c in ranges])
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high"), F.col(f"{c}.has_null").alias("has_null")) for c in ranges]))
    # one row per file and column
    bounds.select(*place, "rows", each).coalesce(1).write.mode("overwrite").parquet(_path(root, name, "files", batch_no, version))
    keys = [c for c in KEYS.get(name, ()) if c in kind]
    sizes = spark.read.schema(FILES).parquet(_path(root, name, "files", batch_no, version)).select("file", "rows").distinct()
    power = F.ceil(F.log2(F.greatest(F.col("rows") / (BITS / 8), F.lit(1.0))))
    buckets = F.least(F.pow(F.lit(2.0), power), F.lit(float(MOST_BUCKETS))).cast("int")
    hashed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("there"), _hash(F.col(c)).alias("h")) for c in keys]))
    # one row per file
    placed = written.select("file", hashed.alias("k")).where("k.there").join(F.broadcast(sizes.withColumn("buckets", buckets).drop("rows")), "file")
    bitmaps = placed.groupBy("file", F.col("k.column").alias("column"), "buckets", _bucket(F.col("k.h"), F.col("buckets")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("k.h"), F.lit(BITS))).alias("bits"))
    bitmaps.select(*place, "column", "buckets", "bucket", "bits").write.mode("overwrite").parquet(_path(root, name, "keys", batch_no, version))


def _path(root: str, name: str, part: str, batch_no: int, version: int) -> str:
    return f"{root}/manifests/{name}-{part}/batch_no={batch_no}/version={version}"


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position.bitwiseAND(F.lit(7))) == 1


def _has_key(spark: SparkSession, root: str, name: str, column: str, keys: list) -> DataFrame:
    """Files whose bitmap has one of the keys."""
    sizes = [1 << n for n in range(MOST_BUCKETS.bit_length())]
    asked = spark.createDataFrame([(str(k),) for k in keys], "k string").select(_hash(F.col("k")).alias("h"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("buckets"))
    asked = asked.select("buckets", _bucket(F.col("h"), F.col("buckets")).alias("bucket"), F.pmod("h", F.lit(BITS)).cast("int").alias("position"))
    known = tables.read_or_none(spark, BITMAPS, f"{root}/manifests/{name}-keys").where(F.col("column") == column)
    return known.join(asked, ["buckets", "bucket"]).where(_bit(F.col("bits"), F.col("position"))).select("batch_no", "version", "file").distinct()


def files(spark: SparkSession, root: str, name: str, schema: T.StructType, ranges: dict | None = None, keys: dict | None = None) -> list[str] | None:
    """Paths of the committed files that can hold rows with every range column between its (low, high), None being open, and every
    key column one of its keys; None if there is nothing to prune by. A list of files is what any scan plans with."""
    ranges, keys = ranges or {}, keys or {}
    beyond = (set(ranges) | set(keys)) & set(MUTABLE.get(name, ()))
    if beyond or not set(ranges) <= set(RANGES.get(name, ())) or not set(keys) <= set(KEYS.get(name, ())):
        raise ValueError(f"no manifest of {name} for {sorted(beyond or set(ranges) | set(keys))}")
    kind = {f.name: f.dataType for f in schema.fields}
    latest = tables.latest_versions(spark, root, name)
    known = tables.read_or_none(spark, FILES, f"{root}/manifests/{name}-files").join(latest, ["batch_no", "version"], "left_semi")
    left = known.select("batch_no", "version", "file").distinct()
    for column, (low, high) in ranges.items():
        fits = F.col("column") == column
        for bound, keep in ((low, lambda v: F.col("high") >= v), (high, lambda v: F.col("low") <= v)):
            if bound is not None:
                fits = fits & keep(F.lit(_as_text(bound, kind[column])))
        left = left.join(known.where(fits), ["batch_no", "version", "file"], "left_semi")
    for column, wanted in keys.items():
        left = left.join(_has_key(spark, root, name, column, wanted), ["batch_no", "version", "file"], "left_semi")
    found = [f"{root}/{name}/batch_no={r['batch_no']}/version={r['version']}/{r['file']}" for r in left.collect()]
    bare = latest.join(known.select("batch_no").distinct(), "batch_no", "left_anti").collect()
    return sorted(found + [f"{root}/{name}/batch_no={r['batch_no']}/version={r['version']}" for r in bare])


def _as_text(value, kind: T.DataType) -> str:
    return str(value).rjust(20, "0") if isinstance(kind, T.IntegralType) else str(value)


def pruned(spark: SparkSession, root: str, name: str, schema: T.StructType, ranges: dict | None = None, keys: dict | None = None) -> DataFrame:
    """Committed rows of the files that can hold wanted rows, with patches; apply the conditions to them."""
    placed = T.StructType([*schema.fields, *tables.PLACE.fields])
    paths = files(spark, root, name, schema, ranges, keys)
    rows = spark.read.schema(placed).option("basePath", f"{root}/{name}").parquet(*paths) if paths else spark.createDataFrame([], placed)
    return tables.overlaid(rows.select(*placed.names), root, name, schema).drop("batch_no", "version")
