"""Senate listing pages (JSON) and the current-senators listing (XML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.checks import fail_closed
from ..functions.dates import lenient_us_date
from ..functions.documents import office_name, view_link
from ..functions.names import fold_name
from .house_index import check_xml_roots

SENATORS_ROOT = "contact_information"


def listing_rows(pages: DataFrame) -> DataFrame:
    """Filings of landed listing pages (``SENATE_LISTING`` schema).

    ``problem`` is NULL for usable rows. Every page and row is read; there is no page limit.
    """
    rows = pages.select(F.explode_outer("data").alias("cells"), F.col("data").isNull().alias("_no_data"))
    cell = lambda i: F.trim(F.try_element_at("cells", F.lit(i)))
    read = rows.select(
        "_no_data", F.coalesce(F.size("cells"), F.lit(-1)).alias("_n"), cell(1).alias("cell_first"),
        cell(2).alias("cell_last"), cell(3).alias("office"), cell(4).alias("link"),
        cell(5).alias("received")).filter("_no_data or _n >= 0")
    linked = read.withColumn("view", view_link(F.col("link"))).withColumn(
        "who", office_name(F.col("office"), F.col("cell_first"), F.col("cell_last")))
    problem = (F.when(F.col("_no_data"), "no data array").when(F.col("_n") < 5, "unexpected row shape")
               .when(F.col("view.view_id").isNull(), "unrecognised link"))
    return linked.select(
        F.col("who.first").alias("first"), F.col("who.last").alias("last"), "office",
        F.lit("P").alias("filing_type"), lenient_us_date(F.col("received")).alias("filing_date"),
        F.col("view.view_id").alias("doc_id"), F.col("view.view_kind").alias("view_kind"),
        problem.alias("problem"))


def read_listing(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of landed pages: one page per file, or one per line."""
    pages = spark.read.schema(schema.SENATE_LISTING).option("multiLine", multi_line).json(path)
    return listing_rows(pages)


def strict(rows: DataFrame) -> DataFrame:
    return fail_closed(rows, F.col("problem").isNull(),
                       F.concat(F.lit("listing: "), F.coalesce("problem", F.lit("")))).drop("problem")


def read_senators(spark: SparkSession, path: str) -> DataFrame:
    """``(last_key, first_key, state)``; a later entry of the same name wins.

    The listing is one file of about a hundred members, so reading order is file order, and looking at
    its root and its first member at once costs nothing. Another root or no member at all is an error.
    """
    wrong = check_xml_roots(spark, path, SENATORS_ROOT).first()
    if wrong is not None:
        raise ValueError(f"{wrong['file']}: unexpected root element {wrong['root']}")
    raw = spark.read.schema(schema.SENATOR_ROW).option("rowTag", "member").option("nullValue", "\u0000").xml(path)
    if raw.isEmpty():
        raise ValueError(f"{path}: no senators listed")
    return senators(raw.withColumn("position", F.monotonically_increasing_id()))


def senators(raw: DataFrame) -> DataFrame:
    """Fold and de-duplicate listing entries (needs ``position``)."""
    trimmed = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
                           for c in ("last_name", "first_name", "state")], "position")
    complete = (F.col("last_name") != "") & (F.col("first_name") != "") & (F.col("state") != "")
    checked = fail_closed(trimmed, complete, "senator entry lacks last_name, first_name or state")
    return (checked.select(fold_name(F.col("last_name")).alias("last_key"),
                           fold_name(F.col("first_name")).alias("first_key"), "state", "position")
            .groupBy("last_key", "first_key").agg(F.max_by("state", "position").alias("state")))
