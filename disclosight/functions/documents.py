"""Document ids, links, office cells and amount cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .checks import once
from .labels import lookup

# --- fixed values: patterns of links and amounts ---
ELECTRONIC_LINK = r'href="/search/view/ptr/([^"]+)/"'
PAPER_LINK = r'href="/search/view/paper/([^"]+)/"'
HOUSE_AMOUNT = r"\$([\d,]+(?:\.\d{1,2})?)"


def house_doc_kind(doc_id: Column) -> Column:
    return F.when(doc_id.rlike(r"^[0-9]{7}\z"), "scanned").otherwise("efiled")


def senate_doc_kind(doc_id: Column) -> Column:
    return F.when(doc_id.rlike(r"^[0-9]+\z"), "scanned").otherwise("efiled")


def doc_kind(source: Column, doc_id: Column) -> Column:
    return F.when(source == "senate_efd", senate_doc_kind(doc_id)).otherwise(house_doc_kind(doc_id))


def view_link(link_html: Column) -> Column:
    """``struct(view_kind, view_id)`` of a listing link; both NULL when unrecognised."""
    html = F.coalesce(link_html, F.lit(""))
    electronic = F.nullif(F.regexp_extract(html, ELECTRONIC_LINK, 1), F.lit(""))
    paper = F.nullif(F.regexp_extract(html, PAPER_LINK, 1), F.lit(""))
    return F.struct(
        F.when(electronic.isNotNull(), "electronic").when(paper.isNotNull(), "paper").alias("view_kind"),
        F.coalesce(electronic, paper).alias("view_id"))


def document_url(source: Column, year: Column, doc_id: Column) -> Column:
    senate = F.concat(F.lit(fv.SENATE_BASE_URL + "/search/view/"),
                      F.when(senate_doc_kind(doc_id) == "scanned", "paper").otherwise("ptr"),
                      F.lit("/"), doc_id, F.lit("/"))
    house = F.concat(F.lit(fv.HOUSE_BASE_URL + "/ptr-pdfs/"), year.cast("string"), F.lit("/"),
                     doc_id, F.lit(".pdf"))
    return F.when(source == "senate_efd", senate).otherwise(house)


OFFICE_PATTERN = r"^\s*([^,]+)\s*,\s*([^(]+)\s*\("


def office_name(office: Column, first: Column, last: Column) -> Column:
    """``struct(first, last)`` from ``Last, First (…)``; otherwise the separate cells."""
    shaped = office.rlike(OFFICE_PATTERN)
    return F.struct(
        F.when(shaped, F.trim(F.regexp_extract(office, OFFICE_PATTERN, 2))).otherwise(first).alias("first"),
        F.when(shaped, F.trim(F.regexp_extract(office, OFFICE_PATTERN, 1))).otherwise(last).alias("last"))


def is_former_senator(office: Column) -> Column:
    folded = F.lower(F.trim(F.regexp_replace(office, r"\s+", " ")))
    return (folded == "former senator") | office.rlike(r"(?i)\(\s*former\s+senator\s*\)\s*\z")


def senate_txn_code(label: Column) -> Column:
    """The shared code of a Senate label; NULL when unknown."""
    return lookup(fv.SENATE_TXN_TYPES, F.lower(F.trim(label)))


def _numbers(cell: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(cell, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda v: F.floor(F.regexp_replace(v, ",", "").try_cast("decimal(30,2)"))
                       .cast("long"))


def _usable(values: Column) -> Column:
    return (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull())


def senate_amount(cell: Column) -> Column:
    """``struct(amount_min, amount_max)``: open-ended cells keep a NULL upper bound.

    ``amount_min`` is NULL when the cell holds no usable dollar number.
    """
    found = F.struct(_numbers(cell, r"\$([\d,]+)").alias("values"), cell.rlike(r"(?i)\bover\s+\$").alias("over"))
    return once(found, lambda f: F.struct(
        F.when(_usable(f["values"]) & f["over"], F.try_element_at(f["values"], F.lit(1)))
        .when(_usable(f["values"]), F.array_min(f["values"])).alias("amount_min"),
        F.when(_usable(f["values"]) & ~f["over"], F.array_max(f["values"])).alias("amount_max")))


def house_amount(cell: Column) -> Column:
    """``struct(amount_min, amount_max)`` in whole dollars, cents cut off."""
    return once(_numbers(cell, HOUSE_AMOUNT), lambda values: F.struct(
        F.when(_usable(values), F.array_min(values)).alias("amount_min"),
        F.when(_usable(values), F.array_max(values)).alias("amount_max")))
