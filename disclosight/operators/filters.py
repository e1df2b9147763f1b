"""Predicates over filings, trade lines and computed clusters.

Each function takes a DataFrame and returns it filtered; a ``None`` argument keeps all rows.
"Lines" are transactions joined with their filing (see ``joins.lines``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import as_date, year_bounds

# Java's \z is the true end of input; $ would also accept a trailing line break.
TICKER_SHAPE = fv.TICKER_PATTERN.removesuffix("$") + r"\z"


def is_politician(district: str, first: str, last: str) -> Column:
    """District is matched exactly, names ignore case."""
    return ((F.col("state_district") == district)
            & (F.lower("first_name") == first.lower()) & (F.lower("last_name") == last.lower()))


def of_politician(df: DataFrame, who: tuple[str, str, str] | None) -> DataFrame:
    return df if who is None else df.filter(is_politician(*who))


def of_politicians(df: DataFrame, who: DataFrame) -> DataFrame:
    """Rows of any person in ``who(state_district, first_name, last_name)``, names ignoring case."""
    keys = who.select("state_district", F.lower("first_name").alias("_first"),
                      F.lower("last_name").alias("_last")).distinct()
    named = df.withColumn("_first", F.lower("first_name")).withColumn("_last", F.lower("last_name"))
    return named.join(keys, ["state_district", "_first", "_last"], "left_semi").drop("_first", "_last").select(*df.columns)


def filings_of_state(filings: DataFrame, state: str | None) -> DataFrame:
    """Prefix match on the upper-cased input; ``%`` and ``_`` in it stay wildcards."""
    return filings if state is None else filings.filter(
        F.col("state_district").like(state.upper() + "%"))


def politicians_of_state(filings: DataFrame, state: str | None) -> DataFrame:
    return filings if state is None else filings.filter(
        F.lower("state_district").like(state.lower() + "%"))


def in_index_year(filings: DataFrame, year: int | None) -> DataFrame:
    return filings if year is None else filings.filter(F.col("year") == year)


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range, each side optional; reversed bounds are an error."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{column}: min cannot exceed max")
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high))
    return df


def between_dates(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    as_day = lambda v: dt.date.fromisoformat(v) if isinstance(v, str) else v
    return between(df, column, as_day(low), as_day(high))


def amount_between(lines: DataFrame, low=None, high=None) -> DataFrame:
    """Both bounds apply to the disclosed minimum."""
    return between(lines, "amount_min", low, high)


def traded_in_year(lines: DataFrame, year: int | None) -> DataFrame:
    return lines if year is None else between_dates(lines, "txn_date", *year_bounds(year))


def name_contains(df: DataFrame, text: str | None) -> DataFrame:
    if text is None or not text.strip():
        return df
    whole = F.concat("first_name", F.lit(" "), "last_name")
    return df.filter(whole.ilike(f"%{text.strip()}%"))


def ticker_is(df: DataFrame, ticker: str | None) -> DataFrame:
    return df if ticker is None else df.filter(F.lower("ticker") == ticker.lower())


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Exact equality per named column, skipping ``None``."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def lines_of_document(transactions: DataFrame, filings: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Lines of the filings named in ``doc_ids(doc_id)``."""
    wanted = filings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return transactions.join(wanted.select(F.col("id").alias("filing_id")), "filing_id", "left_semi")


def has_ticker_shape(column: str | Column = "ticker") -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.rlike(TICKER_SHAPE)


def traded_by(df: DataFrame, as_of) -> DataFrame:
    """Leave out trades dated after ``as_of``."""
    return df.filter(F.col("txn_date") <= as_date(as_of))


def periodic_reports(index: DataFrame) -> DataFrame:
    return index.filter(F.col("filing_type") == fv.PTR_FILING_TYPE)


def filed_since(index: DataFrame, since) -> DataFrame:
    """Rows filed on or after ``since``; an unknown filing date is left out."""
    return index if since is None else index.filter(F.col("filing_date") >= as_date(since))


def profile_lines(lines: DataFrame, ticker: str | None = None, txn_type: str | None = None,
                  owner: str | None = None) -> DataFrame:
    """Profile page filter: ticker substring ignoring case, exact type and owner."""
    if ticker:
        lines = lines.filter(F.lower("ticker").contains(ticker.lower()))
    return equals(lines, txn_type=txn_type or None, owner_token=owner or None)


def verified_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("verified_transaction_date").isNotNull())


# --- computed clusters -------------------------------------------------------

def clusters_touching(clusters: DataFrame, start=None, end=None) -> DataFrame:
    """Clusters whose date span overlaps the range."""
    if start is not None and end is not None and as_iso(start) > as_iso(end):
        raise ValueError("date range: start cannot be after end")
    if start is not None:
        clusters = clusters.filter(F.col("end_date") >= as_date(start))
    if end is not None:
        clusters = clusters.filter(F.col("start_date") <= as_date(end))
    return clusters


def clusters_within(clusters: DataFrame, start, end) -> DataFrame:
    """Clusters lying wholly inside the range."""
    return clusters.filter((F.col("start_date") >= as_date(start)) & (F.col("end_date") <= as_date(end)))


def span_at_most(clusters: DataFrame, days: int | None) -> DataFrame:
    return clusters if days is None else clusters.filter(F.col("span_days") <= days)


def as_iso(value) -> str:
    return value if isinstance(value, str) else value.isoformat()
