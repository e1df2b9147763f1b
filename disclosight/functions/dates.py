"""Date arithmetic and lenient date parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def lag_days(filing_date: Column, txn_date: Column) -> Column:
    """Signed days from trade to disclosure; NULL when either date is missing."""
    return F.datediff(filing_date, txn_date)


def as_date(value) -> Column:
    """A literal date from a ``date`` or an ISO string; a bad string is an error."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def six_months_before(as_of: Column) -> Column:
    """Six calendar months earlier, clamped to the month's last day."""
    return F.add_months(as_of, -6)


def lenient_us_date(col: Column) -> Column:
    """``M/D/YYYY`` to a date; blank, malformed or impossible values become NULL."""
    text = F.trim(col)
    shaped = F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), text)
    return F.try_to_date(shaped, "M/d/yyyy")


def year_bounds(year: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, 1, 1), dt.date(year, 12, 31)
