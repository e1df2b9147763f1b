"""Display labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column) -> Column:
    """The mapped value, or NULL when the key is unknown."""
    return literal_map(values)[key]


def asset_type_label(code: Column) -> Column:
    return F.coalesce(lookup(fv.ASSET_TYPE_LABELS, code), code)


def txn_type_label(txn_type: Column) -> Column:
    return F.coalesce(lookup(fv.TXN_TYPE_LABELS, txn_type), txn_type)


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def amount_label(low: Column, high: Column) -> Column:
    """``Over $x`` for an open-ended amount, otherwise the range."""
    return F.when(high.isNull(), F.concat(F.lit("Over "), dollars(low))).otherwise(
        F.concat(dollars(low), F.lit(" - "), dollars(high)))


def flag_messages(flags: Column, filing_date: Column) -> Column:
    """Plain-language warnings, one per known flag, joined by line breaks."""
    shown = F.date_format(filing_date, "yyyy-MM-dd")
    messages = literal_map(fv.FLAG_MESSAGES)
    dated = (fv.FLAG_AFTER_FILING, fv.FLAG_NOTIFICATION_AFTER_FILING)

    def message(flag: Column) -> Column:
        plain = messages[flag]
        with_date = F.concat(F.regexp_replace(plain, r"\.\z", " ("), shown, F.lit(")."))
        return F.when(flag.isin(*dated) & shown.isNotNull(), with_date).otherwise(plain)

    return F.array_join(F.array_compact(F.transform(flags, message)), "\n")


def display_date(txn_date: Column, verified: Column) -> Column:
    """The verified date when there is one, else the source date; a dash when neither exists."""
    return F.coalesce(F.date_format(F.coalesce(verified, txn_date), "MM/dd/yyyy"), F.lit("—"))


def txn_noun(signal_type: Column, many: bool = True) -> Column:
    ending = "s" if many else ""
    return (F.when(signal_type == "buy_cluster", F.lit("purchase" + ending))
            .when(signal_type == "sell_cluster", F.lit("sale" + ending)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
