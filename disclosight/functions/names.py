"""Name folding and the bounded given-name correspondence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv

_TRIM_EDGES = rf"^[{fv.TOKEN_TRIM}]+|[{fv.TOKEN_TRIM}]+\z"


def _without_marks(value: str | None) -> str | None:
    if value is None or value.isascii():
        return value
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_marks(values: pd.Series) -> pd.Series:
    """Compatibility-decompose and drop combining marks; Spark has no such built-in."""
    return values.map(_without_marks, na_action="ignore")


def fold_name(col: Column) -> Column:
    """Comparison form of a name: no accents, one apostrophe, single spaces, lower case."""
    plain = F.translate(strip_marks(col), fv.APOSTROPHES, "'" * len(fv.APOSTROPHES))
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " "))


def trim_token(token: Column) -> Column:
    return F.regexp_replace(token, _TRIM_EDGES, "")


def norm_token(token: Column) -> Column:
    return F.lower(trim_token(token))


def is_suffix(token: Column) -> Column:
    return norm_token(token).isin(*fv.NAME_SUFFIXES)


def given_tokens(folded: Column) -> Column:
    """Distinct given-name tokens of an already folded name, without suffixes."""
    tokens = F.transform(F.split(folded, " "), trim_token)
    return F.array_distinct(F.filter(tokens, lambda t: (t != "") & ~t.isin(*fv.NAME_SUFFIXES)))


def primary_token(folded: Column) -> Column:
    return trim_token(F.try_element_at(F.split(folded, " "), F.lit(1)))


def _related() -> dict[str, list[str]]:
    """Every token with the tokens it may stand for, in both directions."""
    out: dict[str, set[str]] = {}
    for formal, shorts in fv.NICKNAMES.items():
        for short in shorts:
            out.setdefault(formal, set()).add(short)
            out.setdefault(short, set()).add(formal)
    return {k: sorted(v) for k, v in out.items()}


def expand_tokens(tokens: Column) -> Column:
    """The tokens and everything directly related to them as a nickname."""
    related = F.create_map(*[x for k, v in _related().items()
                             for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(
        tokens, lambda t: F.concat(F.array(t), F.coalesce(related[t], nothing)))))


def official_tokens(folded_first: Column, folded_given: Column) -> Column:
    """Union of both official fields; lone initials only count when nothing else exists."""
    both = F.array_union(given_tokens(F.coalesce(folded_given, F.lit(""))), given_tokens(folded_first))
    full = F.filter(both, lambda t: F.length(t) > 1)
    return F.when(F.size(full) > 0, full).otherwise(both)


def given_names_agree(filer_folded: Column, folded_first: Column, folded_given: Column) -> Column:
    return F.arrays_overlap(given_tokens(filer_folded),
                            expand_tokens(official_tokens(folded_first, folded_given)))


def house_surname(folded: Column) -> Column:
    """Surname key of a folded name without trailing credentials or punctuation."""
    credentials = "|".join(fv.POSTNOMINAL_CREDENTIALS)
    bare = F.regexp_replace(folded, rf"(?<=\S)(?: [.,;]*(?:{credentials})[.,;]*)+\z", "")
    return F.regexp_replace(bare, r"[.,;]+\z", "")


def senate_surname(folded: Column) -> Column:
    """Surname key of a folded name without one terminal generational suffix."""
    suffixes = "|".join(fv.NAME_SUFFIXES)
    edge = f"[{fv.TOKEN_TRIM}]*"
    return F.regexp_replace(folded, rf"(?<=\S) {edge}(?:{suffixes}){edge}\z", "")


# --- official names of raw roster records -----------------------------------

def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def official_surname(last: Column, official_full: Column) -> Column:
    """``last`` when the full name ends with it (suffixes aside), else the last real token."""
    last = F.trim(F.coalesce(last, F.lit("")))
    tokens, phrase = words(official_full), F.transform(words(last), norm_token)
    normed = F.transform(tokens, norm_token)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))),
                      lambda i: F.slice(normed, i, F.size(phrase)) == phrase)
    first = F.try_element_at(starts, F.lit(1))
    trailing = F.slice(tokens, first + F.size(phrase), F.size(tokens) + 1)
    real = F.filter(tokens, lambda t: ~is_suffix(t))
    return (F.when((last == "") | (F.size(tokens) == 0), last)
            .when(first.isNotNull() & F.forall(trailing, is_suffix), last)
            .otherwise(F.coalesce(F.try_element_at(real, F.lit(-1)), last)))


def official_given(first: Column, middle: Column, last: Column, official_full: Column) -> Column:
    """Given-name tokens in source order: the full name minus surname and suffixes."""
    surname = F.transform(words(last), norm_token)
    kept = F.filter(words(official_full), lambda t: (norm_token(t) != "") & ~is_suffix(t)
                    & ~F.array_contains(surname, norm_token(t)))
    first, middle = (F.trim(F.coalesce(c, F.lit(""))) for c in (first, middle))
    fallback = F.when(first == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array(first, middle), lambda t: t != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(fallback)


def is_initial(token: Column) -> Column:
    """Only single letters, e.g. ``B.``, ``J``, ``J. J.``."""
    return token.rlike(r"\p{L}") & ~token.rlike(r"\p{L}{2}")


def alternate_surnames(given: Column, surname: Column, official_full: Column) -> Column:
    """Other surnames a filer may use, sorted; exact-match keys only."""
    real = F.filter(words(official_full), lambda t: ~is_suffix(t))
    tail = F.try_element_at(real, F.lit(-1))
    compound = F.when((surname != "") & tail.isNotNull() & (norm_token(tail) != F.lower(surname)),
                      F.array(tail)).otherwise(F.array().cast("array<string>"))
    moved = F.transform(F.sequence(F.lit(2), F.greatest(F.size(given), F.lit(2))),
                        lambda i: F.slice(given, i, F.size(given)))
    usable = F.filter(moved, lambda m: (F.size(m) > 0) & ~F.exists(m, is_initial))
    tails = F.transform(usable, lambda m: F.concat_ws(" ", m, surname))
    tails = F.when((surname != "") & (F.size(given) >= 2), tails).otherwise(
        F.array().cast("array<string>"))
    return F.array_sort(F.array_union(compound, tails))
