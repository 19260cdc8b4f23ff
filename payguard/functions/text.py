"""Text normalisers as SQL expressions, and the one vectorised function the engine needs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings that say how a company is incorporated.
SUFFIXES = "|".join(("ltd", "limited", "pvt", "private", "inc", "incorporated", "llc", "llp", "plc", "corp", "corporation", "co", "company", "gmbh", "bv", "sa", "sarl", "ag", "pty"))
#: Countries that write the day first, and those that write the month first.
DAY_FIRST = ("IN", "GB", "AU", "NZ", "IE", "ZA", "EU", "FR", "DE", "ES", "IT", "NL", "BE", "PT", "SE", "DK", "FI", "NO", "PL", "AT", "CH", "GR", "CZ", "RO", "HU")
MONTH_FIRST = ["US"]
#: Currencies that are priced.
CURRENCIES = ("USD", "EUR", "GBP", "INR", "CAD", "AUD", "CHF", "JPY", "SEK", "SGD", "MXN")


def norm(x: str) -> str:
    """SQL for a vendor name or description: lower case, no punctuation, no legal endings."""
    words = rf"trim(@sub[@sub[lower({x}); '[^\w\s]'; ' ']; '\s+'; ' '])"
    return rf"trim(@sub[{words}; '(^|\s)({SUFFIXES})(\s({SUFFIXES}))*$'; ''])"


def normalised(x: Column) -> Column:
    """The same as a Column, for any script."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(words, rf"(^|\s)({SUFFIXES})(\s({SUFFIXES}))*$", ""))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of pairs that a cheap bound has already let through."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio is at most, from the lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
