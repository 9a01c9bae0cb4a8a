"""Numbers written as text: prices, percentages, abbreviated amounts, tickers and currencies as column expressions.

Every function returns null for null and for what it cannot read. Casts are guarded by a pattern, as ``cast('12d' as double)`` is 12.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs and their codes, in the order in which they are looked for.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₿": "BTC", "¢": "USD"}
SIGNS = "[$€£¥₹₿¢]"
# Suffixes of abbreviated amounts.
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def guarded_double(c: Column) -> Column:
    """The double a whole text spells, else null."""
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def _signed(c: Column) -> Column:
    """(x) is minus x."""
    return F.regexp_replace(c, r"^\((.*)\)$", "-$1")


def price(c: Column) -> Column:
    """A price without its currency sign and thousands separators; suffixes are not read."""
    return guarded_double(_signed(F.regexp_replace(F.trim(F.regexp_replace(c, SIGNS, "")), ",", "")))


def percentage(c: Column) -> Column:
    """A percentage on its scale of 0 to 100."""
    return guarded_double(_signed(F.trim(F.regexp_replace(c, "[%,]", ""))))


def number(c: Column) -> Column:
    """A number with an optional suffix K, M, B or T. A suffix inside brackets is not read."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, SIGNS, ""), ",", ""))
    last = F.upper(F.right(bare, F.lit(1)))
    factor = F.lit(None).cast("double")
    for k, v in SUFFIXES.items():
        factor = F.when(last == k, F.lit(v)).otherwise(factor)
    stem = F.trim(F.left(bare, F.length(bare) - 1))
    return F.when(factor.isNotNull(), guarded_double(stem) * factor).otherwise(guarded_double(_signed(bare)))


def ticker(c: Column) -> Column:
    """Upper case without exchange prefix and suffix; '' becomes null."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "^[A-Z]+:", ""), r"\.[A-Z]+$", "")
    return F.nullif(F.regexp_replace(t, "[^A-Z0-9]", ""), F.lit(""))


def currency(c: Column) -> Column:
    """Code of the first known sign that occurs."""
    out = F.lit(None).cast("string")
    for sign, code in reversed(CURRENCIES.items()):
        out = F.when(F.contains(c, F.lit(sign)), F.lit(code)).otherwise(out)
    return out


def amount(c: Column, allow_negative: bool = False) -> Column:
    """A number with any of four minus signs and a suffix; negative ones are null unless allowed."""
    v = number(F.regexp_replace(F.regexp_replace(c, "[−–—]", "-"), "%$", ""))
    return v if allow_negative else F.when(v >= 0, v)


def looks_numeric(c: Column) -> Column:
    """Whether a cell reads as a number once signs, separators and suffixes are gone."""
    return F.coalesce(number(F.regexp_replace(c, "%", "")).isNotNull(), F.lit(False))


def split_value(c: Column) -> tuple[Column, Column]:
    """A mixed cell as (number, text): one of the two is null, as a column has one type."""
    n = amount(c, allow_negative=True)
    return n, F.when(n.isNull(), c)


def converted(c: Column) -> tuple[Column, Column]:
    """A cell as (number, text) where only the suffixes B, M and K, separators, dollar and percent signs are read; other cells stay text."""
    bare = F.trim(F.regexp_replace(c, "[,$%]", ""))
    n = F.when(F.upper(F.right(bare, F.lit(1))) == "T", F.lit(None).cast("double")).otherwise(number(bare))
    return n, F.when(n.isNull(), c)


def is_numeric_cell(c: Column) -> Column:
    """Whether a cell of a delimited file is a number, thousands separators apart."""
    return F.coalesce(guarded_double(F.trim(F.regexp_replace(c, ",", ""))).isNotNull(), F.lit(False))


def in_millions(c: Column) -> Column:
    """Values of a million and more as 'X.XXM', others as they are with two decimals; halves are rounded up."""
    two = lambda x: F.round(x, 2).cast("decimal(38,2)").cast("string")
    return F.when(F.abs(c) >= 1_000_000, F.concat(two(c / 1_000_000), F.lit("M"))).otherwise(two(c))


# Parts of a column's name that tell how its values are written, in the order in which they are looked for.
ROLES = [
    ("price", ("price", "close", "open", "high", "low", "bid", "ask")),
    ("percent", ("percent", "pct", "change", "%")),
    ("volume", ("volume", "market_cap", "supply")),
    ("ticker", ("ticker", "symbol")),
]


def column_role(name: str) -> str:
    """How a column of this name is normalised: price, percent, volume, ticker or number."""
    return next((role for role, words in ROLES if any(w in name.lower() for w in words)), "number")


NORMALISERS = {"price": price, "percent": percentage, "volume": number, "ticker": ticker, "number": number}
