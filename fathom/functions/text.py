"""Text expressions: hash normalisation, tokens, shingles, estimates, tags and names. All run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]+"
# A run of white space that isn't one plain blank: replacing those only gives the same and copies much less.
UNEVEN = r" [\s\p{Z}]+|[\s\p{Z}&&[^ ]][\s\p{Z}]*"
WORD = r"[\p{L}\p{N}_]+"


def hash_normal(c: Column, lower: bool = True, collapse: bool = True, strip_signs: bool = True) -> Column:
    """Text as it is hashed: lower case, runs of white space to one blank, signs removed, trimmed - in this order. Null becomes ''."""
    t = F.coalesce(c, F.lit(""))
    if lower:
        t = F.lower(t)
    if collapse:
        t = F.regexp_replace(t, UNEVEN, " ")
    if strip_signs:
        t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\p{Z}]", "")
    return F.trim(t)


def content_hash(c: Column) -> Column:
    return F.sha2(hash_normal(c), 256)


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def once(value: Column, f) -> Column:  # noqa: ANN001
    """f(value) with the value computed once per row: an expression inside a lambda is otherwise computed anew for every element."""
    return F.transform(F.array(value), f)[0]


def char_shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased, collapsed text; shorter texts are their own shingle. Linear in the text."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), UNEVEN, " "))

    def grams(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - n)
        return F.when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))))

    return once(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), grams)


# Words that don't count in the comparison of words.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]


def content_words(c: Column) -> Column:
    """Distinct tokens of more than two characters without stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def parser_normal(c: Column) -> Column:
    """White space collapsed, control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def strip_html(c: Column) -> Column:
    """Text without scripts, tags and the usual entities; texts without both angle brackets are left alone."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), t).otherwise(c)


def printable(c: Column) -> Column:
    """White space collapsed, signs that can't be shown dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANK, " "), r"\p{C}", ""))


def clean_name(c: Column) -> Column:
    """A header or tag as a column name: ASCII letters and digits in lower case, other signs to single underscores; 'column' if nothing is left."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), "[^0-9a-zA-Z_]+", "_")), "_+", "_")
    return F.coalesce(F.nullif(F.trim(t, F.lit("_")), F.lit("")), F.lit("column"))


def column_name(raw: str) -> str:
    """A header as a column name: lower case, other signs to single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z_]", "_", raw.strip())).strip("_").lower() or "column"


def preview(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether any of the parts occurs in the text."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def count_present(c: Column, parts: list[str]) -> Column:
    """How many of the parts occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(p)).cast("int") for p in parts])
