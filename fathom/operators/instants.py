"""Mixed timestamp texts to unambiguous UTC instants.

Every text is parsed once, under every format that can hold it, giving a set of interpretations. An expectation-maximisation fits
the weights of a mixture of formats to the counts of those sets: the likelihood of a value under a format is one where it parses, so the
posterior of an interpretation is its format's weight over the sum of the weights of all formats that parse the value. It runs twice: over
all values of a locale, from a prior that prefers no format, and for each source, with the mixture of its locale as the prior, worth
``strength`` values however many the source has. So the values that leave no doubt tell the order of day and month for a
source, and for its locale where the source has none or few. The largest posterior chooses. Where no value of the locale tells the order, the
one customary there counts; where values do, the largest posterior stays below ``min_posterior`` and is not that of the customary order, the
value is marked ambiguous.

The fits see one row per (source or locale, set of formats): the counts are aggregated map-side, so a hot source costs nothing, and the
number of sets is bounded by the fixed format list, not by the data. Only values of several interpretations meet the fits in a join.

Wall times are read in the zone of the text, else of the source: a time that occurs twice is its first occurrence, a skipped
one is read with the offset before the change. Digits beyond microseconds are dropped. A date alone is its first moment.

Defined results: null, blank and unreadable texts, however long, and impossible dates give no row; an unknown or null zone counts as UTC; an
unknown or null locale as en-GB (day first). Repeated rows are each normalised. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from fathom.session import cut_lineage

# Month names by language, as abbreviated and in full.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
# Abbreviations that differ from the first three letters.
MONTHS_MORE = {"sept": 9, "mrz": 3, "janv": 1, "févr": 2, "fevr": 2, "fevrier": 2, "avr": 4, "juil": 7, "aout": 8, "déc": 12, "decembre": 12, "maerz": 3}
# Zone abbreviations in hours from UTC, used where the source's own zone doesn't know the name.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5,
    "JST": 9, "KST": 9, "AWST": 8, "ACST": 9.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "HKT": 8, "SGT": 8,
}

EPOCH = datetime(1970, 1, 1)
_NAMES: dict[str, dict[str, int]] = {}


def _months(lang: str) -> dict[str, int]:
    if lang not in _NAMES:
        names: dict[str, int] = {}
        for one in dict.fromkeys(("en", lang if lang in MONTHS else "en")):  # the source's own language wins
            for i, m in enumerate(MONTHS[one].split(), 1):
                names[m] = i
                if len(m[:3]) == 3 and not (one == "fr" and m.startswith(("juin", "juil"))):
                    names[m[:3]] = i
                names.setdefault(m[:4], i)
        names.update({k: v for k, v in MONTHS_MORE.items()})
        _NAMES[lang] = names
    return _NAMES[lang]


_T = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?(?:\s*Uhr)?"
_Z = r"(?:\s*(?P<z>[Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+\-]+)+))?"
_M = r"(?P<mon>[^\W\d_]{3,12})\.?"
_TAIL = rf"(?:(?:[T\s]|,\s*|\s+um\s+|\s+à\s+)\s*{_T}{_Z})?"
# name, pattern; of the numeric ones, the order of the three numbers.
PATTERNS: list[tuple[str, re.Pattern[str]]] = [
    (name, re.compile(rf"\s*{p}\s*", re.I))
    for name, p in [
        ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}){_TAIL}"),
        ("iso_basic", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_Z})?"),
        ("ymd", rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}}){_TAIL}"),
        ("dmy", rf"(?P<d>\d{{1,2}})[/.](?P<m>\d{{1,2}})[/.](?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
        ("mdy", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
        ("yy_md", rf"(?P<y>\d{{2}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_TAIL}"),
        ("day_name", rf"(?:[^\W\d_]{{2,10}}\.?,\s*)?(?P<d>\d{{1,2}})\.?[\s-]{_M}[\s-](?P<y>\d{{4}}){_TAIL}"),
        ("name_day", rf"{_M}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_TAIL}"),
        ("epoch_s", r"(?P<es>-?\d{9,10})(?:\.(?P<f>\d{1,9}))?"),
        ("epoch_ms", r"(?P<ems>\d{12,13})"),
        ("epoch_us", r"(?P<eus>\d{15,16})"),
        ("epoch_ns", r"(?P<ens>\d{18,19})"),
    ]
]
FORMATS = [n for n, _ in PATTERNS]
_BIT = {f: i for i, f in enumerate(FORMATS)}
_AT = {f: (i,) for f, i in _BIT.items()} | {"numeric": (_BIT["dmy"], _BIT["mdy"], _BIT["yy_md"]), "names": (_BIT["day_name"], _BIT["name_day"]), "epoch": tuple(i for f, i in _BIT.items() if f in ("epoch_ms", "epoch_us", "epoch_ns"))}
# Locales that customarily write the month first; asked only where no value tells the order.
MONTH_FIRST = ("en-US", "en-PH", "es-US")


@cache
def _zone(name: str | None) -> ZoneInfo:
    try:
        return ZoneInfo(name or "UTC")
    except Exception:
        return ZoneInfo("UTC")


def _micros(wall: datetime, z: str | None, zone: str | None) -> int | None:
    d = wall - EPOCH
    us = (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    if z is None:
        # fold=0: the first of two, and for a skipped time the offset before the change.
        return us - _seconds(wall.replace(tzinfo=_zone(zone))) * 1_000_000
    if z in ("Z", "z"):
        return us
    if z[0] in "+-":
        h, m = int(z[1:3]), int(z[3:].lstrip(":") or 0)
        if h > 18 or m > 59:
            return None
        return us - (1 if z[0] == "+" else -1) * (h * 60 + m) * 60_000_000
    if "/" in z:
        try:
            return us - _seconds(wall.replace(tzinfo=ZoneInfo(z))) * 1_000_000
        except Exception:
            return None
    for fold in (0, 1):  # an abbreviation of the source's own zone tells the two occurrences apart
        own = wall.replace(tzinfo=_zone(zone), fold=fold)
        if own.tzname() and own.tzname().upper() == z.upper():
            return us - _seconds(own) * 1_000_000
    if z.upper() in ZONES:
        return us - int(ZONES[z.upper()] * 3_600_000_000)
    return None


def _seconds(moment: datetime) -> int:
    offset = moment.utcoffset() or timedelta(0)
    return offset.days * 86_400 + offset.seconds


def _possible(t: str) -> tuple[int, ...]:
    """The patterns that a stripped text can match, told by how many digits it starts with and what follows them."""
    k = 0
    while k < len(t) and k < 20 and t[k] in "0123456789":
        k += 1
    after = t[k : k + 1]
    if k == 4:
        return _AT["iso"] if after == "-" else _AT["ymd"] if after in ("/", ".") else ()
    if k in (1, 2):
        return _AT["numeric"] if after in ("/", ".") and t[k + 1 : k + 2].isdigit() else _AT["day_name"]
    if k == 8:
        return _AT["iso_basic"]
    return _AT["names"] if k == 0 and after != "-" else _AT["epoch_s"] if k <= 10 else _AT["epoch"]


def readings(text: str | None, zone: str | None, locale: str | None) -> list[tuple[str, int]]:
    """All interpretations of a text: (format, micros)."""
    t = text.strip() if text else ""
    out = []
    for at in _possible(t) if t else ():
        name, p = PATTERNS[at]
        m = p.fullmatch(t)
        if m is None:
            continue
        g = m.groupdict()
        try:
            frac = int((g["f"] + "000000")[:6]) if g.get("f") else 0
            if name.startswith("epoch"):
                out.append((name, int(g["es"]) * 1_000_000 + frac if name == "epoch_s" else int(g["ems"]) * 1000 if name == "epoch_ms" else int(g["eus"]) if name == "epoch_us" else int(g["ens"]) // 1000))
                continue
            y = int(g["y"])
            if len(g["y"]) == 2:
                y += 2000 if y < 70 else 1900
            mon = int(g["m"]) if g.get("m") else _months((locale or "en")[:2].lower()).get(g["mon"].lower())
            if mon is None:
                continue
            h, ap = int(g.get("h") or 0), g.get("ap")
            if ap:
                if not 1 <= h <= 12:
                    continue
                h = h % 12 + (12 if ap[0] in "pP" else 0)
            wall = datetime(y, mon, int(g["d"]), h, int(g.get("mi") or 0), int(g.get("s") or 0), frac)
            us = _micros(wall, g.get("z"), zone)
        except (ValueError, OverflowError):
            continue
        if us is not None:
            out.append((name, us))
    return out


def mixture(sets: list[tuple[tuple[int, ...], int]], prior: list[float], rounds: int = 200) -> list[float]:
    """Weights of the formats, by expectation-maximisation from the counts of the sets of formats that parse a value; ``prior`` has
    the pseudo-counts of the formats, however many values there are."""
    w = [p / sum(prior) for p in prior]
    for _ in range(rounds):
        new = list(prior)
        for fs, n in sets:
            z = sum(w[f] for f in fs)
            for f in fs:
                new[f] += n * w[f] / z
        total = sum(new)
        w, old = [v / total for v in new], w
        if max(abs(a - b) for a, b in zip(w, old)) < 1e-9:
            break
    return w


def _members(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(len(FORMATS)) if mask >> i & 1)


def _parsed(t: DataFrame) -> DataFrame:
    """The columns of ``t`` with ``mask`` (a bit for each format that parses the text) and ``us``, the instants in the order of the bits; readable values only."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            masks, instants, readable = [], [], []
            for text, zone, locale in zip(*(r.column(c).to_pylist() for c in ("t", "tz", "loc"))):
                found = readings(text, zone, locale)
                readable.append(bool(found))
                if found:
                    masks.append(sum(1 << _BIT[f] for f, _ in found))
                    instants.append([us for _, us in found])
            kept = r.filter(pa.array(readable, pa.bool_())).drop_columns(["t", "tz"])
            arrays = [*kept.columns, pa.array(masks, pa.int32()), pa.array(instants, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.schema.names, "mask", "us"])

    schema = StructType([f for f in t.schema.fields if f.name not in ("t", "tz")]).add("mask", IntegerType()).add("us", ArrayType(LongType()))
    return t.where("t is not null").mapInArrow(run, schema)


def _locale_mixtures(counts: DataFrame) -> DataFrame:
    """(l_loc, weights, tells): the mixture of each locale, over all its sources, and whether a value of it can be read in one order of day and month only."""
    orders = {_BIT["dmy"], _BIT["mdy"]}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [mixture([(_members(s["mask"]), s["n"]) for s in sets], [0.5] * len(FORMATS)) for sets in b["sets"]]
            tells = [any(_members(s["mask"])[0] in orders and len(_members(s["mask"])) == 1 for s in sets) for sets in b["sets"]]
            yield pd.DataFrame({"l_loc": b["loc"], "weights": w, "tells": tells})

    per_set = counts.groupBy("loc", "mask").agg(F.sum("n").alias("n"))
    return per_set.groupBy("loc").agg(F.collect_list(F.struct("mask", "n")).alias("sets")).mapInPandas(fit, "l_loc string, weights array<double>, tells boolean")


def _choices(counts: DataFrame, strength: float) -> DataFrame:
    """(m_src, m_loc, m_mask, best, posterior, tells): the format that each source gives to its values of several interpretations."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for src, loc, sets, general, tells in zip(b["src"], b["loc"], b["sets"], b["weights"], b["tells"]):
                w = mixture([(_members(s["mask"]), s["n"]) for s in sets], [strength * x for x in general])
                for mask in sorted(s["mask"] for s in sets):
                    fs = _members(mask)
                    if len(fs) > 1:
                        best = max(fs, key=lambda f: (w[f], -f))
                        rows.append((src, loc, mask, best, w[best] / sum(w[f] for f in fs), tells))
            out = pd.DataFrame(rows, columns=["m_src", "m_loc", "m_mask", "best", "posterior", "tells"])
            yield out.astype({"m_mask": "int32", "best": "int32", "posterior": "float64", "tells": "bool"})

    per_source = counts.groupBy("src", "loc").agg(F.collect_list(F.struct("mask", "n")).alias("sets"))  # at most one row per set of formats
    several = F.exists("sets", lambda s: F.bit_count(s["mask"]) > 1)
    fitted = per_source.where(several).join(_locale_mixtures(counts), F.col("loc").eqNullSafe(F.col("l_loc")))
    return fitted.mapInPandas(fit, "m_src string, m_loc string, m_mask int, best int, posterior double, tells boolean")


def normalise_instants(
    df: DataFrame, key: str, text: Column, source: Column, zone: Column, locale: Column, extra: dict[str, Column] | None = None, min_posterior: float = 0.6, strength: float = 4.0
) -> DataFrame:
    """(row_key, *extra, utc_micros, format, posterior, status): one row per readable value.

    status is certain (one reading, or all readings are the same instant), resolved (the mixture chose), customary (no value of the locale tells, or too few for another order) or ambiguous.
    """
    kept = {"row_key": F.col(key), **(extra or {})}
    t = df.select(*[c.alias(n) for n, c in kept.items()], text.cast("string").alias("t"), source.cast("string").alias("src"), zone.cast("string").alias("tz"), locale.cast("string").alias("loc"))
    parsed = cut_lineage(_parsed(t))  # texts are parsed once
    names = F.array(*[F.lit(f) for f in FORMATS])
    one = parsed.where("bit_count(mask) = 1").select(
        *kept, F.col("us")[0].alias("utc_micros"), names[F.log2("mask").cast("int")].alias("format"), F.lit(1.0).alias("posterior"), F.lit("certain").alias("status")
    )
    choices = _choices(parsed.groupBy("src", "loc", "mask").agg(F.count("*").alias("n")), strength)
    several = parsed.where("bit_count(mask) > 1")
    same = several["src"].eqNullSafe(choices["m_src"]) & several["loc"].eqNullSafe(choices["m_loc"]) & (several["mask"] == choices["m_mask"])
    bit = lambda name: F.lit(_BIT[name])
    custom = F.when(F.col("loc").isin(*MONTH_FIRST), bit("mdy")).otherwise(bit("dmy"))
    told = F.col("posterior") >= min_posterior
    holds = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), custom)) > 0
    best = F.when(told | ~holds, F.col("best")).otherwise(custom)
    at = F.bit_count(F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), best) - 1))
    instants = F.size(F.array_distinct("us"))
    status = F.when(instants == 1, "certain").when(told, "resolved").when(~F.col("tells") | (F.col("best") == custom), "customary").otherwise("ambiguous")
    more = several.join(choices, same).select(*kept, F.get("us", at).alias("utc_micros"), F.get(names, best).alias("format"), "posterior", status.alias("status"))
    return one.unionByName(more)


def query_moments(url: Column, params: tuple[str, ...]) -> Column:
    """array<struct<field, value>> of the named query parameters, decoded; '' and an absent query give an empty array."""
    query = F.split(F.get(F.split(url, r"\?", 2), F.lit(1)), "#", 2)[0]
    pairs = F.transform(F.split(query, "&"), lambda kv: F.struct(F.split(kv, "=", 2)[0].alias("field"), F.get(F.split(kv, "=", 2), F.lit(1)).alias("value")))
    wanted = F.filter(pairs, lambda p: p["field"].isin(*params))
    # A plus means a blank, but between a time and an offset it can only have been a sign.
    signed = lambda v: F.regexp_replace(v, r"^(.*T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?) (\d{2}:?\d{2})$", "$1+$2")
    return F.transform(wanted, lambda p: F.struct(p["field"].alias("field"), signed(F.try_url_decode(p["value"])).alias("value")))
