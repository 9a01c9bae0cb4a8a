"""URLs, endpoints, robots rules and folders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import contains_any, count_present

# Parts of a URL that speak for data, and for tracking.
DATA_PARTS = ["api", "chart", "data", "series", "history", "export", "json", "csv", "xml", "stats", "metrics", "prices", "volume", "market", "ticker", "quote", "ohlc", "candle", "timeseries"]
TRACKING_PARTS = [
    "analytics", "tracking", "pixel", "beacon", "collect", "facebook", "google-analytics", "clarity", "hotjar", "segment", "amplitude",
    "mixpanel", "gtm", "recaptcha", "cookie", "consent", "ads", "advertising", "userstats", "adservice", "doubleclick", "googlesyndication",
    "sodar", "adtrafficquality", "ep1.adtrafficquality", "getconfig", "criteo", "gum.criteo", "prebid", "bid", "adapter",
]
# Parts of a URL that no data request has.
NO_DATA_PARTS = ["analytics", "tracking", "pixel", "beacon", "facebook", "google-analytics", "clarity", "fonts", "icons", ".css", ".js", "cookie", "consent", "recaptcha"]


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def slug(c: Column, most: int = 30) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""), F.lit(most))


def site_id(url: Column) -> Column:
    """Name of a site: slugs of domain and path and six digits of the URL's hash."""
    return F.lower(F.concat_ws("_", slug(domain(url)), F.nullif(slug(path(url)), F.lit("")), F.left(F.md5(url), F.lit(6))))


def is_data_request(url: Column, status: Column, content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.coalesce((status == 200) & (F.contains(kind, F.lit("json")) | F.contains(kind, F.lit("csv")) | F.contains(kind, F.lit("html"))), F.lit(False)) & ~contains_any(F.lower(url), NO_DATA_PARTS)


def endpoint_score(url: Column, content_type: Column, length: Column, same_domain: Column, is_series: Column) -> Column:
    """Confidence from 0 to 1 that an endpoint serves data."""
    u, kind = F.lower(url), F.coalesce(F.lower(content_type), F.lit(""))
    n = F.coalesce(length, F.lit(0))
    points = (
        2 * count_present(u, DATA_PARTS)
        - 10 * count_present(u, TRACKING_PARTS)
        + F.when(F.contains(kind, F.lit("json")), 1.0).when(F.contains(kind, F.lit("csv")), 1.5).when(F.contains(kind, F.lit("xml")), 1.2).otherwise(0.0)
        + F.when(same_domain, 0.5).otherwise(0.0)
        + F.when(n > 1000, 0.5).otherwise(0.0)
        + F.when(n > 10000, 0.5).otherwise(0.0)
        + F.when(is_series, 3.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), points / 10))


def page_numbers(html_or_url: Column) -> tuple[Column, Column]:
    """Smallest and largest page=N that occurs."""
    ns = F.transform(F.regexp_extract_all(html_or_url, F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_min(ns), F.array_max(ns)


def robots_verdicts(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``. ``rules`` (domain, kind allow|disallow, pattern): a pattern is a prefix in which * stands for
    anything; allowing wins. Rules meet URLs by domain, so the join is an equi-join; each URL keeps one row."""
    u = urls.select(url).distinct().withColumn("_d", domain(F.col(url))).withColumn("_p", path(F.col(url)))
    r = rules.withColumn("_re", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.?+()\[\]{}|^$\\])", r"\\$1"), r"\*", ".*")))
    hit = F.rlike("_p", F.col("_re"))
    j = u.join(r, F.col("_d") == F.col("domain"), "left").groupBy(url).agg(
        F.bool_or(F.coalesce((F.col("kind") == "allow") & hit, F.lit(False))).alias("_a"), F.bool_or(F.coalesce((F.col("kind") == "disallow") & hit, F.lit(False))).alias("_x")
    )
    return urls.join(j.select(url, (F.col("_a") | ~F.col("_x")).alias("allowed")), url, "left")


# Folders that name no module.
ROOT_FOLDERS = ["data", "documents", "files", "content"]


def folder_week(p: Column) -> Column:
    """Week number of the first part of a path that names one."""
    return F.regexp_extract(p, r"(?i)week\s*(\d+)", 1).try_cast("int")


def folder_module(p: Column) -> Column:
    """The folder that names the week, else the first that isn't a root folder."""
    parts = F.filter(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), lambda x: x != "")
    week = F.filter(parts, lambda x: x.rlike(r"(?i)week\s*\d+"))
    other = F.filter(parts, lambda x: ~F.lower(x).isin(ROOT_FOLDERS))
    return F.coalesce(F.get(week, F.lit(0)), F.get(other, F.lit(0)))


# Signs of dates in the text of a payload.
DATE_SIGNS = r"\d{4}-\d{2}-\d{2}|\d{10,13}|\"(?:date|time|timestamp)\""


def looks_like_series(body: Column) -> Column:
    """Whether a payload has dates and a list of at least two flat objects."""
    return F.coalesce(body.rlike(DATE_SIGNS) & body.rlike(r"\[\s*\{[^{}]+\}\s*,\s*\{"), F.lit(False))
