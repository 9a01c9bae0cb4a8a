"""Validation of tables: each check as a one-row-per-finding frame, and a score over all findings.

All statistics of all columns of a table come from one aggregation, those that need bounds from a second, and what needs order from one
window pass. Rows are never collected; ordered checks take a series key, so that no window spans the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import cut_lineage


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_null, null_pct, lo, hi, mean, std, n_negative) of numeric columns in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("n_null"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count_if(v < 0).alias("n_negative"),
            ).alias(f"s{i}")
        )
    one = df.agg(*aggs)
    out = one.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")
    return out.withColumn("null_pct", F.coalesce(F.try_divide(100.0 * F.col("n_null"), F.col("n")), F.lit(0.0)))


# Parts of a column's name that tell whether its values may be negative, in the order in which they are looked for.
SIGN_RULES = [("volume", False), ("open_interest", False), ("price", False), ("inflow", True), ("outflow", True), ("change", True)]


def negative_findings(stats: DataFrame) -> DataFrame:
    """(column, n_negative, severity) of columns with negative values: an error where the name rules them out, a warning where it says nothing."""
    told = F.coalesce(*[F.when(F.contains(F.lower("column"), F.lit(part)), F.lit(ok)) for part, ok in SIGN_RULES])
    out = stats.where("n_negative > 0").select("column", "n_negative", told.alias("ok"))
    return out.where("ok is null or not ok").select("column", "n_negative", F.when(F.col("ok").isNull(), "warning").otherwise("error").alias("severity"))


def null_severity(null_pct: Column) -> Column:
    return F.when(null_pct > 50, "error").when(null_pct > 10, "warning").otherwise("ok")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, n_duplicates): rows beyond the first of each combination, nulls being equal."""
    g = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def date_range(df: DataFrame, date: str, now: str, first: str = "2000-01-01") -> DataFrame:
    """(lo, hi, span_days, n_future, n_early) of a date column; ``now`` is a parameter, so results don't depend on the clock."""
    d = F.to_date(date)
    return df.agg(
        F.min(d).alias("lo"), F.max(d).alias("hi"), F.datediff(F.max(d), F.min(d)).alias("span_days"),
        F.count_if(d > F.lit(now).cast("date")).alias("n_future"), F.count_if(d < F.lit(first).cast("date")).alias("n_early"),
    )


def exact_quartiles(df: DataFrame, columns: list[str], few: int = 50_000) -> list[tuple[float | None, float | None]]:
    """The interpolated quartiles of each column. A bounded sketch brackets them, one pass counts what lies below the brackets, and only the values
    inside - a small share of the table - are ranked exactly; columns of up to ``few`` values are ranked as they are, as a bracket of a share
    of them may miss their neighbours. What reaches the driver is one row a pass."""
    v = [F.col(f"`{c}`").cast("double") for c in columns]
    v = [F.when(~F.isnan(x), x) for x in v]
    sketch = F.lit(10_000)
    near = df.agg(*[F.percentile_approx(x, F.array(*[F.lit(p) for p in (0.2495, 0.2505, 0.7495, 0.7505)]), sketch).alias(f"p{i}") for i, x in enumerate(v)], *[F.count(x).alias(f"c{i}") for i, x in enumerate(v)]).first()
    whole = [(-float("inf"), float("inf"))] * 2
    brackets = [(whole if near[f"c{i}"] <= few else [(p[0], p[1]), (p[2], p[3])]) if (p := near[f"p{i}"]) else None for i in range(len(columns))]
    used = [(i, k, lo, hi) for i, bs in enumerate(brackets) if bs for k, (lo, hi) in enumerate(bs)]
    if not used:
        return [(None, None)] * len(columns)
    counts = df.agg(*[a for i, k, lo, hi in used for a in (F.count(v[i]).alias(f"n{i}{k}"), F.count_if(v[i] < lo).alias(f"b{i}{k}"), F.count_if((v[i] >= lo) & (v[i] <= hi)).alias(f"m{i}{k}"))]).first()
    exact = []
    for i, k, lo, hi in used:
        place = (0.25, 0.75)[k] * (counts[f"n{i}{k}"] - 1) - counts[f"b{i}{k}"]
        inside = max(counts[f"m{i}{k}"] - 1, 1)
        exact.append(F.percentile(F.when((v[i] >= lo) & (v[i] <= hi), v[i]), F.lit(min(1.0, max(0.0, place / inside)))).alias(f"q{i}{k}"))
    got = df.agg(*exact).first()
    return [(got[f"q{i}0"], got[f"q{i}1"]) if bs else (None, None) for i, bs in enumerate(brackets)]


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 3.0, least: int = 10) -> DataFrame:
    """(column, n, lower, upper, n_outliers, pct): values beyond k interquartile ranges."""
    aggs = []
    for i, (c, (lo, hi)) in enumerate(zip(columns, exact_quartiles(df, columns))):
        v = F.col(f"`{c}`").cast("double")
        lower, upper = (None, None) if lo is None or hi is None else (lo - k * (hi - lo), hi + k * (hi - lo))
        bound = lambda x: F.lit(x).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), bound(lower).alias("lower"), bound(upper).alias("upper"), F.count_if((v < bound(lower)) | (v > bound(upper))).alias("n_outliers")).alias(f"s{i}"))
    out = df.agg(*aggs).select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*").where(F.col("n") >= least)
    return out.withColumn("pct", 100.0 * F.col("n_outliers") / F.col("n"))


def zscore_anomalies(df: DataFrame, columns: list[str], limit: float = 3.0, least: int = 10) -> DataFrame:
    """(column, n, n_anomalies, pct): values further than ``limit`` standard deviations from the mean."""
    s = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)])
    j = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).crossJoin(F.broadcast(s))  # s is one row
    aggs = [
        F.struct(F.lit(c).alias("column"), F.count(f"c{i}").alias("n"), F.count_if(F.abs(F.col(f"c{i}") - F.col(f"m{i}")) > limit * F.col(f"d{i}")).alias("n_anomalies")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    out = j.agg(*aggs).select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*").where(F.col("n") >= least)
    return out.withColumn("pct", 100.0 * F.col("n_anomalies") / F.col("n"))


def date_gaps(df: DataFrame, series: str, date: str, factor: float = 2.0) -> DataFrame:
    """(series, after, gap_s, median_s): steps longer than ``factor`` times the series' median step."""
    d = df.where(F.col(date).isNotNull()).select(F.col(series).alias("series"), F.col(date).alias("d")).distinct()
    prev = F.lag("d").over(Window.partitionBy("series").orderBy("d"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    steps = d.withColumn("after", prev).where("after is not null").withColumn("gap_s", (us(F.col("d")) - us(F.col("after"))) / 1e6)
    med = steps.groupBy("series").agg(F.median("gap_s").alias("median_s"))
    return steps.join(med, "series").where(F.col("gap_s") > factor * F.col("median_s")).select("series", "after", "gap_s", "median_s")


def jumps(df: DataFrame, series: str, order: list[str], value: str, most: float = 0.5) -> DataFrame:
    """(series, n, n_jumps): changes of more than ``most`` of the value before. From zero to anything else is a jump."""
    v = F.col(value)
    prev = F.lag(value).over(Window.partitionBy(series).orderBy(*order))
    jump = F.when(prev == 0, v != 0).otherwise(F.abs(F.try_divide(v - prev, prev)) > most)
    return df.where(v.isNotNull()).select(F.col(series).alias("series"), F.coalesce(jump, F.lit(False)).alias("j")).groupBy("series").agg(F.count("*").alias("n"), F.count_if("j").alias("n_jumps"))


def ohlc(df: DataFrame, period: list[Column], at: str, key: str, value: str) -> DataFrame:
    """Opening, highest, lowest and closing value per period."""
    first, last = F.struct(F.col(at), F.col(key)), F.struct(F.col(at), F.col(key))
    return df.where(F.col(value).isNotNull()).groupBy(*period).agg(F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, last).alias("close"))


def ohlc_violations(df: DataFrame) -> DataFrame:
    out = (F.col("open") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("high") < F.col("low")).alias("n_inverted"), F.count_if(out).alias("n_outside"))


def coverage(df: DataFrame, date: str, fields: list[str]) -> DataFrame:
    """(field, n, coverage_pct, lo, hi, latest_date, latest): per field how complete it is, and its latest value (ties: the largest)."""
    long = df.select(F.col(date).alias("d"), *[F.col(f"`{f}`").cast("double").alias(f) for f in fields]).unpivot(["d"], fields, "field", "v")
    v = F.when(~F.isnan("v"), F.col("v"))
    return long.select("d", "field", v.alias("v")).groupBy("field").agg(
        F.count("*").alias("n"), (100.0 * F.count("v") / F.count("*")).alias("coverage_pct"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max(F.when(F.col("v").isNotNull(), F.col("d"))).alias("latest_date"), F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("d", "v"))).alias("latest"),
    )


def series_summary(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(date), F.col(value)))
    return df.groupBy(series).agg(
        F.min_by(value, at).alias("first_value"), F.min(at[date]).alias("first_date"), F.max_by(value, at).alias("latest_value"), F.max(at[date]).alias("latest_date"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"),
    )


def currency_mix(df: DataFrame, group: str, text: str, order: str, look_at: int = 10) -> DataFrame:
    """(group, signs): the currency signs among each group's first non-null texts."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = df.where(F.col(text).isNotNull()).withColumn("_r", r).where(F.col("_r") <= look_at)
    return first.groupBy(group).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(text, F.lit("[$€£¥₹]"), F.lit(0)))))), "").alias("signs"))


def quality_score(n_errors: Column, n_warnings: Column, null_pcts: Column, duplicate_pct: Column) -> Column:
    """100 less 10 an error, 2 a warning, half of each column's null percentage (10 at most) and 0.3 of the duplicate
    percentage (5 at most), from 0 to 100."""
    nulls = F.aggregate(null_pcts, F.lit(0.0), lambda a, x: a + F.least(0.5 * x, F.lit(10.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 10 * n_errors - 2 * n_warnings - nulls - F.least(0.3 * duplicate_pct, F.lit(5.0))))


# Profile of a site by the prefix of its id, in the order in which they are tried.
PROFILES = {
    "coinglass": "crypto_metrics", "dune": "snapshot", "theblock": "time_series", "coingecko": "time_series", "cryptocompare": "time_series",
    "alphavantage": "snapshot", "invezz": "crypto_metrics", "bitcoin_com": "crypto_metrics", "fred": "market_sentiment",
}


def profile_of(site: Column) -> Column:
    out = F.lit("snapshot")
    for prefix, name in reversed(PROFILES.items()):
        out = F.when(F.startswith(site, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def percent_range(df: DataFrame, columns: list[str], low: float = -100.0, high: float = 1000.0) -> DataFrame:
    """(column, n, n_outside): percentages that can't be."""
    v = {c: F.col(f"`{c}`").cast("double") for c in columns}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if((x < low) | (x > high)).alias("n_outside")).alias(f"s{i}") for i, (c, x) in enumerate(v.items())])
    return one.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, present, candidate): whether each required column is there, and the first column that its name, in another case or as a part, may mean."""
    from fathom.sources.structured import resolve_column

    rows = [(c, c in df.columns, None if c in df.columns else resolve_column(df.columns, c)) for c in required]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean, candidate string")


def schema_findings(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """(column, expected, found, finding): columns that are missing, of another type, or not in the schema."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, t, have.get(c), "missing" if c not in have else "type") for c, t in schema.items() if have.get(c) != t]
    rows += [(c, None, t, "unknown") for c, t in have.items() if c not in schema]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, finding string")


def empty_frame(spark, schema: dict[str, str]) -> DataFrame:  # noqa: ANN001
    """A table of a schema without rows."""
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in schema.items()))


def validate(
    df: DataFrame, numeric: list[str], key: list[str], date: str, now: str, min_rows: int = 1, max_rows: int | None = None, required: list[str] = (), percents: list[str] = (),
    volumes: list[str] = (), prices: list[str] = (), signed: list[str] = (), series: str | None = None, checks: list = (),  # noqa: B006
) -> DataFrame:
    """(check, column, severity, n): the findings of a table. ``signed`` columns may be negative; ``prices`` and ``volumes`` may not. Gaps of
    dates and jumps of prices are looked for within ``series``. ``checks`` are callables from the frame to such findings."""
    stats = cut_lineage(column_stats(df, numeric))  # a row per column
    none = F.lit(None).cast("string")
    lit = lambda c, col, sev, n: (F.lit(c).alias("check"), col.alias("column"), F.lit(sev).alias("severity") if isinstance(sev, str) else sev.alias("severity"), n.cast("long").alias("n"))
    strict = {*prices, *volumes}
    negative = stats.where((F.col("n_negative") > 0) & ~F.col("column").isin(list(signed)))
    count = df.agg(F.count("*").alias("c"))
    dates = date_range(df, date, now)
    found = [
        stats.select(*lit("nulls", F.col("column"), null_severity(F.col("null_pct")), F.col("n_null"))).where("severity <> 'ok'"),
        negative.select(*lit("negative", F.col("column"), F.when(F.col("column").isin(list(strict)), "error").otherwise("warning"), F.col("n_negative"))),
        duplicates(df, key).where("n_duplicates > 0").select(*lit("duplicates", none, "warning", F.col("n_duplicates"))),
        dates.where("n_future > 0").select(*lit("future dates", F.lit(date), "warning", F.col("n_future"))),
        dates.where("n_early > 0").select(*lit("early dates", F.lit(date), "warning", F.col("n_early"))),
        count.where(F.col("c") < min_rows).select(*lit("too few rows", none, "error", F.col("c"))),
        iqr_outliers(df, numeric).where("pct > 5").select(*lit("outliers", F.col("column"), "warning", F.col("n_outliers"))),
        zscore_anomalies(df, numeric).where("pct > 5").select(*lit("anomalies", F.col("column"), "warning", F.col("n_anomalies"))),
    ]
    if max_rows is not None:
        found.append(count.where(F.col("c") > max_rows).select(*lit("too many rows", none, "warning", F.col("c"))))
    if required:
        found.append(required_columns(df, list(required)).where("not present").select(*lit("missing column", F.col("column"), "error", F.lit(1))))
    if percents:
        found.append(percent_range(df, list(percents)).where("n_outside > 0").select(*lit("percent range", F.col("column"), "warning", F.col("n_outside"))))
    if volumes:
        zeros = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`") == 0).alias("zero")).alias(f"s{i}") for i, c in enumerate(volumes)])
        zeros = zeros.select(F.explode(F.array(*[f"s{i}" for i in range(len(volumes))])).alias("s")).select("s.*")
        found.append(zeros.where("zero > 0.1 * n").select(*lit("zero volumes", F.col("column"), "warning", F.col("zero"))))
    if series:
        found.append(date_gaps(df, series, date).agg(F.count("*").alias("c")).where("c > 0").select(*lit("date gaps", F.lit(date), "warning", F.col("c"))))
        found += [jumps(df, series, [date], p).agg(F.sum("n_jumps").alias("c")).where("c > 0").select(*lit("jumps", F.lit(p), "warning", F.col("c"))) for p in prices]
    found += [c(df) for c in checks]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
