"""Irregular readings onto a regular grid of weekdays.

A sequence of days per source is generated from its first to its last row, bucket-aggregated readings are left-joined, the last
observation is carried forward within a maximum gap, and what remains is marked as missing.

The readings are aggregated to (source, day) before anything is shuffled, so repeated rows and dense sources cost no more than
their days; a source has at most 261 weekdays a year.

Defined results: rows without a date are ignored; a null source is a source of its own; null and NaN are no values; a source
whose dates all fall on one weekend has no grid days; ``status`` is observed, filled (carried forward at most ``max_gap`` grid
days) or missing. An empty table gives an empty grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def weekday_grid(df: DataFrame, source: str, at: str, fields: list[str], order: str | None = None, max_gap: int = 5) -> DataFrame:
    """(src, field, day, value, status): one row per source, field and weekday.

    The day's value is its last reading by ``at`` (ties by ``order``). ``at`` is a timestamp without zone or in UTC.
    """
    last = F.struct(F.col(at), *([F.col(order)] if order else []))
    daily = (
        df.where(F.col(at).isNotNull())
        .groupBy(F.col(source).cast("string").alias("src"), F.to_date(at).alias("day"))
        .agg(*[F.max_by(_clean(f), F.when(_clean(f).isNotNull(), last)).alias(f"v{i}") for i, f in enumerate(fields)])
    )
    days = (
        daily.groupBy("src")
        .agg(F.min("day").alias("a"), F.max("day").alias("b"))
        .select("src", F.explode(F.sequence("a", "b")).alias("day"))
        .where(F.weekday("day") < 5)
    )
    d = daily.withColumnsRenamed({"src": "d_src", "day": "d_day"})
    wide = days.join(d, days["src"].eqNullSafe(d["d_src"]) & (days["day"] == d["d_day"]), "left")
    named = [F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("reading")) for i, f in enumerate(fields)]
    long = wide.select("src", "day", F.explode(F.array(*named)).alias("x")).select("src", "day", "x.field", "x.reading")
    w = Window.partitionBy("src", "field").orderBy("day")
    back = w.rowsBetween(-max_gap, 0) if max_gap else w.rowsBetween(0, 0)
    carried = F.last("reading", ignorenulls=True).over(back)
    status = F.when(F.col("reading").isNotNull(), "observed").when(carried.isNotNull(), "filled").otherwise("missing")
    return long.select("src", "field", "day", carried.alias("value"), status.alias("status"))
