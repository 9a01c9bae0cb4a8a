"""Reshaping and merging of time series: long and wide form, N-way merges, alignment, tagged unions, latest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(df: DataFrame, date: str, values: list[str], asset: str | None = None, source: str | None = None) -> DataFrame:
    """Wide to long: (date, asset, metric, value[, source]). A name a_b_c is metric b_c of asset A; a name without underscore is a
    metric of ``asset``. Null values keep their row."""
    named = df.select(date, *[F.col(f"`{v}`").cast("double").alias(v) for v in values])
    long = named.unpivot([date], values, "name", "value")
    parts = F.split("name", "_")
    compound = F.size(parts) > 1
    out = long.select(
        date,
        F.when(compound, F.upper(parts[0])).otherwise(F.lit(asset or "UNKNOWN")).alias("asset"),
        F.when(compound, F.array_join(F.slice(parts, 2, F.size(parts)), "_")).otherwise(F.col("name")).alias("metric"),
        "value",
    )
    return out.withColumn("source", F.lit(source)) if source else out


def to_wide(df: DataFrame, date: str, asset: str, metric: str, value: str, names: list[str], order: str) -> DataFrame:
    """Long to wide: a column per asset_metric of ``names``, holding the first non-null value by ``order``. Null keys are dropped."""
    name = F.lower(F.concat_ws("_", asset, metric))
    src = df.where(F.col(date).isNotNull() & F.col(asset).isNotNull() & F.col(metric).isNotNull()).withColumn("_n", name)
    return src.groupBy(date).agg(*[F.min_by(F.when(F.col("_n") == n, F.col(value)), F.when((F.col("_n") == n) & F.col(value).isNotNull(), F.col(order))).alias(n) for n in names])


def normalise(df: DataFrame, date: Column, numeric: dict[str, Column], keep: list[str]) -> DataFrame:
    """Dates read, numbers coerced, rows without a date dropped."""
    return df.select(date.alias("date"), *[c.alias(n) for n, c in numeric.items()], *keep).where("date is not null")


def merge(frames: list[DataFrame], on: str, how: str = "full") -> DataFrame:
    """N-way merge on a key. Colliding value columns are renamed _2, _3 and so on."""
    seen: set[str] = {on}
    fixed = []
    for i, f in enumerate(frames, 1):
        clash = {c: f"{c}_{i}" for c in f.columns if c in seen and c != on}
        f = f.withColumnsRenamed(clash)
        seen |= set(f.columns)
        fixed.append(f)
    return reduce(lambda a, b: a.join(b, on, how), fixed)


def align_left(first: DataFrame, others: list[DataFrame], on: str) -> DataFrame:
    """The first frame's rows with the columns of the others; a repeated key in one of the others is an error."""
    out = first
    for o in others:
        once = o.groupBy(on).agg(*[F.first(c).alias(c) for c in o.columns if c != on], F.count("*").alias("_n"))
        checked = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(on).cast("string")))).otherwise(True))
        out = out.join(checked.where("_ok").drop("_n", "_ok"), on, "left")
    return out


def with_calendar(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)})


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of all frames with the name of their frame; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(n)) for n, f in frames.items()])


def top_k(df: DataFrame, by: list[Column], k: int, within: list[str] | None = None) -> DataFrame:
    """The k first rows, over all or within each group; ``by`` has to end in a key to be deterministic."""
    if not within:
        return df.orderBy(*by).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= k)


def first_success(runs: DataFrame, job: list[str], priority: str, ok: Column) -> DataFrame:
    """Of each job's sources in order of priority the first that succeeded, and those tried before."""
    w = Window.partitionBy(*job).orderBy(priority)
    tried = F.sum(F.when(ok, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumns({"tried_before": F.row_number().over(w) - 1, "_won": F.coalesce(tried, F.lit(0))})
    return marked.where(ok & (F.col("_won") == 0)).drop("_won")
