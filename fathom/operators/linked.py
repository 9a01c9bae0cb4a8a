"""Texts and images of the same slide or page: linked lookups, assembly of a slide, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """The first row of each combination."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_r = 1").drop("_r")


def linked(hits: DataFrame, others: DataFrame, on: list[str], key: str, out: str, order: list[Column]) -> DataFrame:
    """Hits with the key of the one row on the other side for the same document and place: a join instead of a lookup per hit."""
    side = one_per(others.where(F.col(on[-1]).isNotNull()), on, order).select(*on, F.col(key).alias(out))
    return hits.join(side, on, "left")


def assembled(df: DataFrame, on: list[str], kind: str, text: str, order: str, kinds: list[str]) -> DataFrame:
    """One record per place with the first text of each kind."""
    aggs = [F.min_by(F.when(F.col(kind) == k, F.col(text)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds]
    out = df.groupBy(*on).agg(*aggs, F.count("*").alias("n"))
    return out.withColumn("primary_text", F.coalesce(*kinds))


def terms(df: DataFrame, by: str, first: str, kinds: str, most: int = 1000) -> DataFrame:
    """(by, n, first, counts): the most frequent groups with the smallest ``first`` and the number of rows by kind."""
    per = df.groupBy(by, kinds).agg(F.count("*").alias("n"), F.min(first).alias("f"))
    g = per.groupBy(by).agg(F.sum("n").alias("n"), F.min("f").alias(first), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(kinds, F.lit("")), "n")))).alias("counts"))
    return g.orderBy(F.desc("n"), by).limit(most)
