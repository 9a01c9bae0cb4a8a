"""Styled text runs against formatting rules: violations, islands of consecutive ones, signatures with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ["font", "size", "bold", "italic", "underline", "color"]


def block_parts(block: Column) -> Column:
    """struct<kind, cell, para, run> of ids such as p12_r3 and t0_r1_c1_p26_r3."""
    cell = F.nullif(F.regexp_extract(block, r"^(t\d+_r\d+_c\d+)_", 1), F.lit(""))
    return F.struct(
        F.when(cell.isNull(), "body").otherwise("table").alias("kind"), cell.alias("cell"),
        F.regexp_extract(block, r"(?:^|_)p(\d+)_r\d+$", 1).try_cast("int").alias("para"), F.regexp_extract(block, r"_r(\d+)$", 1).try_cast("int").alias("run"),
    )


def violations(observed: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Names of the attributes that differ from what is expected, in order; what isn't expected or observed isn't compared. Sizes may
    differ by 0.1, colours in case."""
    out = []
    for a in ATTRIBUTES:
        o, e = observed[a], expected[a]
        if a == "size":
            bad = F.abs(o - e) > 0.1
        elif a == "color":
            bad = F.lower(o) != F.lower(e)
        else:
            bad = o != e
        out.append(F.when(bad, F.lit(f"{a}_mismatch")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def islands(df: DataFrame, group: list[str], block: str) -> DataFrame:
    """``df`` with ``island``: consecutive runs of one paragraph or of the next, within the same cell, belong together."""
    p = block_parts(F.col(block))
    w = Window.partitionBy(*group, "_cell").orderBy("_para", "_run", block)
    d = df.withColumn("_p", p).withColumns({"_cell": F.coalesce(F.col("_p.cell"), F.lit("")), "_para": F.col("_p.para"), "_run": F.col("_p.run")})
    same = (F.col("_para") == F.lag("_para").over(w)) & (F.col("_run") - F.lag("_run").over(w) <= 1)
    follows = F.col("_para") - F.lag("_para").over(w) == 1
    d = d.withColumn("_new", F.when(same | follows, 0).otherwise(1))
    return d.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cell", F.col("_cell")).drop("_p", "_cell", "_para", "_run", "_new")


def merged_text(texts: Column, most: int = 200) -> Column:
    t = F.array_join(texts, "\n")
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def by_signature(df: DataFrame, group: list[str], found: str, order: str, keep: list[str]) -> DataFrame:
    """One row per set of violations: the first with how many more there are."""
    sig = F.array_join(F.array_sort(F.array_distinct(found)), ",")
    first = [F.min_by(c, order).alias(c) for c in keep]
    return df.where(F.size(found) > 0).groupBy(*group, sig.alias("signature")).agg(*first, (F.count("*") - 1).alias("more"))


def more_comment(more: Column) -> Column:
    return F.when(more > 0, F.concat(F.lit("("), more.cast("string"), F.lit(" more similar error"), F.when(more > 1, "s").otherwise(""), F.lit(" found)"))).otherwise("")


def is_heading(style: Column, bold: Column, text: Column) -> Column:
    """By style, or bold and either in capitals or short."""
    n = F.length(text)
    capitals = (F.upper(text) == text) & text.rlike(r"\p{L}") & (n >= 2)
    return F.coalesce(F.contains(F.lower(style), F.lit("heading")), F.lit(False)) | (F.coalesce(bold, F.lit(False)) & (capitals | ((n >= 2) & (n < 50))))


def pass_rate(df: DataFrame, ok: Column) -> DataFrame:
    n, p = F.count("*"), F.count_if(ok)
    return df.agg(n.alias("total"), p.alias("passed"), (n - p).alias("failed"), F.round(F.coalesce(F.try_divide(100.0 * p, n), F.lit(0.0)), 2).alias("pass_rate"))
