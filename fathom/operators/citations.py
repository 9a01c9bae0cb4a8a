"""Hits to cited context, citations, and sources read back from context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_label(module: Column, week: Column, slide: Column, page: Column, filename: Column) -> Column:
    """'module | Week w | Slide s or Page p | file', leaving out what is null; a slide goes before a page."""
    return F.concat_ws(
        " | ", F.nullif(module, F.lit("")), F.concat(F.lit("Week "), week.cast("string")),
        F.coalesce(F.concat(F.lit("Slide "), slide.cast("string")), F.concat(F.lit("Page "), page.cast("string"))), filename,
    )


def inline_citation(label: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]"))


def context_block(rank: Column, score: Column, label: Column, section: Column, text: Column) -> Column:
    head = F.format_string("--- Result %d (relevance: %.2f) ---", rank, score)
    return F.concat_ws("\n", head, F.concat(F.lit("Source: ["), label, F.lit("]")), F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))), text)


def contexts(hits: DataFrame, query: str, rank: str, block: Column) -> DataFrame:
    """(query, context): the blocks of a query in order; k per query."""
    g = hits.select(F.col(query), F.col(rank).alias("_r"), block.alias("_b")).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_r", "_b"))).alias("_l"))
    return g.select(query, F.array_join(F.col("_l._b"), "\n\n").alias("context"))


def sources_of(context: Column) -> Column:
    """The distinct source labels of a context in their order."""
    return F.array_distinct(F.regexp_extract_all(context, F.lit(r"(?i)Source:\s*\[([^\]]+)\]"), F.lit(1)))


def numbered(labels: Column) -> Column:
    """'[1] label' lines."""
    return F.array_join(F.transform(labels, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def parsed_source(label: Column) -> Column:
    """struct<week, slide, page, filename> of a label."""
    last = F.element_at(F.split(label, r" \| "), -1)
    num = lambda w: F.regexp_extract(label, rf"(?i){w}\s+(\d+)", 1).try_cast("int")
    return F.struct(num("Week").alias("week"), num("Slide").alias("slide"), num("Page").alias("page"), F.when(last.rlike(r"\.\w+$"), last).alias("filename"))
