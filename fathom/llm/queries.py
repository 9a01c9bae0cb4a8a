"""The queries of the text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import cutoff, encode, neardup, packing, scans, split
from fathom.session import table


CAPACITY = 2048


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "search_chunks").select("result_id", "document_id", "page_number", "text")
    return split.split_oversized(chunks, "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select("result_id")


def p5_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from their pieces, without the overlaps, and whether the pieces keep the limit, the order and an overlap."""
    p = p5_pieces(spark, d)
    piece = F.struct("piece_no", "piece_start", "piece_end", "token_count", "n_pieces", "text")
    by = p.groupBy("result_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    before = lambda i: F.when(i > 0, F.get("ps", i - 1)["piece_end"]).otherwise(0)
    new = F.transform("ps", lambda x, i: F.substring(x["text"], before(i) - x["piece_start"] + 1, F.lit(1 << 30)))
    whole = F.when(F.col("ps")[0]["text"].isNotNull(), F.array_join(new, ""))
    good = F.forall(F.transform("ps", lambda x, i: (x["piece_no"] == i) & (x["token_count"] <= 1000) & ((i == 0) | (x["piece_start"] < before(i)) & (before(i) - x["piece_start"] <= 200))), lambda x: x)
    return by.select("result_id", whole.alias("text"), good.alias("good"), F.size("ps").cast("long").alias("n_pieces"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, d, "search_chunks"), "result_id", "text")
    return pairs.select(F.col("a").alias("result_id_a"), F.col("b").alias("result_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "search_chunks"), "result_id", "text").withColumnRenamed("row_id", "result_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "search_chunks"), "result_id", "document_id", "page_number", "chunk_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_clean(spark, d).select("result_id", F.explode("kinds").alias("noise"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p8_ids(spark, d), "doc_id", "ids")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_with_offsets(table(spark, d, "documents"), "doc_id", "text")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Whether the spans of a text's ids follow each other, and how many characters they cover."""
    joined = F.forall(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: (F.get("starts", i) == F.get("ends", i - 1)) | (F.get("starts", i) == F.get("ends", i - 1) - 1))
    good = F.when(F.size("ids") > 1, joined & (F.col("starts")[0] == 0)).otherwise(True)
    return p8_offsets(spark, d).select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("covered"), good.alias("good"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_harmonic(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.harmonic(sizes, "doc_id", "n_tokens", CAPACITY)


def p10_checked(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_texts(table(spark, d, "documents"), "doc_id", "source", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_checked(spark, d).where("size(reasons) > 0").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.truncation_rates(p10_checked(spark, d), "source")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_clean": p7_clean, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p8_offsets": p8_offsets, "p8_spans": p8_spans, "p9_packed": p9_packed, "p9_harmonic": p9_harmonic, "p10_found": p10_found, "p10_rates": p10_rates, "p10_checked": p10_checked}
# Pieces of 4,003 characters at most that share 200 add 3,803 to those before.
_REJOINED = "select result_id, text, true as good, case when floor(length(text) / 4) > 1000 then greatest(2, ceil((length(text) - 200) / 3803.0)) else 1 end::bigint as n_pieces from search_chunks"
_NEAR = r"""with w as (select result_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from search_chunks where text is not null),
s as (select result_id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 20),
x as (select a.result_id as a, b.result_id as b, len(a.s) as na, len(b.s) as nb, len(list_intersect(a.s, b.s)) as x from s a join s b on a.result_id < b.result_id and len(a.s) >= 0.7 * len(b.s) and len(b.s) >= 0.7 * len(a.s))
select a as result_id_a, b as result_id_b from x where x >= 0.7 * (na + nb - x) - 1e-9"""
SQL = {"p6_found": _NEAR, "p5_found": "select result_id from search_chunks where floor(length(text) / 4) > 1000", "p5_rejoined": _REJOINED, "p8_spans": "select doc_id, coalesce(length(text), 0) as covered, true as good from documents", "p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
