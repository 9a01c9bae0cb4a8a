"""Folders of documents, exports with their metadata, raw responses, and upserts into a table of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {".pdf": "pdf", ".pptx": "pptx", ".ppt": "pptx", ".docx": "docx", ".doc": "docx"}


def document_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for e, t in EXTENSIONS.items():
        out = F.when(ext == e, F.lit(t)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, document_type) of the documents below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{pdf,pptx,ppt,docx,doc}").load(folder)
    return files.select("path", "length", "modificationTime", document_type(F.col("path")).alias("document_type"))


def put_texts(spark: SparkSession, texts: dict[str, str]) -> None:
    """Small files by path, on whatever file system the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path, text in texts.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()


def export_metadata(df: DataFrame, date: str | None = None) -> DataFrame:
    """(property, value) of a table to go with an export."""
    aggs = [F.count("*").cast("string").alias("rows")] + ([F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last")] if date else [])
    one = df.agg(*aggs).withColumn("columns", F.lit(str(len(df.columns)))).withColumn("names", F.lit(", ".join(df.columns)))
    return one.unpivot([], one.columns, "property", "value")


def export(df: DataFrame, folder: str, kind: str = "csv", date: str | None = None) -> None:
    """Writes the data and its metadata side by side."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if kind == "csv" else w.json if kind == "json" else w.parquet)(f"{folder}/data")
    export_metadata(df, date).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def response_type(body: Column) -> Column:
    """json, html, text or binary by how a response starts."""
    head = F.trim(F.left(body, F.lit(512)))
    return F.when(head.rlike(r"^[\[{]"), "json").when(head.rlike(r"(?i)^<(!doctype|html|\?xml|table|div)"), "html").when(head.rlike(r"[\x00-\x08]"), "binary").otherwise("text")


def save_raw(df: DataFrame, folder: str, site: str, run: str) -> None:
    df.write.mode("append").partitionBy(site, run).parquet(folder)


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after rows of ``changes`` replaced those of the same key; the last of repeated changes can't be told, so keys of
    ``changes`` have to be unique."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def known_hashes(chunks: DataFrame, column: str = "content_hash") -> DataFrame:
    return chunks.select(column).where(F.col(column).isNotNull()).distinct()
