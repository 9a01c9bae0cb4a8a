"""What a payload of unknown form holds, and how its columns map to wanted ones: shapes, strategies, suggestions, sheets and registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources.structured import resolve_column


def json_shape(doc: Column) -> Column:
    """invalid, object, array_of_objects, array_of_arrays, array_of_values, empty_array or value, by the first element of an array."""
    v = F.try_parse_json(doc)
    outer, first = F.schema_of_variant(v), F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant"))
    array = F.when(first.isNull(), "empty_array").when(F.startswith(first, F.lit("OBJECT")), "array_of_objects").when(F.startswith(first, F.lit("ARRAY")), "array_of_arrays").otherwise("array_of_values")
    return F.when(v.isNull(), "invalid").when(F.startswith(outer, F.lit("OBJECT")), "object").when(F.startswith(outer, F.lit("ARRAY")), array).otherwise("value")


def extract_json(text: Column) -> Column:
    """The JSON a text carries: in the first fence, else from its first opening brace to its last closing one; null if that is none."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, braces)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def strategy(body: Column) -> Column:
    """How a payload of unknown form is read: the first of api, embedded, table, csv and xml that finds something; null if none does."""
    t = F.trim(body)
    is_json = t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull()
    embedded = t.rlike(r"(?is)<script[^>]*>.*(?:var|let|const|window\.)\s*[\w.]+\s*=\s*[\[{]") | t.rlike(r"(?is)<script[^>]*application/json")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    cells = lambda i: F.size(F.split(F.get(lines, F.lit(i)), "[,;\t|]"))
    is_csv = (F.size(lines) > 1) & (cells(0) > 1) & (cells(0) == cells(1)) & ~F.startswith(t, F.lit("<"))
    return F.when(is_json, "api").when(embedded, "embedded").when(t.rlike(r"(?i)<table"), "table").when(is_csv, "csv").when(t.rlike(r"(?i)^<(\?xml|rss|feed)"), "xml")


def suggested_fields(fields: DataFrame, field: str, wanted: dict[str, list[str]]) -> DataFrame:
    """(target, field, how): for each wanted column the field whose name is one of its keywords, else one that has a keyword as a part; the earlier
    keyword counts, then the name. The keywords are parameters, a few rows; names are compared in lower case."""
    rows = [(t, k, i) for t, ks in wanted.items() for i, k in enumerate(ks)]
    k = F.broadcast(fields.sparkSession.createDataFrame(rows, "target string, keyword string, nr int"))
    low = F.lower(F.col(field))
    j = fields.select(F.col(field).alias("field"), low.alias("low")).distinct().join(k, F.contains("low", "keyword"))
    rank = F.struct(F.when(F.col("low") == F.col("keyword"), 0).otherwise(1).alias("part"), "nr", "field")
    best = j.groupBy("target").agg(F.min(rank).alias("b"))
    return best.select("target", "b.field", F.when(F.col("b.part") == 0, "exact").otherwise("part").alias("how"))


def renamed_like(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns of a result whose names are only roughly known (exactly, in another case, as a part); missing ones are null."""
    at = {new: resolve_column(df.columns, name) for new, name in wanted.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(new) for new, c in at.items()])


def picked_value(df: DataFrame, keywords: list[str]) -> Column:
    """Of a one-row result the first positive number whose column has a keyword as a part, by order of keywords, else the largest number."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    value = lambda c: F.col(f"`{c}`").cast("double")
    named = [F.when(value(c) > 0, value(c)) for k in keywords for c in numeric if k in c.lower()]
    largest = F.greatest(*map(value, numeric)) if len(numeric) > 1 else value(numeric[0]) if numeric else F.lit(None).cast("double")
    return F.coalesce(*named, largest)


def index_rows(df: DataFrame, keys: list[str], doc: Column, names: dict[str, str]) -> DataFrame:
    """(keys, day, values): an object of days to objects of numbers, nested once more under 'Data' or not, with fields renamed by ``names``."""
    days = "map<string,map<string,double>>"
    inner = F.coalesce(F.get_json_object(doc, "$.Data.Data"), F.get_json_object(doc, "$.Data"), doc)
    rows = df.select(*keys, F.explode(F.from_json(inner, days)).alias("day", "v"))
    return rows.select(*keys, F.to_date("day").alias("day"), *[F.col("v")[old].alias(new) for old, new in names.items()])


def sheet_table(cells: DataFrame, nr: str, row: str, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns of a sheet given as numbered rows of cells: its header is the first row that has all wanted names, in any case and
    place; rows behind it with a first wanted cell are data."""
    norm = F.transform(row, lambda c: F.lower(F.trim(c)))
    names = [n.lower() for n in wanted.values()]
    has_all = reduce(lambda a, b: a & b, [F.array_contains(norm, n) for n in names])
    head = cells.where(has_all).agg(F.min_by(norm, nr).alias("h"), F.min(nr).alias("h_nr"))
    j = cells.join(F.broadcast(head), F.col(nr) > F.col("h_nr"))  # the header is one row
    at = lambda n: F.get(F.col(row), (F.array_position("h", n) - 1).cast("int"))
    out = [F.nullif(F.trim(at(n)), F.lit("")).alias(new) for new, n in zip(wanted, names)]
    return j.select(*out).where(F.col(next(iter(wanted))).isNotNull())


def union_or_errors(frames: dict[str, DataFrame | Exception], tag: str) -> tuple[DataFrame | None, str]:
    """The frames that could be had, tagged and united by name, and what went wrong with the others, joined by '; '."""
    good = [f.withColumn(tag, F.lit(k)) for k, f in frames.items() if isinstance(f, DataFrame)]
    errors = "; ".join(f"{k}: {f}" for k, f in frames.items() if isinstance(f, Exception))
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good) if good else None), errors


def registry_findings(df: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """(key, finding): entries of a registry without a required value, with a value that isn't allowed, or under a key that occurs twice."""
    missing = [F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"{c} missing")) for c in required]
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(vs), F.lit(f"{c} unknown")) for c, vs in allowed.items()]
    one = df.select(key, F.explode(F.filter(F.array(*missing, *wrong), lambda x: x.isNotNull())).alias("finding"))
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("key repeated").alias("finding"))
    return one.unionByName(twice)
