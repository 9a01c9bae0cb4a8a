"""JSON, CSV and XML in files and in columns: shapes to rows, paths, mappings, delimiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import column_name


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files; lines of objects if the first line is one, else whole documents. Unreadable lines are dropped."""
    first = spark.read.text(path).limit(1).collect()
    lines = bool(first) and first[0][0].strip().startswith("{") and first[0][0].strip().endswith("}")
    r = spark.read.option("mode", "DROPMALFORMED")
    if schema:
        r = r.schema(schema)
    return r.json(path) if lines else r.option("multiLine", "true").json(path)


def json_path(doc: Column, path: str, strict: bool = False) -> Column:
    """Text at a.b[0].c of a JSON text; ``strict`` fails where there is none."""
    v = F.get_json_object(doc, "$." + path)
    return F.coalesce(v, F.raise_error(F.lit(f"no value at {path}"))) if strict else v


def rows_of_objects(df: DataFrame, keys: list[str], doc: Column, element: str) -> DataFrame:
    """An array of objects, one row each. ``element`` is the DDL of an object."""
    return df.select(*keys, F.posexplode(F.from_json(doc, f"array<struct<{element}>>")).alias("nr", "o")).select(*keys, "nr", "o.*")


def rows_of_arrays(df: DataFrame, keys: list[str], doc: Column, names: list[str]) -> DataFrame:
    """An array of arrays, one row each, with the given names; missing ends are null."""
    return df.select(*keys, F.posexplode(F.from_json(doc, "array<array<string>>")).alias("nr", "a")).select(*keys, "nr", *[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(names)])


def rows_of_parallel(df: DataFrame, keys: list[str], arrays: dict[str, Column]) -> DataFrame:
    """Arrays of equal length side by side; rows whose arrays differ in length are left out."""
    cols = list(arrays.values())
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (F.size(c) == F.size(cols[0]))
    return df.where(same).select(*keys, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])).alias("nr", "z")).select(*keys, "nr", "z.*")


def rows_of_map(df: DataFrame, keys: list[str], doc: Column, value: str = "string") -> DataFrame:
    """An object of name to value, one row each."""
    return df.select(*keys, F.explode(F.from_json(doc, f"map<string,{value}>")).alias("name", "value"))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed, nested ones by dotted path; unmapped columns are kept."""
    heads = {p.split(".")[0] for p in mapping}
    return df.select(*[F.col(p).alias(n) for p, n in mapping.items()], *[c for c in df.columns if c not in heads])


def nested_arrays(schema, prefix: str = "") -> list[str]:  # noqa: ANN001
    """Paths of all arrays in a schema."""
    out = []
    for f in getattr(schema, "fields", []):
        p = f"{prefix}.{f.name}" if prefix else f.name
        if f.dataType.typeName() == "array":
            out += [p, *nested_arrays(f.dataType.elementType, p)]
        else:
            out += nested_arrays(f.dataType, p)
    return out


def flat_fields(df: DataFrame, keys: list[str], doc: Column) -> DataFrame:
    """(keys, name, value) of a JSON object: nested objects one level down as outer_inner, what is below as JSON."""
    one = df.select(*keys, F.explode(F.from_json(doc, "map<string,string>")).alias("a", "v"))
    nested = F.from_json(F.when(F.startswith(F.col("v"), F.lit("{")), F.col("v")), "map<string,string>")
    deep = one.where(nested.isNotNull()).select(*keys, "a", F.explode(nested).alias("b", "value")).select(*keys, F.concat_ws("_", "a", "b").alias("name"), "value")
    return one.where(nested.isNull()).select(*keys, F.col("a").alias("name"), F.col("v").alias("value")).unionByName(deep)


DELIMITERS = ",;\t|"


def sniff_csv(lines: list[str]) -> tuple[str, bool]:
    """(delimiter, has header) from the first lines: the most frequent delimiter, the earlier of equals; a header if the first row
    has fewer numeric cells than the second and as many cells."""
    sep = max(DELIMITERS, key=lambda c: (sum(x.count(c) for x in lines), -DELIMITERS.index(c))) if lines else ","

    def numeric(row: str) -> int:
        n = 0
        for cell in row.split(sep):
            try:
                float(cell.strip().strip('"').replace(",", ""))
                n += 1
            except ValueError:
                pass
        return n

    header = len(lines) > 1 and len(lines[0].split(sep)) == len(lines[1].split(sep)) and numeric(lines[0]) < numeric(lines[1])
    return sep, header


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with delimiter and header found from the first ten lines; malformed rows are dropped and names cleaned."""
    sep, header = sniff_csv([r[0] for r in spark.read.text(path).limit(10).collect()])
    df = spark.read.option("mode", "DROPMALFORMED").option("sep", sep).option("header", header).option("inferSchema", "true").csv(path)
    return df.toDF(*([column_name(c) for c in df.columns] if header else [f"column_{i}" for i in range(len(df.columns))]))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements of one tag as rows; attributes are prefixed with an underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").load(path)


def xml_values(doc: Column, xpath: str) -> Column:
    """Texts an XPath selects."""
    return F.xpath(doc, F.lit(xpath))


def resolve_column(columns: list[str], wanted: str) -> str | None:
    """The column a name means: exactly, else in another case, else as a part."""
    low = wanted.lower()
    for test in (lambda c: c == wanted, lambda c: c.lower() == low, lambda c: low in c.lower() or c.lower() in low):
        for c in columns:
            if test(c):
                return c
    return None
