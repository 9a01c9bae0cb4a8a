"""Schemas that drift between files: similarity flooding between consecutive files, then one consistent table.

Every JSON record is read as a variant; its fields (top-level names and the members of the ``nested`` objects) are counted by type per
file: a few rows per file however many records the file or its stream has, so no stream is ever gathered. Only where fields of a level both go and
come, their contents are sketched: the least hash of the values, and of the shapes of the values, in each of 1,024 bins. The sketches
sample the distinct values evenly however many there are, so likeness and distinct counts don't drift with the size of a file; of a set of a
handful of values and one of many thousands nothing can be compared, and they count as unlike.

Each file is compared with the one before it in its stream by similarity flooding. The nodes are pairs of a level (root or nested object), of
types, and of fields of a level: those of the same path, and each that goes with each that comes. A pair of fields starts from the likeness of
its names and of telling contents, a pair of equal paths, levels or types from 1. Scores flow from pairs of levels and types to the pairs of fields
that they hold, the less the more pairs compete, and back, and from the shared content; each round mixes what flows in with the start, until nothing
changes. So types that changed together in other fields, or a level that otherwise stayed as it is, count for a pair. Pairs that go and come
with a score of ``accept`` or more, the best first, each field once, are the renames; the rest was added or removed.

Defined results: unreadable payloads and payloads that are no objects have no fields; rows without stream or file number are
ignored; a file without readable records has no fields (all of its predecessor's are removed); a field that is null throughout
belongs to the file but has no type, and takes part in no type change; where a file holds a field in several types the most
frequent counts (ties: by name); repeated records count once more and change nothing. An empty table gives no changes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import cut_lineage

BUCKETS = 1024
CHANGES = "stream_id string, file_no int, change string, old_path string, new_path string, score double, old_type string, new_type string"


def _kind(v: str) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", F.lit(None).cast("string"))
        .otherwise("number")
    )


def record_fields(df: DataFrame, key: str, stream: str, file_no: str, payload: str, nested: tuple[str, ...] = ("observed", "expected")) -> DataFrame:
    """One row per record and field: (record, stream_id, file_no, path, kind, value). ``kind`` is null for JSON null."""
    base = df.select(
        F.col(key).alias("record"), F.col(stream).alias("stream_id"), F.col(file_no).cast("int").alias("file_no"), F.try_parse_json(F.col(payload)).alias("v")
    ).where("stream_id is not null and file_no is not null and v is not null")
    spark = df.sparkSession
    top = spark.sql("select record, stream_id, file_no, e.key as path, e.value as fv from {base}, lateral variant_explode(v) as e where e.key is not null", base=base)
    # A nested object stands for itself and once more for its members.
    inner = F.when(F.col("path").isin(*nested) & F.schema_of_variant("fv").startswith("OBJECT"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = spark.sql(
        """select record, stream_id, file_no, if(inside, concat(path, '.', e.key), path) as path, if(inside, e.value, fv) as fv
        from {top}, lateral variant_explode_outer(if(inside, fv, null)) as e where not inside or e.key is not null""",
        top=top.withColumn("inside", F.explode(inner)),
    ).withColumn("kind", _kind("fv"))
    text = F.when(F.col("kind") == "string", F.try_variant_get("fv", "$", "string")).when(F.col("kind").isNotNull(), F.to_json("fv"))
    return both.select("record", "stream_id", "file_no", "path", "kind", text.alias("value"))


def file_schemas(fields: DataFrame) -> DataFrame:
    """(stream_id, file_no, path, kind, n): the fields of each file with their most frequent type and number of values."""
    kinds = ("string", "number", "boolean", "object", "array")
    counts = fields.groupBy("stream_id", "file_no", "path").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    best = F.greatest(*[f"n_{k}" for k in kinds])
    kind = F.coalesce(*[F.when((F.col(f"n_{k}") == best) & (best > 0), k) for k in sorted(kinds)])
    filled = sum((F.col(f"n_{k}") for k in kinds), F.lit(0)).alias("n")
    return counts.select("stream_id", "file_no", "path", kind.alias("kind"), filled)


def content_sketches(fields: DataFrame) -> DataFrame:
    """(stream_id, file_no, path, vals, shapes): bounded however large the file."""
    quoted = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)+)"'), F.lit(1))
    parts = F.when(F.col("kind").isin("array", "object") & (F.size(quoted) > 0), quoted).otherwise(F.array("value"))

    def shape(x: Column) -> Column:
        """Words to a, numbers to 9, mixtures to m; any run of words is two words, four and more parts are prose."""
        x = F.regexp_replace(x, r"(?=[\p{L}\d]*\p{L})(?=[\p{L}\d]*\d)[\p{L}\d]+", "\u0001")
        x = F.regexp_replace(F.regexp_replace(x, r"\p{L}+", "a"), r"\d+", "9")
        prose = F.concat(F.lit("text"), F.regexp_extract(x, r"(\p{P}*)$", 1))
        return F.when(F.size(F.split(x, " ")) >= 4, prose).otherwise(F.translate(F.regexp_replace(x, r"a(?:[\s,;:'’-]+a)+", "a a"), "\u0001", "m"))

    hashed = lambda x: F.shiftrightunsigned(F.xxhash64(x), 1)
    each = fields.where("kind is not null").select("stream_id", "file_no", "path", F.explode(parts).alias("part")).where("part is not null")
    both = each.select("stream_id", "file_no", "path", F.posexplode(F.array(hashed(F.col("part")), hashed(shape(F.col("part"))))).alias("which", "h"))
    least = both.groupBy("stream_id", "file_no", "path", "which", (F.col("h") % BUCKETS).alias("bin")).agg(F.min("h").alias("h"))
    return least.groupBy("stream_id", "file_no", "path").agg(
        F.array_sort(F.collect_list(F.when(F.col("which") == 0, F.col("h")))).alias("vals"), F.array_sort(F.collect_list(F.when(F.col("which") == 1, F.col("h")))).alias("shapes")
    )


def _name_likeness(a: str, b: str) -> float:
    a, b = a.rsplit(".", 1)[-1].lower(), b.rsplit(".", 1)[-1].lower()
    ta, tb = set(a.split("_")), set(b.split("_"))
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    ga, gb = grams(a), grams(b)
    dice = 2 * len(ga & gb) / (len(ga) + len(gb))
    stem = lambda ts: {t[:5].rstrip("s") for t in ts}
    shared = len(stem(ta) & stem(tb)) / min(len(ta), len(tb))
    return max(dice, 0.8 * shared)


def _overlap(a: set[int], b: set[int]) -> float:
    """Share of the smaller set that is in the other one: of the bins whose least hash over both sets is one of the smaller set's."""
    small, large = sorted((a, b), key=_distinct)
    other = {h % BUCKETS: h for h in large}
    told = [h == other.get(h % BUCKETS) for h in small if h <= other.get(h % BUCKETS, h)]
    return sum(told) / len(told) if told else 0.0


def _distinct(a: set[int]) -> int:
    """Number of distinct values behind a sketch: most likely rate at which the bins' least hashes come."""
    top = 2**63 // BUCKETS
    return round(BUCKETS * len(a) / (BUCKETS - len(a) + sum(h // BUCKETS / top for h in a))) if a else 0


def flood(start: np.ndarray, edges: list[tuple[int, int, float]], own: float = 0.5, rounds: int = 100, least: float = 1e-6) -> np.ndarray:
    """Fixed point of similarity flooding over pairs: every score is a share ``own`` of its start and for the rest what flows in over
    the edges (to, from, weight). The weights into a pair add up to 1 at most, so it converges and scores stay between 0 and 1."""
    if not edges:
        return start
    to, source, weight = (np.array(x) for x in zip(*edges))
    s = start
    for _ in range(rounds):
        new = own * start + (1 - own) * np.bincount(to, weight * s[source], minlength=len(s))
        if np.abs(new - s).max() < least:
            return new
        s = new
    return s


def _level(path: str) -> str:
    return path.rpartition(".")[0]


def _start(x: dict, y: dict) -> float:
    """Likeness of the names, or of contents that can't agree by chance as two booleans or two single values do."""
    telling = x["kind"] and x["kind"] == y["kind"] and x["kind"] != "boolean" and min(len(x["vals"]), len(y["vals"])) >= 2
    return max(_name_likeness(x["path"], y["path"]), _overlap(x["vals"], y["vals"]) if telling else 0.0)


def _content(x: dict, y: dict) -> float:
    """What two fields of a type have in common: values that recur have to do so under either name, of others the shapes have to agree."""
    if not x["kind"] or x["kind"] != y["kind"]:
        return 0.0
    recurs = all(f["n"] >= 8 and _distinct(f["vals"]) <= 0.5 * f["n"] for f in (x, y))
    values = _overlap(x["vals"], y["vals"])
    return values if recurs else max(values, _overlap(x["shapes"], y["shapes"]))


def correspondences(old: list[dict], new: list[dict], accept: float = 0.42) -> list[tuple[int, int, float]]:
    """Renames between two schemas, as (old index, new index, score)."""
    at_old, at_new = {f["path"]: i for i, f in enumerate(old)}, {f["path"]: j for j, f in enumerate(new)}
    gone = [i for p, i in at_old.items() if p not in at_new]
    come = [j for p, j in at_new.items() if p not in at_old]
    open_pairs = [(i, j) for i in gone for j in come if _level(old[i]["path"]) == _level(new[j]["path"])]
    if not open_pairs:
        return []
    fields = [(i, at_new[p]) for p, i in at_old.items() if p in at_new] + open_pairs
    levels = sorted({_level(f["path"]) for f in (*old, *new)})
    kinds = ["string", "number", "boolean", "object", "array"]
    # Nodes: what is certain, the levels, the pairs of types, the pairs of fields.
    first_kind, first_field = 1 + len(levels), 1 + len(levels) + len(kinds) ** 2
    start = np.zeros(first_field + len(fields))
    start[:first_kind] = 1.0
    start[first_kind:first_field] = np.eye(len(kinds)).ravel()
    edges: list[tuple[int, int, float]] = [(0, 0, 1.0)]
    size, types_old, types_new = Counter(), Counter(), Counter()
    for f in old:
        size[_level(f["path"])] += 1
    for i, j in fields[: len(fields) - len(open_pairs)]:
        types_old[old[i]["kind"]] += 1
        types_new[new[j]["kind"]] += 1
    go, come_to = Counter(_level(old[i]["path"]) for i in gone), Counter(_level(new[j]["path"]) for j in come)
    go_kind, come_kind = Counter((_level(old[i]["path"]), old[i]["kind"]) for i in gone), Counter((_level(new[j]["path"]), new[j]["kind"]) for j in come)
    # Nothing speaks against a type that no other field has.
    edges += [(first_kind + t * (len(kinds) + 1), 0, 1.0) for t, kind in enumerate(kinds) if not types_old[kind] + types_new[kind]]
    for k, (i, j) in enumerate(fields, first_field):
        x, y = old[i], new[j]
        level, same = _level(x["path"]), x["path"] == y["path"]
        at_level = 1 + levels.index(level)
        start[k] = 1.0 if same else _start(x, y)
        # Of what flows from a pair of levels or types, competing pairs get their part only.
        edges.append((k, at_level, (1.0 if same else 2 / (go[level] + come_to[level])) / 3))
        edges.append((at_level, k, 1 / size[level] / (1 if same else max(go[level], come_to[level]))))
        if x["kind"] and y["kind"]:
            at_kind = first_kind + kinds.index(x["kind"]) * len(kinds) + kinds.index(y["kind"])
            edges.append((k, at_kind, (1.0 if same else 2 / (go_kind[level, x["kind"]] + come_kind[level, y["kind"]])) / 3))
            if same:
                edges.append((at_kind, k, 1 / max(types_old[x["kind"]], types_new[y["kind"]])))
        edges.append((k, 0, (1.0 if same else _content(x, y)) / 3))
    s = flood(start, edges)
    scores = {pair: float(s[k]) for k, pair in enumerate(fields, first_field) if k >= len(start) - len(open_pairs)}
    out: list[tuple[int, int, float]] = []
    used: set[tuple[str, int]] = set()
    for (i, j), score in sorted(scores.items(), key=lambda t: (-t[1], old[t[0][0]]["path"], new[t[0][1]]["path"])):
        if score >= accept and ("old", i) not in used and ("new", j) not in used:
            used |= {("old", i), ("new", j)}
            out.append((i, j, score))
    return out


def schema_changes(
    df: DataFrame, key: str, stream: str, file_no: str, payload: str, nested: tuple[str, ...] = ("observed", "expected"), accept: float = 0.42, most_sent: int = 100_000
) -> DataFrame:
    """One row per change between consecutive files of a stream. The list of the files whose contents are asked for is broadcast while it has at
    most ``most_sent`` rows, and joined by a shuffle beyond."""
    order = Window.partitionBy("stream_id").orderBy("file_no")
    pairs = df.select(F.col(stream).alias("stream_id"), F.col(file_no).cast("int").alias("file_no")).where("stream_id is not null and file_no is not null").distinct()
    pairs = pairs.withColumn("next", F.lead("file_no").over(order)).withColumn("before", F.lag("file_no").over(order))
    # A few rows per file: the schemas, without contents.
    prof = cut_lineage(file_schemas(record_fields(df, key, stream, file_no, payload, nested)).join(pairs, ["stream_id", "file_no"], "right").groupBy("stream_id", "file_no", "next", "before").agg(
        F.array_sort(F.filter(F.collect_list(F.struct("path", "kind", "n")), lambda f: f["path"].isNotNull())).alias("fields")
    ))
    new = prof.where("before is not null").select("stream_id", "file_no", "before", F.col("fields").alias("new"))
    old = prof.where("next is not null").select("stream_id", F.col("next").alias("file_no"), F.col("fields").alias("old"))
    told = lambda c: F.transform(c, lambda f: F.concat_ws("=", f["path"], f["kind"]))
    sides = new.join(old, ["stream_id", "file_no"]).where(~(told("old") == told("new")))  # most files change nothing
    # Contents are read where on some level one field goes and another comes.
    paths, level = lambda c: F.col(f"{c}.path"), lambda p: F.regexp_replace(p, r"\.?[^.]*$", "")
    gone, come = F.array_except(paths("old"), paths("new")), F.array_except(paths("new"), paths("old"))
    both = F.array_intersect(F.transform(gone, level), F.transform(come, level))
    on = lambda c: F.filter(c, lambda p: F.array_contains(both, level(p)))
    sides = cut_lineage(sides.withColumns({"gone": on(gone), "come": on(come)}))
    open_sides = sides.where(F.size("gone") > 0)
    side = lambda no, is_new, c: open_sides.select("stream_id", F.col(no).alias("file_no"), F.col("file_no").alias("at"), F.lit(is_new).alias("is_new"), F.explode(c).alias("path"))
    asked = cut_lineage(side("before", False, "gone").union(side("file_no", True, "come")))
    send = (lambda x: F.broadcast(x)) if asked.limit(most_sent + 1).count() <= most_sent else lambda x: x
    asked_files = asked.select(F.col("stream_id").alias("a_stream"), F.col("file_no").alias("a_no")).distinct()
    of_files = df.join(send(asked_files), (F.col(stream) == F.col("a_stream")) & (F.col(file_no).cast("int") == F.col("a_no")), "left_semi")
    wanted = record_fields(of_files, key, stream, file_no, payload, nested).join(send(asked.select("stream_id", "file_no", "path").distinct()), ["stream_id", "file_no", "path"], "left_semi")
    sketches = content_sketches(wanted).join(asked, ["stream_id", "file_no", "path"]).select("stream_id", F.col("at").alias("file_no"), "is_new", F.struct("path", "vals", "shapes").alias("s"))
    by_side = sketches.groupBy("stream_id", "file_no").agg(F.collect_list(F.when(~F.col("is_new"), F.col("s"))).alias("old_s"), F.collect_list(F.when(F.col("is_new"), F.col("s"))).alias("new_s"))
    sides = sides.join(by_side, ["stream_id", "file_no"], "left")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def with_content(fields, sketches) -> list[dict]:  # noqa: ANN001
            by = {s["path"]: s for s in ([] if sketches is None else sketches)}
            none: dict = {"vals": [], "shapes": []}
            return [{**f, "vals": set(by.get(f["path"], none)["vals"]), "shapes": set(by.get(f["path"], none)["shapes"])} for f in fields]

        for b in batches:
            rows = []
            for stream, file_no, old, new, old_s, new_s in zip(b["stream_id"], b["file_no"], b["old"], b["new"], b["old_s"], b["new_s"]):
                old, new = with_content(old, old_s), with_content(new, new_s)
                renamed = correspondences(old, new, accept)
                by_old, by_new = {i for i, _, _ in renamed}, {j for _, j, _ in renamed}
                a, c = {f["path"]: f for f in old}, {f["path"]: f for f in new}
                for i, j, score in renamed:
                    rows.append((stream, file_no, "renamed", old[i]["path"], new[j]["path"], score, old[i]["kind"], new[j]["kind"]))
                rows += [(stream, file_no, "removed", f["path"], "", None, f["kind"], None) for i, f in enumerate(old) if f["path"] not in c and i not in by_old]
                rows += [(stream, file_no, "added", "", f["path"], None, None, f["kind"]) for j, f in enumerate(new) if f["path"] not in a and j not in by_new]
                rows += [(stream, file_no, "type_changed", p, p, None, f["kind"], c[p]["kind"]) for p, f in a.items() if p in c and f["kind"] and c[p]["kind"] and f["kind"] != c[p]["kind"]]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")], dtype=object)
            yield out.astype({"file_no": "int32", "score": "float64"})

    return sides.mapInPandas(compare, CHANGES)


def canonical_names(changes: DataFrame, together: DataFrame) -> dict[str, str]:
    """Current name to the name of its family of renames. Two names that some file has side by side (``together``: a, b) are different fields,
    whatever one stream calls a rename, and never come into one family. What reaches the driver are the distinct renames: schema names, not data."""
    links = changes.where("change = 'renamed'").groupBy("old_path", "new_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "old_path", "new_path").collect()
    names = sorted({r[c] for r in links for c in ("old_path", "new_path")})
    apart = {(r["a"], r["b"]) for r in together.where(F.col("a").isin(names) & F.col("b").isin(names)).distinct().collect()} if names else set()
    family = {x: [x] for x in names}
    seen: Counter[str] = Counter()
    for r in links:
        seen[r["old_path"]] += r["n"]
        a, b = family[r["old_path"]], family[r["new_path"]]
        if a is not b and not any((x, y) in apart or (y, x) in apart for x in a for y in b):
            a += b
            family.update(dict.fromkeys(b, a))
    return {x: min(xs, key=lambda p: (-seen[p], p)) for x, xs in family.items()}  # the name most often left is the first


def consistent_table(df: DataFrame, fields: DataFrame, changes: DataFrame, key: str, most_columns: int = 2_000) -> DataFrame:
    """All records in one table: a column per family of names (dots become underscores), cast to the type most common in the family;
    values that don't cast, and of two names of a family in one record the values of all but the canonical one, stay readable in ``uncast``. The
    fields beyond the ``most_columns`` most frequent stand in the map ``f_more``. Unreadable records keep their row with null fields."""
    per_file = fields.select("stream_id", "file_no", "path").distinct()
    together = per_file.withColumnRenamed("path", "a").join(per_file.withColumnRenamed("path", "b"), ["stream_id", "file_no"]).where("a < b").select("a", "b")
    names = canonical_names(changes, together)
    if names:
        canon = F.broadcast(df.sparkSession.createDataFrame(sorted(names.items()), "path string, canon string"))  # schema names
        named = fields.join(canon, "path", "left").withColumn("name", F.coalesce("canon", "path"))
    else:
        named = fields.withColumn("name", F.col("path"))
    kinds = named.where("kind is not null").groupBy("name", "kind").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"))
    columns = sorted((r["name"], r["kind"]) for r in kinds.orderBy(F.desc("n"), "name").limit(most_columns).collect())
    filled = named.where("value is not null")
    order = F.struct(F.when(F.col("path") == F.col("name"), 0).otherwise(1).alias("other"), "path", "value")
    one = filled.groupBy("record", "name").agg(F.array_sort(F.collect_list(order)).alias("vs"))  # as many as the family has names
    packed = one.groupBy("record").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.col("vs")[0]["value"].alias("value")))).alias("m"),
        F.flatten(F.collect_list(F.transform(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), lambda v: F.struct(v["path"].alias("field"), v["value"].alias("value"))))).alias("second"),
    )
    out = df.join(packed.withColumnRenamed("record", "r_key"), F.col(key) == F.col("r_key"), "left").drop("r_key")
    typed, failed = {}, []
    for name, kind in columns:
        raw = F.col("m")[name]
        value = raw.try_cast("double") if kind == "number" else raw.try_cast("boolean") if kind == "boolean" else raw
        typed["f_" + name.replace(".", "_")] = value
        if kind in ("number", "boolean"):
            failed.append(F.when(raw.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("field"), raw.alias("value"))))
    uncast = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<struct<field:string,value:string>>")
    none = F.array().cast("array<struct<field:string,value:string>>")
    typed["uncast"] = F.concat(uncast, F.coalesce("second", none))
    if len(columns) == most_columns:
        shown = [n for n, _ in columns]
        typed["f_more"] = F.map_filter("m", lambda k, _: ~k.isin(shown))
    return out.select(*df.columns, *[c.alias(n) for n, c in typed.items()])
