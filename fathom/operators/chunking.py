"""Units of documents to chunks: token windows, packed paragraphs, sections and positions. One expression per text, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import once


def window_starts(n: Column, most: int, overlap: int) -> Column:
    """Starts of windows of ``most`` tokens that overlap by ``overlap``; the last is the first that reaches the end."""
    return F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)).cast("int"), F.lit(most - overlap))


def token_windows(df: DataFrame, key: str, text: str, most: int = 100, overlap: int = 10) -> DataFrame:
    """(key, chunk_index, n_chunks, chunk, token_count, position) over white-space tokens; blank texts have no chunks."""
    toks = F.filter(F.split(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")), " "), lambda x: x != "")
    t = df.select(F.col(key), toks.alias("_t")).where(F.size("_t") > 0)
    w = t.select(key, "_t", F.posexplode(window_starts(F.size("_t"), most, overlap)).alias("chunk_index", "_s"), F.size(window_starts(F.size("_t"), most, overlap)).alias("n_chunks"))
    part = F.slice("_t", F.col("_s") + 1, F.lit(most))
    return w.select(key, "chunk_index", "n_chunks", F.array_join(part, " ").alias("chunk"), F.size(part).alias("token_count"), position(F.col("chunk_index"), F.col("n_chunks")).alias("position"))


def position(index: Column, n: Column) -> Column:
    return F.when(n == 1, "only").when(index == 0, "beginning").when(index == n - 1, "end").otherwise("middle")


def pack_paragraphs(df: DataFrame, key: str, text: str, most: int = 250, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, chunk, token_count): paragraphs packed greedily up to ``most`` estimated tokens; a longer paragraph ends the chunk
    before it and is cut into windows of ``most`` estimated tokens that share ``overlap``, half of them at most. A fold over the paragraphs of one text, inside the JVM."""
    paras = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n[ \t\r]*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    size = lambda s: F.floor(F.length(s) / 4)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        long, fits = size(p) > most, (cur == "") | (size(cur) + size(p) <= most)
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        flushed = F.when(cur == "", acc["done"]).otherwise(F.array_append(acc["done"], cur))
        windows = F.transform(window_starts(F.length(p), 4 * most, 4 * min(overlap, most // 2)), lambda i: F.trim(F.substring(p, i + 1, F.lit(4 * most))))
        done = F.when(long, F.concat(flushed, windows)).when(fits, acc["done"]).otherwise(flushed)
        return F.struct(done.alias("done"), F.when(long, F.lit("")).when(fits, joined).otherwise(p).alias("cur"))

    chunks = F.aggregate(paras, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))
    return df.select(key, F.posexplode(chunks).alias("chunk_index", "chunk")).withColumn("token_count", F.floor(F.length("chunk") / 4).cast("int"))


def unit_chunks(df: DataFrame, keys: list[str], text: str, most: int = 1000, overlap: int = 50) -> DataFrame:
    """(keys, chunk_index, n_chunks, chunk, token_count, position): a unit (page, slide, section) of up to ``most`` white-space tokens as it is, a
    larger one in windows; blank units have no chunk."""
    units = df.select(*keys, F.trim(F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("_u")).where("_u <> ''")
    toks = F.filter(F.split(F.regexp_replace("_u", r"[\s\p{Z}]+", " "), " "), lambda x: x != "")

    def parts(w: Column) -> Column:
        windows = F.transform(window_starts(F.size(w), most, overlap), lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(most)), " ").alias("chunk"), F.least(F.size(w) - i, F.lit(most)).alias("token_count")))
        return F.when(F.size(w) <= most, F.array(F.struct(F.col("_u").alias("chunk"), F.size(w).alias("token_count")))).otherwise(windows)

    out = units.select(*keys, once(toks, parts).alias("_p")).select(*keys, F.size("_p").alias("n_chunks"), F.posexplode("_p").alias("chunk_index", "_c"))
    return out.select(*keys, "chunk_index", "n_chunks", "_c.chunk", "_c.token_count", position(F.col("chunk_index"), F.col("n_chunks")).alias("position"))


def routed_chunks(df: DataFrame, keys: list[str], kind: str, text: str, most: int = 1000, overlap: int = 50) -> DataFrame:
    """``unit_chunks`` of every row with the way it is cut by: slides, pages and sections by file type; rows of another type have no chunks."""
    way = F.when(F.lower(kind).isin("pptx", "ppt"), "slides").when(F.lower(kind) == "pdf", "pages").when(F.lower(kind).isin("docx", "doc"), "sections")
    typed = df.withColumn("chunked_as", way).where("chunked_as is not null")
    return unit_chunks(typed, [*keys, "chunked_as"], text, most, overlap)


def recursive_pieces(text: str, most: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """A text cut at the first of the separators that occurs, the parts that are still too long at the next ones, and neighbouring parts merged
    again up to ``most`` characters, with up to ``overlap`` characters of whole parts repeated from the piece before."""

    def parts(t: str, seps: tuple[str, ...]) -> list[str]:
        if len(t) <= most:
            return [t]
        sep = next((s for s in seps if s and s in t), "")
        if not sep:
            return [t[i : i + most] for i in range(0, len(t), most)]
        rest = seps[seps.index(sep) + 1 :]
        cut = t.split(sep)
        whole = [x + (sep if i < len(cut) - 1 else "") for i, x in enumerate(cut)]
        return [y for x in whole if x for y in ([x] if len(x) <= most else parts(x, rest))]

    out: list[str] = []
    now: list[str] = []
    for p in parts(text, separators):
        if now and sum(map(len, now)) + len(p) > most:
            out.append("".join(now))
            while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > most):
                now.pop(0)
        now.append(p)
    out += ["".join(now)] if now else []
    return [x for x in (o.strip() for o in out) if x]


def recursive_chunks(df: DataFrame, key: str, text: str, most: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, chunk) of ``recursive_pieces``; texts within the limit stay in the JVM, null and blank ones have no chunk."""
    whole = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))

    @F.pandas_udf("array<string>")
    def cut(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([recursive_pieces(t, most, overlap) for t in texts], dtype=object)

    t = df.select(key, whole.alias("_t")).where("_t <> ''")
    small = t.where(F.length("_t") <= most).select(key, F.lit(0).alias("chunk_index"), F.col("_t").alias("chunk"))
    return small.unionByName(t.where(F.length("_t") > most).select(key, F.posexplode(cut("_t")).alias("chunk_index", "chunk")))


def section_text(level: Column, title: Column, kinds: Column, levels: Column, texts: Column) -> Column:
    """A section as text: its heading with a sign for each level, list items indented by theirs, quotes marked, blocks apart."""
    block = F.struct(kinds.alias("kinds"), levels.alias("levels"), texts.alias("texts"))
    at = F.sequence(F.lit(0), F.size(texts) - 1)

    def one(i: Column) -> Column:
        kind, lv, t = F.get(block["kinds"], i), F.coalesce(F.get(block["levels"], i), F.lit(0)), F.get(block["texts"], i)
        return F.when(kind == "list", F.concat(F.repeat(F.lit("  "), lv), F.lit("• "), t)).when(kind == "quote", F.concat(F.lit("> "), t)).otherwise(t)

    body = F.when(F.size(texts) > 0, F.transform(at, one)).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.repeat(F.lit("#"), F.greatest(F.coalesce(level, F.lit(1)), F.lit(1))), F.lit(" "), title)
    return F.array_join(F.filter(F.concat(F.array(head), body), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), "\n\n")


def section_of(sizes: Column, headings: Column, texts: Column) -> Column:
    """The first block of a page that is marked as a heading or set in more than 14 points, and has less than 100 characters but some; else null."""
    at = F.filter(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: (F.coalesce(F.get(headings, i), F.lit(False)) | (F.coalesce(F.get(sizes, i), F.lit(0.0)) > 14)) & F.length(F.trim(F.get(texts, i))).between(1, 99))
    return F.when(F.size(texts) > 0, F.trim(F.get(texts, F.get(at, F.lit(0)))))


def full_text(title: Column, body: Column, notes: Column, tables: Column) -> Column:
    """Title, body, notes and numbered tables of a slide, apart by blank lines; blank parts are left out."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    numbered = F.transform(F.coalesce(tables, F.array().cast("array<string>")), lambda t, i: F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(": "), t))
    parts = F.concat(F.array(filled(title), filled(body), F.concat(F.lit("Notes: "), filled(notes))), numbered)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def document_id(path: Column, modified: Column) -> Column:
    """A short name that changes with a file's path or time of change."""
    return F.left(F.sha2(F.concat_ws(":", path, modified.cast("string")), 256), F.lit(16))


def carry_forward(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last non-empty value so far within each group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.nullif(F.trim(value), F.lit("")), ignorenulls=True).over(w))


def heading_path(levels: Column, titles: Column) -> Column:
    """The open headings after a sequence of (level, title): a heading closes all of its level or deeper."""
    pairs = F.arrays_zip(levels.alias("level"), titles.alias("title"))
    return F.aggregate(
        pairs, F.array().cast("array<struct<level:int,title:string>>"),
        lambda s, h: F.array_append(F.filter(s, lambda x: x["level"] < h["level"]), F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title"))),
    )["title"]


def slide_text(title: Column, levels: Column, body: Column, notes: Column) -> Column:
    """A slide as text: its title as heading, bullets by level, speaker notes in brackets."""
    bullets = F.zip_with(levels, body, lambda lv, b: F.when(lv > 0, F.concat(F.repeat(F.lit("  "), lv), F.lit("• "), b)).otherwise(b))
    parts = F.concat(F.array(F.concat(F.lit("# "), title)), bullets, F.array(F.concat(F.lit("[Speaker Notes: "), notes, F.lit("]"))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")


def table_text(rows: Column) -> Column:
    """array<array<string>> as a marked table."""
    return F.concat(F.lit("[Table]\n"), F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n"), F.lit("\n[/Table]"))


def chunk_id(document: Column, index: Column) -> Column:
    """A name that is the same on every run."""
    return F.sha2(F.concat_ws(":", document, index.cast("string")), 256)
