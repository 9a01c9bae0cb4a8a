"""Tables and data embedded in HTML held in a column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class _Tables(HTMLParser):
    """Cells of all tables; a colspan repeats its cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[list[str], bool]]] = []
        self.row: list[str] | None = None
        self.head = True
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end_row()
            self.row, self.head = [], True
        elif tag in ("td", "th") and self.row is not None:
            self._end_cell()
            self.cell = []
            raw = dict(attrs).get("colspan") or "1"
            self.span = min(int(raw), 1000) if raw.isdigit() and int(raw) else 1
            self.head &= tag == "th"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row += [" ".join("".join(self.cell).split())] * self.span
        self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.row and self.tables and any(self.row):
            self.tables[-1].append((self.row, self.head))
        self.row = None


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"Column_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


@udtf(returnType="table_no int, row_no int, header array<string>, cells array<string>", useArrow=True)
class HtmlTables:
    """One row per body row of every table of a document; cells are padded or cut to the header."""

    def eval(self, html: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
        p = _Tables()
        p.feed(html or "")
        p._end_row()
        for t, rows in enumerate(p.tables):
            if not rows:
                continue
            has_head = rows[0][1]
            body = rows[1:] if has_head else rows
            width = len(rows[0][0]) if has_head else max(len(r) for r, _ in rows)
            header = unique_names(rows[0][0] if has_head else [""] * width)
            for i, (r, _) in enumerate(body):
                yield t, i, header, (r + [""] * width)[:width]


def html_tables(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, table_no, row_no, header, cells) of a column of HTML."""
    spark = df.sparkSession
    spark.udtf.register("fathom_html_tables", HtmlTables)
    names = ", ".join(f"`{k}`" for k in keys)
    return spark.sql(f"select {names}, t.* from {{d}}, lateral fathom_html_tables(`{html}`) t", d=df.select(*keys, html))


def best_tables(tables: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """Per document its best table: size, a date column and financial headers count; ties go to the first."""
    h = F.lower(F.array_join("header", " "))
    ohlc = sum((F.contains(h, F.lit(w)).cast("int") for w in ("open", "high", "low", "close")), F.lit(0))
    t = tables.groupBy(*keys, "table_no").agg(F.count("*").alias("n_rows"), F.first("header").alias("header"))
    score = (
        F.least(F.col("n_rows") / 100, F.lit(1.0)) + F.least(F.size("header") / 10, F.lit(0.5)) + F.when(h.rlike("date|time"), 0.5).otherwise(0.0)
        + F.when(h.rlike("price|volume|market|close|open|change"), 0.5).otherwise(0.0) + F.when(ohlc >= 3, 1.0).otherwise(0.0)
    )
    s = t.where(F.col("n_rows") >= min_rows).withColumn("score", F.round(score, 6))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "table_no")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def embedded_json(html: Column, name: str) -> Column:
    """The object or array assigned to a script variable, as JSON text."""
    return F.nullif(F.regexp_extract(html, rf"(?s)(?:var|let|const|window\.)\s*{name}\s*=\s*([\[{{].*?[\]}}])\s*;", 1), F.lit(""))


def script_json(html: Column) -> Column:
    """Contents of all script elements of type application/json."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>'), F.lit(1))


def data_attribute(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?is)\bdata-{name}="([^"]*)"', 1), F.lit(""))


def by_pattern(html: Column, pattern: str) -> Column:
    """Group 1 of a pattern across lines and in any case."""
    return F.nullif(F.regexp_extract(html, "(?is)" + pattern, 1), F.lit(""))


def first_of(html: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches finds."""
    return F.coalesce(*[by_pattern(html, p) for p in patterns])


def list_pages(html: Column) -> Column:
    """struct<has_next, has_previous, infinite, last_page> of a page of a list."""
    pages = F.transform(F.regexp_extract_all(html, F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.struct(
        html.rlike(r'(?i)rel="?next|>\s*next\b').alias("has_next"), html.rlike(r'(?i)rel="?prev|>\s*prev').alias("has_previous"),
        html.rlike(r"(?i)infinite|load-more").alias("infinite"), F.array_max(pages).alias("last_page"),
    )


def any_embedded_json(html: Column, names: list[str]) -> Column:
    """What the first of the script variables holds that is assigned an object or array, else the first JSON script element."""
    return F.coalesce(*[embedded_json(html, n) for n in names], F.nullif(F.trim(F.get(script_json(html), F.lit(0))), F.lit("")))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Picker(HTMLParser):
    """Texts of the elements that a selector of tags, classes, ids and attributes, with blanks for descent, picks."""

    def __init__(self, selector: str) -> None:
        super().__init__(convert_charrefs=True)
        self.steps = [re.findall(r"([.#]?)([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", part) for part in selector.split()]
        self.open: list[tuple[str, dict[str, str]]] = []
        self.inside: list[tuple[int, list[str]]] = []
        self.found: list[str] = []

    def _fits(self, step: list[tuple[str, str, str, str]], tag: str, attrs: dict[str, str]) -> bool:
        for sign, name, attr, value in step:
            if attr:
                if attr not in attrs or (value and attrs[attr] != value):
                    return False
            elif not (name in attrs.get("class", "").split() if sign == "." else attrs.get("id") == name if sign == "#" else tag == name.lower()):
                return False
        return True

    def _picked(self) -> bool:
        steps = list(self.steps)
        if not steps or not self._fits(steps.pop(), *self.open[-1]):
            return False
        for tag, attrs in reversed(self.open[:-1]):
            if steps and self._fits(steps[-1], tag, attrs):
                steps.pop()
        return not steps

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open.append((tag, {k: v or "" for k, v in attrs}))
        if self._picked():
            self.inside.append((len(self.open), []))
            self.found.append("")
        if tag in VOID:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for _, texts in self.inside:
            texts.append(data)

    def handle_endtag(self, tag: str) -> None:
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is None:
            return
        while self.inside and self.inside[-1][0] > at:
            _, texts = self.inside.pop()
            self.found[len(self.found) - self.found[::-1].index("") - 1] = " ".join("".join(texts).split()) or " "
        del self.open[at:]


def selected(html: str | None, selector: str) -> list[str]:
    """Texts of the picked elements in the order in which they begin; elements without text or end are left out."""
    p = _Picker(selector)
    p.feed(html or "")
    p.close()
    return [t for t in p.found if t.strip()]


def css_texts(html: Column, selector: str) -> Column:
    """``selected`` as a column: an Arrow-batched function, as the JVM has no parser of pages."""

    @F.pandas_udf("array<string>")
    def pick(pages):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([selected(x, selector) for x in pages], dtype=object)

    return pick(html)
