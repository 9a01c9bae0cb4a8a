"""Queries over embedded payloads, pages, layouts and assembled texts, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import chunking, citations, frames, linked, screener, search
from fathom.session import table
from fathom.sources import html, structured

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of HTML for each region with a table of its nations."""
    row = F.format_string("<tr><td>%d</td><td><b>%s</b></td></tr>", "n_nationkey", "n_name")
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("l"))
    page = F.concat(F.lit("<html><table><thead><tr><th>Key</th><th>Name</th></tr></thead>"), F.array_join("l.r", ""), F.lit("</table><a href='?page=4'>4</a></html>"))
    return n.select("n_regionkey", page.alias("html"))


@query("""select n_regionkey, n_nationkey::varchar as key, n_name as name from nation union all select distinct n_regionkey, unnest(['All', 'Short', 'Long']), unnest(['All', '', 'x']) from nation""")
def s18_html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with a cell over two columns, a row too short and a row too long."""
    odd = "<tr><td colspan='2'>All</td></tr><tr><td>Short</td></tr><tr><td>Long<td>x</td><td>y</td></tr></table>"
    pages = _pages(spark, d).withColumn("html", F.replace("html", F.lit("</table>"), F.lit(odd)))
    t = html.html_tables(pages, ["n_regionkey"], "html")
    return t.select("n_regionkey", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


@query("select n_regionkey, 0 as table_no, count(*) as n_rows, round(least(count(*) / 100, 1) + 0.2, 6) as score from nation group by 1 having count(*) >= 5")
def f11_best_tables(spark: SparkSession, d: str) -> DataFrame:
    t = html.html_tables(_pages(spark, d), ["n_regionkey"], "html")
    return html.best_tables(t, ["n_regionkey"], 5).select("n_regionkey", "table_no", "n_rows", "score")


@query("select event_id, props as found, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def s21_embedded_json(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<script>\nvar chart = "), F.col("props"), F.lit(";\nrun();</script>"))
    found = html.embedded_json(page, "chart")
    return table(spark, d, "events").select("event_id", found.alias("found")).withColumn("k", F.get_json_object("found", "$.k").try_cast("int"))


@query("select event_id, event_type as kind from events")
def s20_data_attributes(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('<div class="x" data-kind="'), F.col("event_type"), F.lit('">v</div>'))
    return table(spark, d, "events").select("event_id", html.data_attribute(page, "kind").alias("kind"))


@query("select user_id, row_number() over (partition by user_id order by event_id) - 1 as nr, event_id as id, value from events")
def s23_price_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays in one document, as price services send them."""
    l = F.array_sort(F.collect_list(F.struct("event_id", "value")))  # noqa: E741
    doc = table(spark, d, "events").groupBy("user_id").agg(l.alias("l")).select("user_id", F.to_json(F.struct(F.col("l.event_id").alias("ids"), F.col("l.value").alias("prices"))).alias("doc"))
    p = doc.select("user_id", F.from_json("doc", "ids array<bigint>, prices array<double>").alias("p"))
    return structured.rows_of_parallel(p, ["user_id"], {"id": F.col("p.ids"), "value": F.col("p.prices")})


@query("select event_type, ts::date as day, round(sum(value), 4) as result from events group by 1, 2")
def s29_nested_series(spark: SparkSession, d: str) -> DataFrame:
    """A document of named series of points, read back to rows."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("r"))
    points = daily.groupBy("event_type").agg(F.collect_list(F.struct(F.col("day").cast("string").alias("Timestamp"), F.col("r").alias("Result"))).alias("Data"))
    doc = points.select("event_type", F.to_json(F.create_map("event_type", F.struct("Data"))).alias("doc"))
    series = doc.select(F.explode(F.from_json("doc", "map<string,struct<Data:array<struct<Timestamp:string,Result:double>>>>")).alias("event_type", "s"))
    return series.select("event_type", F.inline("s.Data")).select("event_type", F.col("Timestamp").cast("date").alias("day"), F.col("Result").alias("result"))


@query("select point_id from theblock_points where value > 1e6 union all select point_id from theblock_points where value is null")
def a22_series_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "theblock_points").where("value > 1e6 or value is null").select("point_id")


@query("""select count(*) as n_rows, (select sum(n - 1)::bigint from (select count(*) as n from theblock_points group by chart_id, asset, date, value)) as n_duplicates, count(*) filter (date is null) as n_no_date, count(*) filter (value is null) as n_no_value from theblock_points""")
def a19_series_validation(spark: SparkSession, d: str) -> DataFrame:
    from fathom.operators.quality import duplicates

    t = table(spark, d, "theblock_points")
    dup = duplicates(t, ["chart_id", "asset", "date", "value"]).select("n_duplicates")
    one = t.agg(F.count("*").alias("n_rows"), F.count_if(F.col("date").isNull()).alias("n_no_date"), F.count_if(F.col("value").isNull()).alias("n_no_value"))
    return one.join(F.broadcast(dup)).select("n_rows", "n_duplicates", "n_no_date", "n_no_value")  # one row each


@query("""select result_id, lower(coalesce(content_type, '')) like '%heading%' or (length(section_title) >= 2 and ((upper(section_title) = section_title and regexp_matches(section_title, '\\p{L}')) or length(section_title) < 50)) as heading
from search_chunks where section_title is not null""")
def f17_headings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_chunks").where("section_title is not null")
    return s.select("result_id", screener.is_heading(F.coalesce("content_type", F.lit("")), F.lit(True), F.col("section_title")).alias("heading"))


@query("""with s as (select distinct section_title as t from search_chunks where section_title is not null) select result_id, text from search_chunks c join s on c.text = s.t""")
def j09_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").select("result_id", "text", "section_title")
    titles = c.where("section_title is not null").select(F.col("section_title").alias("text")).distinct()
    return c.select("result_id", "text").join(titles, "text").select("result_id", "text")


@query("""select c.result_id, c.chunk_id, h.best from search_chunks c join (select chunk_id, max(score) as best from search_chunks where chunk_id is not null group by 1) h using (chunk_id)""")
def j08_score_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("chunk_id is not null")
    best = c.groupBy("chunk_id").agg(F.max("score").alias("best"))
    return c.select("result_id", "chunk_id").join(best, "chunk_id").select("result_id", "chunk_id", "best")


@query("""select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' except all select l_orderkey, l_linenumber from lineitem where l_quantity > 25""")
def u03_difference(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").exceptAll(line.where("l_quantity > 25").select("l_orderkey", "l_linenumber"))


@query("""with l as (select document_id, filename || ' | Page ' || page_number as label, min(result_id) as first from search_chunks where document_id is not null and filename is not null and page_number is not null group by 1, 2),
n as (select *, row_number() over (partition by document_id order by first) as nr from l) select document_id, string_agg('[' || nr || '] ' || label, chr(10) order by nr) as citations from n group by 1""")
def u04_numbered_citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("document_id is not null and filename is not null and page_number is not null")
    l = c.groupBy("document_id", F.concat(F.col("filename"), F.lit(" | Page "), F.col("page_number").cast("string")).alias("label")).agg(F.min("result_id").alias("first"))  # noqa: E741
    g = l.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("l"))  # a row per page
    return g.select("document_id", citations.numbered(F.col("l.label")).alias("citations"))


@query("""with r as (select record_id, stream_id, file_no, seq, case when json_valid(payload) then payload end as p from screener_records)
select record_id, coalesce(last_value(case when json_extract_string(p, '$.block_type') = 'heading' then json_extract_string(p, '$.block_id') end ignore nulls)
over (partition by stream_id, file_no order by seq, record_id rows unbounded preceding), 'Header') as section from r""")
def w06_current_section(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "screener_records").withColumn("v", F.try_parse_json("payload"))
    head = F.when(F.try_variant_get("v", "$.block_type", "string") == "heading", F.try_variant_get("v", "$.block_id", "string"))
    w = Window.partitionBy("stream_id", "file_no").orderBy("seq", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("record_id", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("Header")).alias("section"))


@query("""select result_id, '# ' || coalesce(section_title, 'untitled') || chr(10) || '  • ' || coalesce(document_intent, 'none') || chr(10) || '[Speaker Notes: ' || coalesce(content_type, 'none') || ']' as slide from search_chunks""")
def t08_slide_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks")
    title, body, notes = F.coalesce("section_title", F.lit("untitled")), F.coalesce("document_intent", F.lit("none")), F.coalesce("content_type", F.lit("none"))
    return c.select("result_id", chunking.slide_text(title, F.array(F.lit(1)), F.array(body), notes).alias("slide"))


@query("""select n_regionkey, '[Table]' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) order by n_nationkey) || chr(10) || '[/Table]' as t from nation group by 1""")
def t10_table_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return n.select("n_regionkey", chunking.table_text(F.transform("l", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))).alias("t"))


@query("""with s as (select *, row_number() over (partition by document_id order by result_id) as r from search_chunks where document_id is not null and topic_tags is not null and len(topic_tags) > 0)
select document_id, topic_tags[1] as first_topic, keywords is not null and len(keywords) > 0 as has_keywords from s where r = 1""")
def t17_first_enriched(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("document_id is not null and size(topic_tags) > 0")
    f = linked.one_per(c, ["document_id"], [F.asc("result_id")])
    return f.select("document_id", F.col("topic_tags")[0].alias("first_topic"), F.coalesce(F.size("keywords") > 0, F.lit(False)).alias("has_keywords"))


@query("""with c as (select result_id, explode_entity.text as text, explode_entity.type as kind from (select result_id, unnest(entities) as explode_entity from search_chunks where entities is not null))
select kind, count(*) as n, count(distinct lower(text)) as n_distinct from c group by 1""")
def t16_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "search_chunks").select(F.explode("entities").alias("e")).select(F.col("e.text").alias("text"), F.col("e.type").alias("kind"))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct(F.lower("text")).alias("n_distinct"))


@query("""with qs as (select vec_id as q, embedding::double[] as v from embeddings where label = 0 order by vec_id limit 5),
s as (select q as query, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score, label from embeddings, qs),
t as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s qualify rank <= 20),
p as (select label, min(vec_id) as partner from embeddings group by 1)
select query, vec_id, score, partner, row_number() over (partition by query order by score + case when label = 0 then 0.1 else 0 end desc, vec_id) as rank from t join p using (label)""")
def v09_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The nearest twenty, ordered again with a bonus, each with its linked row."""
    e = table(spark, d, "embeddings")
    q = e.where("label = 0").orderBy("vec_id").limit(5).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return _reranked(search.vector_topk(e, "vec_id", "embedding", q, "q", "v", 20), e)


@query("""with s as (select a.vec_id as query, b.vec_id, round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6) as score, b.label from embeddings a, embeddings b where a.vec_id % 20 = 0),
t as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s qualify rank <= 20), p as (select label, min(vec_id) as partner from embeddings group by 1)
select query, vec_id, score, partner, row_number() over (partition by query order by score + case when label = 0 then 0.1 else 0 end desc, vec_id) as rank from t join p using (label)""")
def v09_reranked_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    e = table(spark, d, "embeddings")
    return _reranked(search.knn_blocks(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 20), e)


def _reranked(found: DataFrame, e: DataFrame) -> DataFrame:
    hits = found.drop("rank").join(e.select("vec_id", "label"), "vec_id")
    hits = linked.linked(hits, e, ["label"], "vec_id", "partner", [F.asc("vec_id")])
    bonus = F.col("score") + F.when(F.col("label") == 0, 0.1).otherwise(0.0)
    w = Window.partitionBy("query").orderBy(bonus.desc(), "vec_id")
    return hits.select("query", "vec_id", "score", "partner", F.row_number().over(w).alias("rank"))


@query("""select 'chunk' as kind, count(*) as n from search_chunks where text is not null union all select 'page', count(distinct (document_id, page_number)) from search_chunks where page_number is not null and document_id is not null
union all select 'slide', count(distinct (document_id, slide_number)) from search_chunks where slide_number is not null and document_id is not null""")
def v11_index_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks")
    page = c.where("page_number is not null and document_id is not null").select("document_id", F.col("page_number").alias("place")).distinct()
    slide = c.where("slide_number is not null and document_id is not null").select("document_id", F.col("slide_number").alias("place")).distinct()
    return frames.union_tagged({"chunk": c.where("text is not null").select("document_id"), "page": page, "slide": slide}, "kind").groupBy("kind").agg(F.count("*").alias("n"))


@query("""with e as (select distinct unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2)) as w, source from documents where source is not null)
select a.source as a, b.source as b, count(*) as shared from e a join e b on a.w = b.w and a.source < b.source group by 1, 2""")
def u02_shared_words(spark: SparkSession, d: str) -> DataFrame:
    """Sources by words in common: words meet by equality, and only (source, word) once each."""
    e = table(spark, d, "documents").where("source is not null").select("source", F.explode(F.filter(tx.tokens(F.coalesce("text", F.lit(""))), lambda w: F.length(w) > 2)).alias("w")).distinct()
    a, b = e.withColumnRenamed("source", "a"), e.withColumnRenamed("source", "b")
    return a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
