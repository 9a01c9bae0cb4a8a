"""Queries over units of documents, payloads of unknown form, guards, files and identifiers, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import dates, numbers, web
from fathom.functions import text as tx
from fathom.operators import chunking, frames, linked, quality, rules, search
from fathom.plans import corpus
from fathom.session import scratch, table
from fathom.sources import files, html, shapes, structured

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


def _lits(*xs: object) -> Column:
    return F.array(*[F.lit(x) for x in xs])


# ---- units to chunks

UNITS = r"""with u as (select result_id, file_type, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as u from search_chunks),
t as (select result_id, file_type, u, list_filter(string_split(regexp_replace(u, '[\s\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '') as t from u where u <> ''),
s as (select *, case when len(t) <= 100 then [0] else generate_series(0, greatest(len(t) - 11, 0), 90) end as starts from t),
w as (select result_id, file_type, u, t, len(starts) as n, unnest(starts) as s, generate_subscripts(starts, 1) - 1 as i from s),
c as (select result_id, file_type, i as chunk_index, n as n_chunks, least(len(t) - s, 100) as token_count, case when len(t) <= 100 then u else array_to_string(t[s + 1:s + 100], ' ') end as chunk,
case when n = 1 then 'only' when i = 0 then 'beginning' when i = n - 1 then 'end' else 'middle' end as position from w) """


@query(UNITS + "select result_id, chunk_index, n_chunks, token_count, md5(chunk) as chunk_md5, position from c")
def t04_unit_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.unit_chunks(table(spark, d, "search_chunks"), ["result_id"], "text", 100, 10)
    return c.select("result_id", "chunk_index", "n_chunks", "token_count", F.md5("chunk").alias("chunk_md5"), "position")


@query(UNITS + """select case file_type when 'pptx' then 'slides' when 'ppt' then 'slides' when 'pdf' then 'pages' else 'sections' end as chunked_as, count(*) as n_chunks, sum(token_count)::bigint as n_tokens
from c where file_type in ('pptx', 'ppt', 'pdf', 'docx', 'doc') group by 1""")
def t18_routed_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.routed_chunks(table(spark, d, "search_chunks"), ["result_id"], "file_type", "text", 100, 10)
    return c.groupBy("chunked_as").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


@query()
def t07_recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(r"""select result_id, concat_ws(chr(10) || chr(10), case when trim(section_title) <> '' then repeat('#', greatest(len(heading_hierarchy), 1)) || ' ' || section_title end, case when trim(module_name) <> '' then module_name end,
'  • ' || keywords[1], '> ' || document_intent) as section from search_chunks where section_title is not null and heading_hierarchy is not null and len(keywords) > 0""")
def t09_section_text(spark: SparkSession, d: str) -> DataFrame:
    """A heading, a paragraph, a list item of level 1 and a quote."""
    c = table(spark, d, "search_chunks").where("section_title is not null and heading_hierarchy is not null and size(keywords) > 0")
    s = chunking.section_text(F.size("heading_hierarchy"), F.col("section_title"), _lits("paragraph", "list", "quote"), _lits(0, 1, 0), F.array("module_name", F.get("keywords", F.lit(0)), "document_intent"))
    return c.select("result_id", s.alias("section"))


@query("""select result_id, case when (coalesce(position_in_section = 'beginning', false) or coalesce(score * 20, 0) > 14) and length(trim(section_title)) between 1 and 99 then trim(section_title)
when coalesce(position_in_section = 'end', false) and length(trim(module_name)) between 1 and 99 then trim(module_name) end as section from search_chunks""")
def t11_detected_sections(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("position_in_section")
    s = chunking.section_of(F.array(F.col("score") * 20, F.lit(12.0)), F.array(at == "beginning", at == "end"), F.array("section_title", "module_name"))
    return table(spark, d, "search_chunks").select("result_id", s.alias("section"))


@query("""select result_id, concat_ws(chr(10) || chr(10), case when trim(section_title) <> '' then section_title end, case when trim(text) <> '' then text end, 'Notes: ' || case when trim(module_name) <> '' then module_name end,
nullif(array_to_string(list_transform(keywords, lambda t, i: 'Table ' || i || ': ' || t), chr(10) || chr(10)), '')) as full_text from search_chunks""")
def t19_full_text(spark: SparkSession, d: str) -> DataFrame:
    t = chunking.full_text(F.col("section_title"), F.col("text"), F.col("module_name"), F.col("keywords"))
    return table(spark, d, "search_chunks").select("result_id", t.alias("full_text"))


@query("select result_id, left(sha256(concat_ws(':', s3_uri, char_count::varchar)), 16) as document_id from search_chunks")
def t02_document_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").select("result_id", chunking.document_id(F.col("s3_uri"), F.col("char_count")).alias("document_id"))


DOCS = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as nr from documents where text is not null),
x as (select *, regexp_matches(line, '^#{1,6} ') as h, length(line) > 500 as long from l)"""


@query(DOCS + r"""select doc_id, nr, (sum(h::int) over w)::bigint as section_no, (1 + coalesce(sum(long::int) over (partition by doc_id order by nr rows between unbounded preceding and 1 preceding), 0))::bigint as page,
least(length(regexp_extract(line, '^( *)', 1)) // 2, 5) as list_level from x window w as (partition by doc_id order by nr)""")
def s08_line_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs: a section starts at each heading, a page ends behind each line of more than 500 characters, indents give list levels."""
    line = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    w = Window.partitionBy("doc_id").orderBy("nr")
    section = F.sum(F.col("line").rlike("^#{1,6} ").cast("int")).over(w)
    page = 1 + F.coalesce(F.sum((F.length("line") > 500).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.least(F.floor(F.length(F.regexp_extract("line", "^( *)", 1)) / 2), F.lit(5))
    return line.select("doc_id", "nr", section.alias("section_no"), page.alias("page"), level.alias("list_level"))


@query(r"""select result_id, case when regexp_matches(lower(filename), '\.(pptx|ppt)$') then 'pptx' when regexp_matches(lower(filename), '\.pdf$') then 'pdf' when regexp_matches(lower(filename), '\.(docx|doc)$') then 'docx' end as parser,
case when filename is null or not regexp_matches(lower(filename), '\.(pptx|ppt|pdf|docx|doc)$') then 'no parser for this file' end as error from search_chunks""")
def s02_parsers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.nullif(files.document_type(F.col("filename")), F.lit("unknown"))
    return table(spark, d, "search_chunks").select("result_id", kind.alias("parser"), F.when(kind.isNull(), "no parser for this file").alias("error"))


@query(r"""select result_id, coalesce(length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) / (char_count * 100.0) < 0.01 and (1 - extraction_confidence) > 0.05, false) as scanned from search_chunks""")
def s05_scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Few characters for the area, and an image over a part of it."""
    dense = F.try_divide(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")), F.col("char_count") * 100.0)
    scanned = (dense < 0.01) & ((1 - F.col("extraction_confidence")) > 0.05)
    return table(spark, d, "search_chunks").select("result_id", F.coalesce(scanned, F.lit(False)).alias("scanned"))


D12 = f"""with c as (select result_id, document_id, coalesce(slide_number, page_number) as place, coalesce(text, '') as t from search_chunks),
s as (select document_id, place, t, result_id from (select *, row_number() over (partition by document_id, place order by result_id) as r from c where place is not null) where r = 1),
j as (select c.result_id, {corpus.content_words('c.t')} as a, {corpus.content_words("coalesce(s.t, '')")} as b, s.t is null as alone from c left join s using (document_id, place)),
m as (select result_id, case when alone then 0 when len(a) = 0 and len(b) = 0 then 1 when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end as similarity from j)
select 'slide' as kind, result_id from s union all select 'page', result_id from m where similarity < 0.85"""


@query(D12)
def d12_text_to_index(spark: SparkSession, d: str) -> DataFrame:
    """The texts of slides and those of pages that no slide repeats."""
    from fathom.operators import dedup

    c = table(spark, d, "search_chunks").select("result_id", "document_id", F.coalesce("slide_number", "page_number").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    s = linked.one_per(c.where("place is not null"), ["document_id", "place"], [F.asc("result_id")])
    unique = dedup.word_duplicates(c, s, ["document_id", "place"], "text").where("not is_duplicate")
    return frames.union_tagged({"slide": s.select("result_id"), "page": unique.select("result_id")}, "kind").select("kind", "result_id")


# ---- checks of tables


@query("""select 'l_quantity' as "column", count(l_quantity) as n, count(*) filter (l_quantity < 0 or l_quantity > 40) as n_outside from lineitem union all
select 'l_discount', count(l_discount), count(*) filter (l_discount < 0 or l_discount > 40) from lineitem""")
def a12_percent_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.percent_range(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], 0, 40)


@query("""select * from (values ('text', true, null), ('Score', false, 'score'), ('week', false, 'week_number'), ('nothing_like_it', false, null)) t("column", present, candidate)""")
def a16_required_columns(spark: SparkSession, d: str) -> DataFrame:
    return quality.required_columns(table(spark, d, "search_chunks"), ["text", "Score", "week", "nothing_like_it"])


@query("""select * from (values ('r_key', 'int', null, 'missing'), ('r_name', 'bigint', 'string', 'type'), ('r_regionkey', null, 'int', 'unknown')) t("column", expected, found, finding)""")
def frame_p04_schema(spark: SparkSession, d: str) -> DataFrame:
    return quality.schema_findings(table(spark, d, "region"), {"r_key": "int", "r_name": "bigint"})


@query("select r_regionkey, r_name from region where false")
def frame_p04_empty(spark: SparkSession, d: str) -> DataFrame:
    return quality.empty_frame(spark, {"r_regionkey": "int", "r_name": "string"})


# ---- guards and answers

REPLIES = {"coding": "I explain course content; I don't write code.", "weather": "I know nothing about the weather."}
RULES = [("coding", r"write (?:\w+ )?code|debug|function"), ("weather", r"weather|forecast"), ("advice", r"invest|recommend")]
CATEGORY = """case when regexp_matches(lower(section_title), '(^|[^\\p{L}\\p{N}_])(write (?:\\w+ )?code|debug|function)($|[^\\p{L}\\p{N}_])') then 'coding' when regexp_matches(lower(section_title), '(^|[^\\p{L}\\p{N}_])(weather|forecast)($|[^\\p{L}\\p{N}_])') then 'weather'
when regexp_matches(lower(section_title), '(^|[^\\p{L}\\p{N}_])(invest|recommend)($|[^\\p{L}\\p{N}_])') then 'advice' else 'none' end"""


@query(f"""with c as (select result_id, {CATEGORY} as category from search_chunks where section_title is not null)
select result_id, category, case category when 'coding' then 'I explain course content; I don''t write code.' when 'weather' then 'I know nothing about the weather.' else 'I can''t help with that.' end as reply from c""")
def f05_replies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("section_title is not null").select("result_id", rules.first_match(F.col("section_title"), RULES).alias("category"))
    return c.select("result_id", "category", rules.reply(F.col("category"), REPLIES, "I can't help with that.").alias("reply"))


@query(f"""with g as (select result_id, section_title, {CATEGORY} as category, {corpus.content_words('section_title')} as a, {corpus.content_words('text')} as b, text, score from search_chunks where section_title is not null),
s as (select result_id, category <> 'none' as blocked, case when text is null then null when len(a) = 0 then 1 else len(list_intersect(a, b)) / len(a) end as grounded, score from g)
select result_id, round(grounded, 6) as grounding, concat_ws('; ', case when blocked then 'policy' end, case when grounded < 0.7 then 'grounding' end, case when score < 0.1 then 'relevance' end) as reasons,
not blocked and coalesce(grounded >= 0.7, true) and coalesce(score >= 0.1, true) as passed from s""")
def f06_guardrails(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("section_title is not null")
    g = c.select("result_id", "score", rules.first_match(F.col("section_title"), RULES).alias("category"), rules.grounding(F.col("section_title"), F.col("text")).alias("grounding"))
    passed, reasons = rules.guarded({"policy": F.col("category") == "none", "grounding": F.col("grounding") >= 0.7, "relevance": F.col("score") >= 0.1})
    return g.select("result_id", F.round("grounding", 6).alias("grounding"), reasons.alias("reasons"), passed.alias("passed"))


@query("""select module_name, case when max(score) >= 0.95 then 'in_scope' when max(score) >= 0.9 then 'related' else 'out_of_scope' end as verdict from search_chunks where module_name is not null group by 1""")
def f07_scope_verdict(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "search_chunks").where("module_name is not null").groupBy("module_name").agg(F.max("score").alias("best"))
    return best.select("module_name", rules.scope_verdict(F.col("best"), 0.9, 0.95).alias("verdict"))


@query(f"""with k as (select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as r from ({corpus._bm25_sql()}) qualify r <= 5)
select query, count(*) as n_sources, case when max(score) >= 5 then 'in_scope' when max(score) >= 2 then 'related' else 'out_of_scope' end as verdict, string_agg(doc_id::varchar, ', ' order by r) as sources,
md5(string_agg('--- Result ' || r || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by r)) as answer_md5 from k join documents using (doc_id) group by 1""")
def t23_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions to answers without a model: retrieve five, judge the scope, list the sources, give the context."""
    hits = search.top(corpus._bm25(spark, d), "doc_id", 5).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    block = F.concat(F.lit("--- Result "), F.col("rank").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    a = hits.groupBy("query").agg(F.count("*").alias("n_sources"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "doc_id", block.alias("block")))).alias("l"))  # five a question
    sources = F.array_join(F.transform("l.doc_id", lambda x: x.cast("string")), ", ")
    return a.select("query", "n_sources", rules.scope_verdict(F.col("best"), 2, 5).alias("verdict"), sources.alias("sources"), F.md5(F.array_join("l.block", "\n\n")).alias("answer_md5"))


# ---- search


def _best_fields_sql() -> str:
    qs = ", ".join(str(q) for q in corpus.QUESTIONS)
    return f"""with qs as (select * from (values {qs}) t(query, q)), qt as (select distinct query, unnest(string_split(q, ' ')) as term from qs),
f as (select result_id, 'content' as field, coalesce(text, '') as t from search_chunks union all select result_id, 'title', coalesce(section_title, '') from search_chunks union all select result_id, 'keywords', coalesce(array_to_string(keywords, ' '), '') from search_chunks),
w as (select result_id, field, {corpus.words("t")} as w from f), l as (select result_id, field, len(w) as dl from w where len(w) > 0), st as (select field, count(*) as n, avg(dl) as a from l group by 1),
p as (select result_id, field, term, count(*) as tf from (select result_id, field, unnest(w) as term from w) group by 1, 2, 3), d as (select field, term, count(*) as df from p group by 1, 2),
s as (select query, result_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a)))) * case field when 'content' then 2.0 else 1.5 end as s
from qt join p using (term) join d using (field, term) join l using (result_id, field) join st using (field) group by 1, 2, 3)
select query, result_id, score, row_number() over (partition by query order by score desc, result_id) as rank from (select query, result_id, round(max(s), 6) as score from s group by 1, 2) qualify rank <= 10"""


@query(_best_fields_sql())
def v02_best_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").withColumn("kw", F.array_join("keywords", " "))
    qs = spark.createDataFrame(corpus.QUESTIONS, "q int, question string")
    return search.top(search.bm25(c, "result_id", {"content": ("text", 2.0), "title": ("section_title", 1.5), "keywords": ("kw", 1.5)}, qs, "q", "question"), "result_id", 10)


@query(f"""with h as (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as r from ({corpus.VECTOR}) join embeddings using (vec_id) where label in (3, 4) qualify r <= 10),
p as (select label, min(vec_id) as partner from embeddings group by 1) select query, vec_id, score, r as rank, partner, source from h join embeddings using (vec_id) join p using (label) left join documents on doc_id = vec_id""")
def v07_text_hits_with_partners(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of two groups, with the one partner of each hit's group and the source of its document."""
    e = table(spark, d, "embeddings")
    hits = search.vector_topk(search.metadata_filter(e, {}, {"label": [3, 4]}), "vec_id", "embedding", corpus._query_vectors(spark, d), "q", "v", 10)
    hits = linked.linked(hits.join(e.select("vec_id", "label"), "vec_id"), e, ["label"], "vec_id", "partner", [F.asc("vec_id")])
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return hits.join(docs, "vec_id", "left").select("query", "vec_id", "score", "rank", "partner", "source")


@query(f"""with h as (select query, vec_id, score from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as r from ({corpus.VECTOR})) where r <= 3)
select query, vec_id, score, md5(coalesce(text, '')) as text_md5 from h left join documents on doc_id = vec_id""")
def v08_vector_hits_with_texts(spark: SparkSession, d: str) -> DataFrame:
    hits = search.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", corpus._query_vectors(spark, d), "q", "v", 3)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return hits.join(docs, "vec_id", "left").select("query", "vec_id", "score", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("select count(*) as n_entries, count(distinct label) as n_groups, count(*) filter (embedding is null) as n_without, 64 as dimension from embeddings")
def v10_index_stats(spark: SparkSession, d: str) -> DataFrame:
    """An index as a written table: made anew, read back, described."""
    path = scratch(spark, "index")
    table(spark, d, "embeddings").write.mode("errorifexists").parquet(path)
    e = spark.read.parquet(path)
    return e.agg(F.count("*").alias("n_entries"), F.countDistinct("label").alias("n_groups"), F.count_if(F.col("embedding").isNull()).alias("n_without"), F.max(F.size("embedding")).alias("dimension"))


@query()
def s46_pieces_of_hits(spark: SparkSession, d: str) -> DataFrame:
    """The pieces, cut recursively, of the best twenty documents of each question."""
    hits = search.top(corpus._bm25(spark, d), "doc_id", 20)
    texts = table(spark, d, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.join(chunking.recursive_chunks(texts, "doc_id", "text"), "doc_id").select("query", "doc_id", "rank", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def _hybrid_fields_sql() -> str:
    best = _best_fields_sql()
    own = best[best.index("qt as ") : best.index("f as (select result_id")]
    qs = ", ".join(str(q) for q in corpus.QUESTIONS)
    allowed = "case when length(a) <= 2 then 0 when length(a) <= 5 then 1 else 2 end"
    vocabulary = f"select distinct unnest({corpus.words('t')}) as b from (select coalesce(text, '') as t from search_chunks union all select coalesce(section_title, '') from search_chunks)"
    fuzzy = f"""q0 as (select distinct query, unnest(string_split(q, ' ')) as a from qs), vc as ({vocabulary}), qt as (select query, a as term from q0 union select query, b from q0, vc where abs(length(a) - length(b)) <= {allowed} and levenshtein(a, b) <= {allowed}),
"""
    scored = best.replace(own, fuzzy)
    scored = scored[: scored.rindex("select query, result_id, score, row_number()")]
    return f"""{scored.rstrip()},
k as (select query, result_id as id, score from (select query, result_id, score, row_number() over (partition by query order by score desc, result_id) as r from (select query, result_id, round(max(s), 6) as score from s group by 1, 2)) where r <= 50),
qv as (select row_number() over (order by vec_id) as query, embedding::double[] as v from (select * from embeddings where label = 0 order by vec_id limit {len(corpus.QUESTIONS)})),
ve as (select query, vec_id as id, score from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as r from (select query, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, qv)) where r <= 50),
kn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from k window w as (partition by query)),
vn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from ve window w as (partition by query)),
z as (select query, id, round(0.7 * coalesce(vn.s, 0) + 0.3 * coalesce(kn.s, 0), 6) as score from vn full join kn using (query, id))
select query, id, score, row_number() over (partition by query order by score desc, id) as rank from z qualify rank <= 10"""


@query(_hybrid_fields_sql())
def v03_hybrid_fields(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits in boosted fields, with terms that may be misspelt, fused with vector hits."""
    c = table(spark, d, "search_chunks").withColumn("kw", F.array_join("keywords", " "))
    vocabulary = c.select(F.explode(tx.tokens(F.concat_ws(" ", "text", "section_title"))).alias("term"))
    qs = search.with_fuzzy_terms(spark.createDataFrame(corpus.QUESTIONS, "q int, question string"), "q", "question", vocabulary)
    k = search.top(search.bm25(c, "result_id", {"content": ("text", 2.0), "title": ("section_title", 1.5), "keywords": ("kw", 1.5)}, qs, "q", "question"), "result_id", 50)
    e = table(spark, d, "embeddings")
    few = e.where("label = 0").orderBy("vec_id").limit(len(corpus.QUESTIONS))
    vs = few.select(F.row_number().over(Window.orderBy("vec_id")).alias("q"), F.col("embedding").alias("v"))  # a row a question
    v = search.vector_topk(e, "vec_id", "embedding", vs, "q", "v", 50).withColumnRenamed("vec_id", "id").drop("rank")
    return search.top(search.fuse(v, k.withColumnRenamed("result_id", "id").drop("rank"), "id"), "id", 10).select("query", "id", "score", "rank")


# ---- pages


@query("select result_id, section_title as title, score::varchar as shown from search_chunks where regexp_matches(section_title, '^[A-Za-z0-9 -]+$') and score is not null")
def s20_selected_texts(spark: SparkSession, d: str) -> DataFrame:
    """A card of a page for each chunk, read by selectors of ids, classes and descent."""
    c = table(spark, d, "search_chunks").where(F.col("section_title").rlike("^[A-Za-z0-9 -]+$") & F.col("score").isNotNull())
    page = F.concat(F.lit('<div class="card wide"><h2 id="t">'), F.col("section_title"), F.lit('</h2><br><p>Score <span class="v x">'), F.col("score").cast("string"), F.lit("</span></p></div><span class=v>0</span>"))
    return c.select("result_id", html.css_texts(page, "div.card #t")[0].alias("title"), html.css_texts(page, ".card span.v")[0].alias("shown"))


@query("select event_id, props as found from events")
def s21_known_names(spark: SparkSession, d: str) -> DataFrame:
    """Data under one of several names, or in a script element of its own."""
    name = F.when(F.col("event_type") == "click", "var chartData").when(F.col("event_type") == "view", "window.seriesData").otherwise("const pageState")
    script = F.concat(F.lit("<script>"), name, F.lit(" = "), F.col("props"), F.lit(";</script>"))
    other = F.concat(F.lit('<script id="x" type="application/json">'), F.col("props"), F.lit("</script>"))
    page = F.when(F.col("event_type") == "error", other).otherwise(script)
    return table(spark, d, "events").select("event_id", html.any_embedded_json(page, ["chartData", "seriesData", "pageState"]).alias("found"))


@query("select o_orderkey, o_orderstatus = 'F' as has_next, o_orderstatus = 'O' as has_previous, o_orderkey + 1 as last_page from orders where o_orderkey < 1000000000")
def s22_page_links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    link = F.when(F.col("o_orderstatus") == "F", "<a rel=next>x</a>").when(F.col("o_orderstatus") == "O", "<a>Previous</a>").otherwise("")
    page = F.concat(F.lit("<a href='?page="), F.col("o_orderkey").cast("string"), F.lit("'>1</a><a href='?q=1&page="), (F.col("o_orderkey") + 1).cast("string"), F.lit("'>2</a>"), link)
    p = o.select("o_orderkey", html.list_pages(page).alias("p"))
    return p.select("o_orderkey", "p.has_next", "p.has_previous", "p.last_page")


@query("""select s_suppkey, floor(abs(s_acctbal)) * 1e6 as open_interest, case when s_suppkey % 2 = 0 then -floor(abs(s_acctbal)) else floor(abs(s_acctbal)) end as flow from supplier""")
def s33_snapshot_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a page in one of two wordings; an interest can't be negative, a flow can."""
    v = F.floor(F.abs("s_acctbal")).cast("string")
    page = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<b>Open Interest</b>: $"), v, F.lit("M. Net flow −$"), v)).otherwise(F.concat(F.lit("OI $"), v, F.lit("M; flows: "), v, F.lit(".")))
    oi = html.first_of(page, [r"open interest(?:</b>)?:?\s*(\$?[\d.,]+[KMBT]?)", r"\bOI\s*(\$?[\d.,]+[KMBT]?)"])
    flow = html.first_of(page, [r"net flow\s*([−-]?\$?\d+)", r"flows:\s*([−-]?\$?\d+)"])
    return table(spark, d, "supplier").select("s_suppkey", tx.once(oi, lambda x: numbers.amount(x)).alias("open_interest"), tx.once(flow, lambda x: numbers.amount(x, True)).alias("flow"))


SERIES_BODY = "(regexp_matches(response_body::varchar, '\\\\d{4}-\\\\d{2}-\\\\d{2}|\\\\d{10,13}|\"(?:date|time|timestamp)\"') and regexp_matches(response_body::varchar, '\\\\[\\\\s*\\\\{[^{}]+\\\\}\\\\s*,\\\\s*\\\\{'))"


@query(f"select request_id, coalesce({SERIES_BODY}, false) as is_series from network_requests".replace("\\\\", "\\"))
def f09_series_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "network_requests").select("request_id", web.looks_like_series(F.decode("response_body", "ISO-8859-1")).alias("is_series"))


@query("""select 'net_inflow' as "column", 0::bigint as n_negative, '' as severity where false union all select 'price', count(*) filter (c_acctbal < 0), 'error' from customer union all select 'balance', count(*) filter (c_acctbal < 0), 'warning' from customer""")
def a06_sign_rules(spark: SparkSession, d: str) -> DataFrame:
    """One column under three names: a flow may be negative, a price may not, of a balance nothing is known."""
    v = F.col("c_acctbal")
    return quality.negative_findings(quality.column_stats(table(spark, d, "customer").select(v.alias("net_inflow"), v.alias("price"), v.alias("balance")), ["net_inflow", "price", "balance"]))


@query("""select panel_id, nullif(esi_eu, 0) as shown, date as shown_date from (select *, row_number() over (partition by panel_id order by date desc, obs_id desc) as r from dg_ecfin_surveys) where r = 1""")
def a34_last_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each survey, its value even if it is null; a value of 0 isn't shown."""
    last = F.max(F.struct("date", "obs_id", "esi_eu")).alias("l")
    return table(spark, d, "dg_ecfin_surveys").groupBy("panel_id").agg(last).select("panel_id", F.nullif("l.esi_eu", F.lit(0.0)).alias("shown"), F.col("l.date").alias("shown_date"))


# ---- what a text holds


@query("""select result_id, concat_ws(chr(10), '# ' || section_title, nullif(array_to_string(list_transform(keywords, lambda k, i: case when (i - 1) % 3 > 0 then repeat('  ', ((i - 1) % 3)::bigint) || '• ' || k else k end), chr(10)), ''),
'[Speaker Notes: ' || module_name || ']') as slide from search_chunks where section_title is not null and len(keywords) > 0""")
def t08_slide_levels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("section_title is not null and size(keywords) > 0")
    levels = F.transform("keywords", lambda k, i: (i % 3).cast("int"))
    return c.select("result_id", chunking.slide_text(F.col("section_title"), levels, F.col("keywords"), F.col("module_name")).alias("slide"))


@query(f"""with w as (select doc_id, {corpus.words("coalesce(text, '')")} as w from documents), i as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from w, (select unnest([1, 2, 3]) as n) where len(w) >= n),
r as (select doc_id, array_to_string(w[i:i + n - 1], ' ') as phrase, n from i where length(w[i]) >= 4 and length(w[i + n - 1]) >= 4), f as (select doc_id, phrase, n, count(*) as tf from r group by all), g as (select phrase, count(*) as df from f group by 1),
s as (select doc_id, phrase, tf, round(tf * ln((select count(*) from documents) / df) * n, 6) as score from f join g using (phrase))
select doc_id, phrase, tf, score, row_number() over (partition by doc_id order by score desc, phrase) as rank from s qualify rank <= 10""")
def t13_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return rules.keyphrases(table(spark, d, "documents"), "doc_id", "text")


_KINDS = {"PERCENT": r"\d+(?:\.\d+)?\s?%", "MONEY": r"[$€£]\s?\d[\d,]*(?:\.\d+)?", "DATE": r"\b\d{4}-\d{2}-\d{2}\b", "QUANTITY": r"\b\d+(?:\.\d+)?\s(?:points?|samples?|pages?|weeks?)\b"}
_FOUND = " union all ".join(f"select doc_id, '{k}' as label, {i} as k, x, pos from (select doc_id, unnest(regexp_extract_all(text, '{p}')) as x, generate_subscripts(regexp_extract_all(text, '{p}'), 1) as pos from documents)" for i, (k, p) in enumerate(_KINDS.items()))


@query(f"""with e as ({_FOUND}), u as (select doc_id, label, k, lower(x) as x, min(pos) as pos from e group by all), t as (select *, row_number() over (partition by doc_id order by k, pos) as r from u qualify r <= 20)
select doc_id, label, count(*) as n, md5(string_agg(x, ',' order by r)) as texts_md5 from t group by 1, 2""")
def t16_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", F.posexplode(rules.entities(F.col("text"))).alias("r", "e"))
    l = F.array_sort(F.collect_list(F.struct("r", F.lower("e.text").alias("x"))))  # noqa: E741  twenty a text
    g = e.groupBy("doc_id", F.col("e.label").alias("label")).agg(F.count("*").alias("n"), l.alias("l"))
    return g.select("doc_id", "label", "n", F.md5(F.array_join("l.x", ",")).alias("texts_md5"))


@query(f"""select doc_id, coalesce(length(text) // 4, 0) as n_tokens, coalesce(len({corpus.words("text")}), 0)::bigint as n_words, case when contains(lower(text), 'step 1') or contains(lower(text), 'step 2') or contains(lower(text), 'how to') or contains(lower(text), 'let''s') or contains(lower(text), 'we will')
or contains(lower(text), 'follow these') or contains(lower(text), 'in this tutorial') or contains(lower(text), 'example:') then 'tutorial' when contains(lower(text), 'api reference') or contains(lower(text), 'parameters:') or contains(lower(text), 'returns:') or contains(lower(text), 'syntax:')
or contains(lower(text), 'arguments:') or contains(lower(text), 'options:') or contains(lower(text), 'methods:') then 'reference' when contains(lower(text), 'introduction') or contains(lower(text), 'overview') or contains(lower(text), 'in this section') or contains(lower(text), 'what is')
or contains(lower(text), 'this document') or contains(lower(text), 'goals:') then 'overview' else 'unknown' end as intent, text is not null as enriched from documents""")
def t17_enriched(spark: SparkSession, d: str) -> DataFrame:
    """All enrichments in one pass; a text that can't be enriched is kept."""
    t = F.col("text")
    n_words = F.when(t.isNotNull(), F.size(tx.tokens(t))).otherwise(0).cast("long")
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.token_estimate(t), F.lit(0)).alias("n_tokens"), n_words.alias("n_words"), rules.intent(t).alias("intent"), t.isNotNull().alias("enriched"))


# ---- payloads of unknown form

SHAPED = """select record_id, case record_id % 5 when 0 then payload when 1 then '[' || payload || ']' when 2 then '[[1, 2], [3, 4]]' when 3 then '[]' else '{"a": ' end as doc from screener_records where json_valid(payload)"""


def _readable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "screener_records").where(F.try_parse_json("payload").isNotNull())


@query(f"""select record_id, case when not json_valid(doc) then 'invalid' when json_type(doc) = 'OBJECT' then 'object' when json_type(doc) = 'ARRAY' then case json_type(doc, '$[0]') when 'OBJECT' then 'array_of_objects' when 'ARRAY' then 'array_of_arrays'
else case when json_array_length(doc) = 0 then 'empty_array' else 'array_of_values' end end else 'value' end as shape from ({SHAPED})""")
def f10_shapes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("record_id") % 5
    doc = F.when(k == 0, F.col("payload")).when(k == 1, F.concat(F.lit("["), F.col("payload"), F.lit("]"))).when(k == 2, "[[1, 2], [3, 4]]").when(k == 3, "[]").otherwise('{"a": ')
    return _readable(spark, d).select("record_id", shapes.json_shape(doc).alias("shape"))


@query("""select * from (values ('day', 'date', 'exact'), ('rate', '10_year_breakeven_inflation', 'part'), ('when', 'retrieved_at', 'part')) t(target, field, how)""")
def f13_suggested_fields(spark: SparkSession, d: str) -> DataFrame:
    names = [(c,) for c in table(spark, d, "breakeven_readings").columns]
    return shapes.suggested_fields(spark.createDataFrame(names, "name string"), "name", {"day": ["day", "date"], "rate": ["inflation", "rate"], "when": ["retrieved"], "volume": ["volume"]})


@query("""select request_id, case when json_valid(decode(response_body)) and json_type(decode(response_body)) in ('OBJECT', 'ARRAY') then 'api' end as strategy from network_requests
where response_body is not null and content_type like '%json%'""")
def s34_strategies(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "network_requests").where("response_body is not null and content_type like '%json%'")
    return r.select("request_id", shapes.strategy(F.col("response_body").cast("string")).alias("strategy"))


@query("select record_id, payload as found from screener_records where json_valid(payload)")
def x25_extracted_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of what a model answers: fenced, or between words."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("payload"), F.lit("\n```\nDone."))
    wrapped = F.when(F.length("payload") % 2 == 0, fenced).otherwise(F.concat(F.lit("Result: "), F.col("payload"), F.lit(" as asked.")))
    return _readable(spark, d).select("record_id", shapes.extract_json(wrapped).alias("found"))


@query("select event_type, ts::date as day, round(sum(value), 4) as price, count(*)::double as volume from events group by 1, 2")
def s24_index_days(spark: SparkSession, d: str) -> DataFrame:
    """A document of days for each index, nested as the older service sends it for some, read back to rows."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("close"), F.count("*").cast("double").alias("volumeto"))
    m = daily.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("day", F.struct("close", "volumeto"))))).alias("m"))
    doc = F.when(F.length("event_type") > 5, F.concat(F.lit('{"Data": {"Data": '), F.col("m"), F.lit("}}"))).otherwise(F.col("m"))
    return shapes.index_rows(m, ["event_type"], doc, {"close": "price", "volumeto": "volume"})


@query("select l_orderkey, l_linenumber, l_quantity as quantity, l_extendedprice as price, null::varchar as rebate from lineitem")
def s27_renamed_like(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return shapes.renamed_like(line, {"l_orderkey": "l_orderkey", "l_linenumber": "LINENUMBER", "quantity": "L_QUANTITY", "price": "extendedprice", "rebate": "no such thing"})


@query("select (select round(sum(o_totalprice), 2) from orders) as staked, (select count(*)::double from lineitem) as supply")
def s28_picked_values(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("sum_total"), F.lit("x").alias("note"))
    b = table(spark, d, "lineitem").agg(F.max("l_quantity").alias("most"), F.count("*").alias("n"))
    x = a.select(shapes.picked_value(a, ["staked", "total"]).alias("staked"))
    return x.join(F.broadcast(b.select(shapes.picked_value(b, ["supply"]).alias("supply"))))  # one row each


_ICS = "select date_trunc('month', date)::date as month, round(avg({c}), 6) as v from dg_ecfin_surveys where {c} is not null and not isnan({c}) {w} group by 1"


@query(f"""select a.month, a.v as ics, b.v as icc, c.v as ice from ({_ICS.format(c='esi_eu', w="and date >= timestamp '2005-01-01'")}) a left join ({_ICS.format(c='eei_ea', w='')}) b using (month) left join ({_ICS.format(c='eei_eu', w='')}) c using (month)""")
def s30_survey_files(spark: SparkSession, d: str) -> DataFrame:
    """Three files of month, year and value; the months of the first are kept."""

    def sent(c: str, where: str = "true") -> DataFrame:
        t = table(spark, d, "dg_ecfin_surveys").where(where).select(F.date_format("date", "MMMM").alias("Month"), F.year("date").alias("YYYY"), F.col(c).alias("v")).where("v is not null and not isnan(v)")
        return t.groupBy("Month", "YYYY").agg(F.round(F.avg("v"), 6).cast("string").alias("v"))

    parts = [(n, sent(c, w)) for n, c, w in (("ics", "esi_eu", "date >= timestamp_ntz '2005-01-01'"), ("icc", "eei_ea", "true"), ("ice", "eei_eu", "true"))]
    dated = [p.select(dates.month_year(F.col("Month"), F.col("YYYY")).alias("month"), numbers.guarded_double(F.col("v")).alias(n)).where("month is not null") for n, p in parts]
    return frames.align_left(dated[0], dated[1:], "month")


@query("select n_name as name, n_nationkey::varchar as key from nation")
def s31_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet as rows of cells, with lines above its header and a column nobody asked for."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 10).alias("nr"), F.array(F.lit("-"), F.col("n_name"), F.col("n_nationkey").cast("string")).alias("cells"))
    top = spark.createDataFrame([(0, ["Nations", "", ""]), (1, ["", "", ""]), (2, ["Note", " Name", "KEY "])], "nr int, cells array<string>")
    return shapes.sheet_table(top.unionByName(n), "nr", "cells", {"name": "name", "key": "key"})


_OBS = 'select date::date as date, round(avg("{c}"), 6) as {n} from breakeven_readings where "{c}" is not null and not isnan("{c}") and date is not null group by 1'


@query(f"""select date, ten, five, year(date)::int as year, month(date)::int as month, day(date)::int as day from ({_OBS.format(c='10_year_breakeven_inflation', n='ten')}) full join ({_OBS.format(c='5y5y_forward_inflation', n='five')}) using (date)""")
def s32_combined_series(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "breakeven_readings").where("date is not null")

    def series(c: str, n: str) -> DataFrame:
        v = F.col(f"`{c}`")
        return t.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.to_date("date").alias("date")).agg(F.round(F.avg(v), 6).alias(n))

    both = frames.merge([series("10_year_breakeven_inflation", "ten"), series("5y5y_forward_inflation", "five")], "date")
    return both.select("date", "ten", "five", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"))


@query("""select c_custkey, c_mktsegment as symbol, 'SPACE: no holdings' as errors from customer where c_acctbal > 9000 and c_mktsegment in ('BUILDING', 'MACHINERY')""")
def s35_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Holdings of several symbols, one of which can't be had."""
    c = table(spark, d, "customer").where("c_acctbal > 9000")
    got = {s: c.where(F.col("c_mktsegment") == s).select("c_custkey") for s in ("BUILDING", "MACHINERY")}
    both, errors = shapes.union_or_errors({**got, "SPACE": LookupError("no holdings")}, "symbol")
    return both.withColumn("errors", F.lit(errors))


@query("""select chart_id, 'cadence unknown' as finding from chart_feeds where cadence not in ('hourly', 'daily') union all select chart_id, 'slug missing' from chart_feeds where slug is null or trim(slug) = ''
union all select chart_id, 'key repeated' from chart_feeds group by 1 having count(*) > 1""")
def s44_registry(spark: SparkSession, d: str) -> DataFrame:
    return shapes.registry_findings(table(spark, d, "chart_feeds"), "chart_id", ["slug", "tz"], {"cadence": ["hourly", "daily"]})


@query("select request_id, coalesce(content_length, 0) as score, url from network_requests where url is not null")
def o04_sorted_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "network_requests").where("url is not null").select("request_id", F.coalesce("content_length", F.lit(0)).alias("score"), "url")
    return c.orderBy(F.desc("score"), "request_id")


# ---- cells, names and lists

CELL = """select snapshot_id, latest_value, case snapshot_id % 8 when 0 then round(latest_value, 1)::varchar when 1 then '$' || round(latest_value, 1)::varchar || 'M' when 2 then round(latest_value, 1)::varchar || '%' when 3 then '1,' || lpad(floor(latest_value)::int::varchar, 3, '0')
when 4 then round(latest_value, 1)::varchar || 'k' when 5 then 'n/a' when 6 then '-' || round(latest_value, 1)::varchar else '–' || round(latest_value, 1)::varchar || 'B' end as cell from umcsent_snapshots where latest_value between 1 and 999"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "umcsent_snapshots").where("latest_value between 1 and 999")
    v, k = F.round("latest_value", 1).cast("string"), F.col("snapshot_id") % 8
    join = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    c = F.when(k == 0, v).when(k == 1, join("$", v, "M")).when(k == 2, join(v, "%")).when(k == 3, join("1,", F.lpad(F.floor("latest_value").cast("string"), 3, "0"))).when(k == 4, join(v, "k")).when(k == 5, "n/a").when(k == 6, join("-", v))
    return u.select("snapshot_id", "latest_value", c.otherwise(join("–", v, "B")).alias("cell"))


@query(f"""select snapshot_id, round(case snapshot_id % 8 when 0 then round(latest_value, 1) when 1 then round(latest_value, 1) * 1e6 when 2 then round(latest_value, 1) when 3 then 1000 + floor(latest_value) when 4 then round(latest_value, 1) * 1e3
when 6 then -round(latest_value, 1) end, 4) as n, case when snapshot_id % 8 in (5, 7) then cell end as t from ({CELL})""")
def x07_converted(spark: SparkSession, d: str) -> DataFrame:
    n, t = numbers.converted(F.col("cell"))
    return _cells(spark, d).select("snapshot_id", F.round(n, 4).alias("n"), t.alias("t"))


@query(f"select snapshot_id, snapshot_id % 8 not in (5, 7) as looks from ({CELL})")
def x08_looks_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("snapshot_id", numbers.looks_numeric(F.col("cell")).alias("looks"))


@query(f"""select snapshot_id, round(case snapshot_id % 8 when 0 then round(latest_value, 1) when 1 then round(latest_value, 1) * 1e6 when 2 then round(latest_value, 1) when 3 then 1000 + floor(latest_value) when 4 then round(latest_value, 1) * 1e3
when 6 then -round(latest_value, 1) when 7 then -round(latest_value, 1) * 1e9 end, 2) as n, case when snapshot_id % 8 = 5 then cell end as t from ({CELL})""")
def x09_split_values(spark: SparkSession, d: str) -> DataFrame:
    n, t = numbers.split_value(F.col("cell"))
    return _cells(spark, d).select("snapshot_id", F.round(n, 2).alias("n"), t.alias("t"))


@query(f"select snapshot_id, snapshot_id % 8 in (0, 3, 6) as numeric from ({CELL})")
def x11_numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("snapshot_id", numbers.is_numeric_cell(F.col("cell")).alias("numeric"))


@query("""select * from (values ('bid', 'price'), ('Ask Size', 'price'), ('open_interest', 'price'), ('futures_oi_all_exchanges', 'percent'), ('24h %', 'percent'), ('market_cap', 'volume'), ('Symbol', 'ticker'), ('rank', 'number')) t(name, role)""")
def x06_column_roles(spark: SparkSession, d: str) -> DataFrame:
    names = ["bid", "Ask Size", "open_interest", "futures_oi_all_exchanges", "24h %", "market_cap", "Symbol", "rank"]
    return spark.createDataFrame([(n, numbers.column_role(n)) for n in names], "name string, role string")


@query(r"""select result_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(trim(section_title), '[^0-9a-zA-Z_]+', '_', 'g')), '_+', '_', 'g'), '_'), ''), 'column') as name,
trim(regexp_replace(regexp_replace(section_title, '[\s\p{Z}]+', ' ', 'g'), '\p{C}', '', 'g')) as shown from search_chunks where section_title is not null""")
def x16_clean_names(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_chunks").where("section_title is not null")
    return s.select("result_id", tx.clean_name(F.col("section_title")).alias("name"), tx.printable(F.col("section_title")).alias("shown"))


@query("""with p as (select record_id, payload as p from screener_records where json_valid(payload)), k as (select record_id, p, unnest(json_keys(p)) as k from p),
t as (select record_id, k, json_extract(p, '$."' || k || '"') as v from k)
select record_id, k as name from t where coalesce(json_type(v), 'NULL') <> 'OBJECT' union all select record_id, k || '_' || unnest(json_keys(v)) from t where json_type(v) = 'OBJECT'""")
def x17_flat_fields(spark: SparkSession, d: str) -> DataFrame:
    return structured.flat_fields(_readable(spark, d), ["record_id"], F.col("payload")).select("record_id", "name")


@query("""select result_id, list_has_any(keywords, ['model', 'survey', 'index']) as any_of, list_has_all(keywords, ['model', 'survey']) as all_of, len(keywords) = len(topic_tags) as same_length,
array_to_string(list_filter(keywords || topic_tags, lambda x, i: list_position(keywords || topic_tags, x) = i), ',') as first_ones from search_chunks where keywords is not null and topic_tags is not null""")
def x19_lists(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("keywords is not null and topic_tags is not null")
    every = F.size(F.array_except(_lits("model", "survey"), F.col("keywords"))) == 0
    first_ones = F.array_join(F.array_distinct(F.concat("keywords", "topic_tags")), ",")
    return c.select("result_id", F.arrays_overlap("keywords", _lits("model", "survey", "index")).alias("any_of"), every.alias("all_of"), (F.size("keywords") == F.size("topic_tags")).alias("same_length"), first_ones.alias("first_ones"))


@query("""select record_id, coalesce(json_extract_string(payload, '$.observed.font'), json_extract_string(payload, '$.expected.font'), 'Calibri') as font, coalesce(try_cast(json_extract_string(payload, '$.observed.size') as double), try_cast(json_extract_string(payload, '$.expected.size') as double), 11) as size,
upper(coalesce(json_extract_string(payload, '$.observed.color'), json_extract_string(payload, '$.expected.color'), '#000000')) as color from screener_records where json_valid(payload)""")
def x20_resolved_runs(spark: SparkSession, d: str) -> DataFrame:
    """What a run inherits: its own value, else that of its style, else the default."""
    get = lambda a: [F.get_json_object("payload", f"$.{side}.{a}") for side in ("observed", "expected")]
    size = [x.try_cast("double") for x in get("size")]
    return _readable(spark, d).select("record_id", F.coalesce(*get("font"), F.lit("Calibri")).alias("font"), F.coalesce(*size, F.lit(11.0)).alias("size"), F.upper(F.coalesce(*get("color"), F.lit("#000000"))).alias("color"))


# ---- files, written to the shared folder and read back


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def s11_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON, one of them broken."""
    path = scratch(spark, "lines")
    lines = table(spark, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value"))
    lines.unionByName(spark.createDataFrame([('{"r_regionkey": 9, "r_na',)], "value string")).coalesce(1).write.text(path)
    return structured.read_json(spark, path, "r_regionkey bigint, r_name string")


@query("select n_nationkey as id, n_name as label, n_regionkey from nation")
def s14_mapped_fields(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("en")).alias("name")).alias("nation"), "n_regionkey")
    return structured.apply_mapping(n, {"nation.id": "id", "nation.name.en": "label"})


@query("select * from (values ('keywords'), ('heading_hierarchy'), ('entities'), ('topic_tags')) t(path)")
def s15_array_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in structured.nested_arrays(table(spark, d, "search_chunks").schema)], "path string")


@query("select n_nationkey, n_name, n_regionkey from nation")
def s16_sniffed_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return structured.read_csv(spark, path)


@query("select n_nationkey::bigint as _key, n_name as name from nation")
def s17_xml_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "xml")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name"))
    n.coalesce(1).write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    return structured.read_xml(spark, path, "nation").select("_key", "name")


@query("select 'data' as part, count(*)::varchar as value from nation union all select 'rows', count(*)::varchar from nation union all select 'columns', '3'")
def s39_exported(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "export")
    files.export(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    data = spark.read.option("header", True).csv(f"{path}/data").agg(F.lit("data").alias("part"), F.count("*").cast("string").alias("value"))
    return data.unionByName(spark.read.json(f"{path}/metadata").where("property in ('rows', 'columns')").select(F.col("property").alias("part"), "value"))


@query("select r_name || '.pdf' as name, 'pdf' as document_type from region")
def s01_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Documents below a folder; what is no document isn't listed."""
    path = scratch(spark, "folder")
    files.put_texts(spark, {f"{path}/{r['r_name']}.pdf": "x" for r in table(spark, d, "region").collect()} | {f"{path}/notes.txt": "x"})  # five rows
    return files.discover(spark, path).select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("name"), "document_type")


@query(f"select h as content_hash, min(doc_id) as doc_id from ({corpus.HASHED}) group by 1")
def r01_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream into a table that takes each hash once."""
    from fathom.streaming import incremental

    path = scratch(spark, "hashes")
    schema = table(spark, d, "documents").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")  # a pattern, as a stream takes no single file but by one; the table may be a folder of files, too
    q = source.select("doc_id", "text").writeStream.foreachBatch(incremental.into_table(path, "text", "doc_id")).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("content_hash", "doc_id")
