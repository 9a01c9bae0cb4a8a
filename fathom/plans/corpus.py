"""Queries over documents, chunks and vectors, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.functions import web
from fathom.operators import chunking, citations, dedup, linked, rules, screener, search
from fathom.session import table

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


def normal(e: str) -> str:
    """SQL of ``hash_normal``."""
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[\s\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), ' ')"


def words(e: str) -> str:
    """SQL of ``tokens``."""
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"


HASHED = f"select doc_id, source, sha256({normal('text')}) as h from documents"


# ---- duplicates


@query(f"select doc_id, h as content_hash from ({HASHED})")
def d01_normalized_hash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hashed(table(spark, d, "documents"), "text").select("doc_id", "content_hash")


@query(f"select doc_id, h as content_hash, min(doc_id) over (partition by h) as canonical, doc_id <> min(doc_id) over (partition by h) as is_duplicate from ({HASHED})")
def d03_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query(f"""with x as (select doc_id <> min(doc_id) over (partition by h) as dup from ({HASHED})) select count(*) as total, count(*) filter (not dup) as "unique", count(*) filter (dup) as removed,
round(100.0 * count(*) filter (dup) / count(*), 4) as removal_pct from x""")
def a27_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_stats(d03_exact_dedup(spark, d))


@query(f"with x as ({HASHED}) select doc_id, h as content_hash from x where source <> 'lesson_main' and h not in (select h from x where source = 'lesson_main')")
def j07_incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    existing = dedup.hashed(t.where("source = 'lesson_main'"), "text")
    return dedup.unseen(t.where("source <> 'lesson_main'"), "text", existing).select("doc_id", "content_hash")


@query(r"""with t as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g'), ' ') as t from documents)
select doc_id, case when length(t) < 3 then 1 else len(list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i::bigint, 3)))) end as n_shingles from t""")
def d04_shingle_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tx.char_shingles(F.col("text"))).alias("n_shingles"))


@query("select doc_id, 128::bigint as n_values, 128::bigint as n_digits, true as same_start from documents")
def d05_minhash(spark: SparkSession, d: str) -> DataFrame:
    m = dedup.minhash(table(spark, d, "documents"), "doc_id", "text")
    first = F.conv(F.left("fingerprint", F.lit(8)), 16, 10).cast("bigint")
    return m.select("doc_id", F.size("signature").cast("long").alias("n_values"), F.length("fingerprint").cast("long").alias("n_digits"), (first == F.col("signature")[0]).alias("same_start"))


GRAMS = r"""with t as (select result_id, trim(regexp_replace(lower(coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g'), ' ') as t from search_chunks),
s as (select result_id, case when length(t) < 3 then [t] else list_sort(list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i::bigint, 3)))) end as s from t),
r as (select min(result_id) as k, s, len(s) as n from s group by s), x as (select a.k as a, b.k as b, a.n as na, b.n as nb, len(list_intersect(a.s, b.s)) as x from r a join r b on a.k < b.k and a.n >= 0.92 * b.n and b.n >= 0.92 * a.n),
p as (select a, b, x / (na + nb - x) as similarity from x where x / (na + nb - x) >= 0.92 - 1e-12) """


@query(GRAMS + "select a, b, round(similarity, 6) as similarity from p")
def d06_near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_texts(table(spark, d, "search_chunks"), "result_id", "text", 0.92)[1].select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(GRAMS + "select s.result_id, r.k as representative from s join r using (s)")
def d06_membership(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_texts(table(spark, d, "search_chunks"), "result_id", "text", 0.92)[0].select(F.col("k").alias("result_id"), F.col("rep").alias("representative"))


@query("select * from (values (0.5, 25, 5), (0.7, 14, 9), (0.8, 9, 13), (0.85, 8, 16), (0.9, 5, 25), (0.92, 4, 29)) t(similarity, bands, rows_per_band)")
def d07_lsh_bands(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x, *dedup.lsh_bands(x)) for x in (0.5, 0.7, 0.8, 0.85, 0.9, 0.92)], "similarity double, bands int, rows_per_band int")


@query()
def j10_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.lsh_pairs(table(spark, d, "search_chunks"), "result_id", "text", 0.92)[1].select("a", "b", F.round("similarity", 6).alias("similarity"))


TWO_STAGES = GRAMS.replace("from search_chunks)", "from kept)").replace("with t as", f"""with h as (select result_id, text, sha256({normal('text')}) as h from search_chunks), e as (select result_id, text, min(result_id) over (partition by h) as canonical from h),
kept as (select result_id, text from e where result_id = canonical), t as""") + """, n as (select k, min(c) as c from (select s.result_id as k, r.k as c from s join r using (s) where s.result_id <> r.k union all select s.result_id, p.a from s join r using (s) join p on p.b = r.k) group by 1),
z as (select e.result_id, case when e.result_id <> e.canonical then 'exact' when n.k is not null then 'near' else 'unique' end as stage, case when e.result_id <> e.canonical then e.canonical else coalesce(n.c, e.canonical) end as canonical from e left join n on n.k = e.result_id) """


@query(TWO_STAGES + "select * from z")
def d08_two_stages(spark: SparkSession, d: str) -> DataFrame:
    return dedup.two_stages(table(spark, d, "search_chunks"), "result_id", "text").select("result_id", "stage", "canonical")


@query(TWO_STAGES + """select count(*) as total, count(*) filter (stage = 'exact') as exact_removed, count(*) filter (stage = 'near') as near_removed, count(*) filter (stage = 'unique') as kept,
round(100.0 * count(*) filter (stage <> 'unique') / count(*), 4) as removal_pct from z""")
def d08_stage_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.stage_stats(dedup.two_stages(table(spark, d, "search_chunks"), "result_id", "text"))


@query("""with p as (select result_id, semantic_fingerprint as a, lag(semantic_fingerprint) over (partition by document_id order by result_id) as b from search_chunks where semantic_fingerprint is not null),
c as (select *, least(length(a), length(b)) as n from p where b is not null)
select result_id, round(list_sum(list_transform(generate_series(1, n), lambda i: (a[i] = b[i])::int)) / n, 6) as similarity from c where n > 0""")
def d09_fingerprint_similarity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("result_id")
    print_ = F.col("semantic_fingerprint")
    p = table(spark, d, "search_chunks").where(print_.isNotNull()).select("result_id", print_.alias("a"), F.lag(print_).over(w).alias("b")).where("b is not null")
    return p.select("result_id", F.round(dedup.fingerprint_similarity(F.col("a"), F.col("b")), 6).alias("similarity")).where("similarity is not null")


def content_words(e: str) -> str:
    return f"list_distinct(list_filter({words(e)}, lambda w: length(w) > 2 and w not in ('the','a','an','and','or','but','in','on','at','to','for')))"


@query(f"""with c as (select result_id, document_id, coalesce(slide_number, page_number) as place, coalesce(text, '') as t, file_type from search_chunks),
s as (select document_id, place, t from (select *, row_number() over (partition by document_id, place order by result_id) as r from c where place is not null) where r = 1),
j as (select c.result_id, {content_words('c.t')} as a, {content_words("coalesce(s.t, '')")} as b, s.t is null as alone from c left join s using (document_id, place))
select result_id, round(case when alone then 0 when len(a) = 0 and len(b) = 0 then 1 when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as similarity from j""")
def d11_word_jaccard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").select("result_id", "document_id", F.coalesce("slide_number", "page_number").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    s = linked.one_per(c.where("place is not null"), ["document_id", "place"], [F.asc("result_id")])
    return dedup.word_duplicates(c, s, ["document_id", "place"], "text").select("result_id", F.round("similarity", 6).alias("similarity"))


# ---- chunks and text


@query(f"select doc_id, length(text) // 4 as n_estimated, len({words('text')}) as n_words from documents where text is not null")
def t01_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.token_estimate(t).alias("n_estimated"), F.size(tx.tokens(t)).cast("long").alias("n_words"))


@query(r"""with t as (select doc_id, list_filter(string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') as t from documents where text is not null),
s as (select doc_id, t, generate_series(0, greatest(len(t) - 11, 0), 90) as starts from t where len(t) > 0),
w as (select doc_id, t, len(starts) as n, unnest(starts) as s, generate_subscripts(starts, 1) - 1 as i from s)
select doc_id, i as chunk_index, n as n_chunks, len(t[s + 1:s + 100]) as token_count, md5(array_to_string(t[s + 1:s + 100], ' ')) as chunk_md5,
case when n = 1 then 'only' when i = 0 then 'beginning' when i = n - 1 then 'end' else 'middle' end as position from w""")
def t05_token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.token_windows(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 100, 10)
    return w.select("doc_id", "chunk_index", "n_chunks", "token_count", F.md5("chunk").alias("chunk_md5"), "position")


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t\r]*\n'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' ')), lambda x: x <> '') as ps from documents where text is not null),
r as (select doc_id, list_reduce(ps, lambda a, y: case when length(y) // 4 > 250 then {'d': (case when a.c = '' then a.d else a.d || [a.c] end) || list_transform(generate_series(0, greatest(length(y) - 201, 0), 800), lambda i: trim(substring(y, i + 1, 1000), ' ')), 'c': ''}
when a.c = '' then {'d': a.d, 'c': y} when length(a.c) // 4 + length(y) // 4 <= 250 then {'d': a.d, 'c': a.c || chr(10) || chr(10) || y} else {'d': a.d || [a.c], 'c': y} end, {'d': []::varchar[], 'c': ''}) as r from p where len(ps) > 0),
c as (select doc_id, case when r.c = '' then r.d else r.d || [r.c] end as cs from r)
select doc_id, generate_subscripts(cs, 1) - 1 as chunk_index, unnest(cs) as chunk, length(unnest(cs)) // 4 as token_count from c""")
def t06_paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_paragraphs(table(spark, d, "documents"), "doc_id", "text", 250)


@query(r"select result_id, sha256(document_id || ':' || chunk_index::varchar) as stable_id, substr(sha256(document_id || ':' || filename), 1, 16) as file_key from search_chunks where document_id is not null and chunk_index is not null and filename is not null")
def t03_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("document_id is not null and chunk_index is not null and filename is not null")
    return c.select("result_id", chunking.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("stable_id"), F.left(F.sha2(F.concat_ws(":", "document_id", "filename"), 256), F.lit(16)).alias("file_key"))


def _topic_sql() -> str:
    rows = ", ".join(f"('{t}', '{' '.join(rules._words(k))}', {i})" for i, (t, ks) in enumerate(rules.TOPICS.items()) for k in ks)
    return f"""with k as (select * from (values {rows}) v(topic, gram, nr)), t as (select doc_id, {words("coalesce(text, '')")} as w from documents),
g as (select doc_id, len(w) as n, unnest(w) as gram from t union all select doc_id, len(w), unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' '))) from t where len(w) >= 2
union all select doc_id, len(w), unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) from t where len(w) >= 3),
h as (select doc_id, topic, count(*) as hits, min(nr) as nr, max(n) as n from g join k using (gram) group by 1, 2)
select doc_id, topic, hits, round(hits / n, 6) as score, row_number() over (partition by doc_id order by hits desc, nr) as rank from h where hits / n >= 0.01 qualify rank <= 5"""


@query(_topic_sql())
def t14_topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return rules.topics(table(spark, d, "documents"), "doc_id", "text")


def _intent_sql() -> str:
    parts = {n: " or ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) for n, ps in rules.INTENTS.items()}
    return f"select doc_id, case {' '.join(f'when {c} then {chr(39)}{n}{chr(39)}' for n, c in parts.items())} else 'unknown' end as intent from documents"


@query(_intent_sql())
def t15_intent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.intent(F.col("text")).alias("intent"))


@query(f"""with t as (select doc_id, unnest(list_filter({words("coalesce(text, '')")}, lambda w: length(w) >= 4)) as term from documents), f as (select doc_id, term, count(*) as tf from t group by 1, 2),
g as (select term, count(*) as df from f group by 1), s as (select doc_id, term, tf, round(tf * ln((select count(*) from documents) / df), 6) as score from f join g using (term))
select doc_id, term, tf, score, row_number() over (partition by doc_id order by score desc, term) as rank from s qualify rank <= 10""")
def t13_keywords(spark: SparkSession, d: str) -> DataFrame:
    return rules.tfidf_keywords(table(spark, d, "documents"), "doc_id", "text", 10)


LABEL = """concat_ws(' | ', nullif(module_name, ''), 'Week ' || week_number, coalesce('Slide ' || slide_number, 'Page ' || page_number), filename)"""


def _label() -> Column:
    return citations.source_label(F.col("module_name"), F.col("week_number"), F.col("slide_number"), F.col("page_number"), F.col("filename"))


@query(f"select result_id, '[' || {LABEL} || ']' as citation from search_chunks")
def t21_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").select("result_id", citations.inline_citation(_label()).alias("citation"))


@query(f"""with h as (select *, row_number() over (partition by module_name order by score desc, result_id) as r from search_chunks where module_name is not null and score is not null qualify r <= 3)
select module_name, md5(string_agg(concat_ws(chr(10), printf('--- Result %d (relevance: %.2f) ---', r, floor(score * 100 + 0.5) / 100), 'Source: [' || {LABEL} || ']', 'Section: ' || nullif(section_title, ''), text), chr(10) || chr(10) order by r)) as context_md5 from h group by 1""")
def t20_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("module_name is not null and score is not null")
    h = c.withColumn("r", F.row_number().over(Window.partitionBy("module_name").orderBy(F.desc("score"), "result_id"))).where("r <= 3")
    block = citations.context_block(F.col("r"), F.floor(F.col("score") * 100 + 0.5) / 100, _label(), F.col("section_title"), F.col("text"))
    return citations.contexts(h, "module_name", "r", block).select("module_name", F.md5("context").alias("context_md5"))


@query(f"""select result_id, try_cast(nullif(regexp_extract(l, '(?i)Week\\s+(\\d+)', 1), '') as int) as week, try_cast(nullif(regexp_extract(l, '(?i)Slide\\s+(\\d+)', 1), '') as int) as slide,
try_cast(nullif(regexp_extract(l, '(?i)Page\\s+(\\d+)', 1), '') as int) as page from (select result_id, {LABEL} as l from search_chunks)""")
def t22_parsed_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").select("result_id", citations.parsed_source(_label()).alias("s")).select("result_id", "s.week", "s.slide", "s.page")


@query(r"""select result_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'), ' ') as normal from search_chunks where text is not null""")
def t12_parser_normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").where("text is not null").select("result_id", tx.parser_normal(F.col("text")).alias("normal"))


@query("""select result_id, '<p>' || replace(replace(replace(section_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' as html, trim(regexp_replace(section_title, '\\s+', ' ', 'g'), ' ') as plain from search_chunks where section_title is not null""")
def x15_strip_html(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_chunks").where("section_title is not null")
    esc = F.replace(F.replace(F.replace("section_title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    h = s.select("result_id", F.concat(F.lit("<p>"), esc, F.lit("</p>")).alias("html"))
    return h.select("result_id", "html", tx.strip_html(F.col("html")).alias("plain"))


@query(r"""select result_id, try_cast(nullif(regexp_extract(folder_path || '/' || filename, '(?i)week\s*(\d+)', 1), '') as int) as week,
case when regexp_matches(lower(filename), '\.(pdf)$') then 'pdf' when regexp_matches(lower(filename), '\.(pptx|ppt)$') then 'pptx' when regexp_matches(lower(filename), '\.(docx|doc)$') then 'docx' else 'unknown' end as document_type from search_chunks where folder_path is not null and filename is not null""")
def s03_path_metadata(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.files import document_type

    c = table(spark, d, "search_chunks").where("folder_path is not null and filename is not null")
    return c.select("result_id", web.folder_week(F.concat_ws("/", "folder_path", "filename")).alias("week"), document_type(F.col("filename")).alias("document_type"))


# ---- rollups of chunks


@query("""with k as (select source, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))) as term from documents where source is not null), c as (select source, term, count(*) as n from k where length(term) >= 5 group by 1, 2)
select source, term, n, row_number() over (partition by source order by n desc, term) as rank from c qualify rank <= 20""")
def a23_doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("source is not null").select("source", F.explode(F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))).alias("term")).where(F.length("term") >= 5)
    c = t.groupBy("source", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "term")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


@query("""select week_number, module_name, count(distinct document_id) as n_documents, count(*) as n_chunks, array_to_string(list_sort(list_distinct(list(file_type))), ',') as types from search_chunks group by 1, 2""")
def a26_module_inventory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks")
    return c.groupBy("week_number", "module_name").agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.array_join(F.array_sort(F.collect_set("file_type")), ",").alias("types"))


@query("""select document_id, count(*) as n, min(filename) as filename, count(*) filter (file_type = 'pdf') as n_pdf from search_chunks where document_id is not null group by 1 order by n desc, document_id limit 1000""")
def a24_terms_agg(spark: SparkSession, d: str) -> DataFrame:
    t = linked.terms(table(spark, d, "search_chunks").where("document_id is not null"), "document_id", "filename", "file_type")
    return t.select("document_id", "n", "filename", F.coalesce(F.try_element_at("counts", F.lit("pdf")), F.lit(0)).alias("n_pdf"))


@query("select sum(token_count) as total, sum(token_count) // count(token_count) as average from search_chunks")
def a28_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").agg(F.sum("token_count").alias("total"), F.floor(F.sum("token_count") / F.count("token_count")).alias("average"))


@query("""with t as (select module_name, score, row_number() over (partition by module_name order by score desc, result_id) as r from search_chunks where module_name is not null and score is not null qualify r <= 3)
select module_name, max(score) as best, round(avg(score), 6) as mean from t group by 1""")
def a29_scope_scores(spark: SparkSession, d: str) -> DataFrame:
    from fathom.operators.frames import top_k

    t = top_k(table(spark, d, "search_chunks").where("module_name is not null and score is not null"), [F.desc("score"), F.asc("result_id")], 3, ["module_name"])
    return t.groupBy("module_name").agg(F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query("""select result_id, last_value(nullif(trim(section_title), '') ignore nulls) over (partition by document_id order by chunk_index, result_id rows unbounded preceding) as section,
row_number() over (partition by document_id order by chunk_index, result_id) - 1 as nr from search_chunks where document_id is not null""")
def w03_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("document_id is not null")
    w = Window.partitionBy("document_id").orderBy("chunk_index", "result_id")
    return chunking.carry_forward(c, "document_id", ["chunk_index", "result_id"], "section_title", "section").select("result_id", "section", (F.row_number().over(w) - 1).alias("nr"))


@query(r"""with h as (select doc_id, regexp_extract_all(text, '(?m)^(#{1,6})\s+\S.*$', 1) as m, regexp_extract_all(text, '(?m)^#{1,6}\s+(\S.*?)\s*$', 1) as t from documents where text is not null),
r as (select doc_id, list_reduce(list_transform(m, lambda x, i: {'l': length(x), 't': t[i]}), lambda a, x: list_filter(a, lambda y: y.l < x.l) || [x], []::struct(l bigint, t varchar)[]) as s from h where len(m) > 0)
select doc_id, list_transform(s, lambda x: x.t) as path from r where len(s) > 0""")
def w04_heading_paths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    marks = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6})\s+\S.*$"), F.lit(1))
    titles = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}\s+(\S.*?)\s*$"), F.lit(1))
    return t.select("doc_id", chunking.heading_path(F.transform(marks, lambda m: F.length(m)), titles).alias("path")).where(F.size("path") > 0)


@query("""with c as (select *, row_number() over (partition by source order by created_at desc, doc_id desc) as r from documents where source is not null qualify r <= 5)
select source, string_agg(doc_id::varchar, ',' order by created_at, doc_id) as last_docs from c group by 1""")
def w09_last_five(spark: SparkSession, d: str) -> DataFrame:
    from fathom.operators.frames import top_k

    t = top_k(table(spark, d, "documents").where("source is not null"), [F.desc("created_at"), F.desc("doc_id")], 5, ["source"])
    g = t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("created_at", "doc_id"))).alias("l"))  # five per source
    return g.select("source", F.array_join(F.transform("l.doc_id", lambda x: x.cast("string")), ",").alias("last_docs"))


@query("""with p as (select *, coalesce(slide_number, page_number) as place from search_chunks where document_id is not null), s as (select document_id, place, min(result_id) as partner from p where place is not null and content_type is not null group by 1, 2)
select result_id, partner from p left join s using (document_id, place)""")
def j05_linked_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "search_chunks").where("document_id is not null").withColumn("place", F.coalesce("slide_number", "page_number"))
    return linked.linked(p, p.where("content_type is not null"), ["document_id", "place"], "result_id", "partner", [F.asc("result_id")]).select("result_id", "partner")


@query("""select document_id, page_number, arg_min(text, result_id) filter (extraction_method = 'native' and text is not null) as native, arg_min(text, result_id) filter (extraction_method = 'textract' and text is not null) as textract, count(*) as n,
coalesce(arg_min(text, result_id) filter (extraction_method = 'native' and text is not null), arg_min(text, result_id) filter (extraction_method = 'textract' and text is not null)) as primary_text from search_chunks where page_number is not null group by 1, 2""")
def j06_assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "search_chunks").where("page_number is not null")
    p = p.withColumn("nr", F.when(F.col("text").isNotNull(), F.col("result_id")))
    return linked.assembled(p, ["document_id", "page_number"], "extraction_method", "text", "nr", ["native", "textract"])


@query("""select result_id, content_hash from (select *, row_number() over (partition by chunk_id order by ingested_at desc, result_id desc) as r from search_chunks where chunk_id is not null) where r = 1""")
def s40_upsert(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.files import upserted

    c = table(spark, d, "search_chunks").where("chunk_id is not null").select("result_id", "chunk_id", "content_hash", "ingested_at")
    latest = linked.one_per(c, ["chunk_id"], [F.desc("ingested_at"), F.desc("result_id")])
    earliest = linked.one_per(c, ["chunk_id"], [F.asc("ingested_at"), F.asc("result_id")])
    return upserted(earliest, latest, "chunk_id").select("result_id", "content_hash")


@query("select distinct content_hash from search_chunks where content_hash is not null")
def s41_known_hashes(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.files import known_hashes

    return known_hashes(table(spark, d, "search_chunks"))


# ---- filters and search


@query("select result_id from search_chunks where file_type = 'pdf' and week_number in (1, 2, 3) and list_has_any(topic_tags, ['data', 'testing', 'concepts'])")
def f01_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.metadata_filter(table(spark, d, "search_chunks"), {"file_type": "pdf"}, {"week_number": [1, 2, 3], "topic_tags": ["data", "testing", "concepts"]}).select("result_id")


@query("select result_id, chunk_id, score, filename, week_number, left(text, 500) as text, left(text, 200) as snippet from search_chunks where score >= 0.5 and trim(text) <> ''")
def f02_score_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "search_chunks").where("score >= 0.5 and trim(text) <> ''")
    return c.select("result_id", "chunk_id", "score", "filename", "week_number", F.left("text", F.lit(500)).alias("text"), F.left("text", F.lit(200)).alias("snippet"))


# Patterns of the gate in this query; a gate takes any.
GATE = [("general", "weather|temperature|news|sports?|recipe"), ("advice", "(career|health|financial) advice|diagnosis"), ("jailbreak", "ignore (previous|all) instructions|pretend to be"), ("market", "forecast|outlook|sentiment")]
WHOLE = lambda p: rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])')"


BLANK = r"coalesce(not regexp_matches(text, '[^\s\p{Z}]'), true)"


@query(f"""select doc_id, not ({BLANK} or c <> 'none') as allowed, case when {BLANK} then 'none' else c end as category, case when {BLANK} or c <> 'none' then 0.9 else 0.7 end as confidence
from (select doc_id, text, case {' '.join(f"when {WHOLE(p)} then '{c}'" for c, p in GATE)} else 'none' end as c from documents)""")
def f04_rule_gate(spark: SparkSession, d: str) -> DataFrame:
    allowed, category, confidence = rules.gate(F.col("text"), GATE)
    return table(spark, d, "documents").select("doc_id", allowed.alias("allowed"), category.alias("category"), confidence.alias("confidence"))


SCOPE = ["loss surface", "tokenizer", "decision tree", "random forest", "weekly inflow"]


@query(f"select doc_id, list_filter({sorted(SCOPE)}, lambda k: contains(lower(text), k))[1] as keyword from documents where text is not null")
def f07_keyword_scope(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", rules.scope(F.col("text"), SCOPE).alias("keyword"))


@query("""with m as (select request_id, url, case when status >= 500 then 'HTTPError' else 'Other' end as kind, 'status ' || coalesce(status::varchar, '') as message from network_requests where status is null or status <> 200)
select request_id, case when kind = 'HTTPError' then case when contains(message, '429') then 'rate_limit' when contains(message, '403') then 'bot_detection' when contains(message, '401') then 'auth' else 'network' end
when contains(message, '401') then 'auth' when contains(message, '429') then 'rate_limit' when contains(message, '403') then 'bot_detection' else 'unknown' end as class from m""")
def f16_error_class(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "network_requests").where("status is null or status <> 200")
    kind = F.when(F.col("status") >= 500, "HTTPError").otherwise("Other")
    return r.select("request_id", rules.classify_error(kind, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("")))).alias("class"))


QV = "select vec_id as q, embedding::double[] as v from embeddings where label = 0 order by vec_id limit 5"


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label = 0").orderBy("vec_id").limit(5).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))


VECTOR = f"""with qs as ({QV}), s as (select q as query, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, qs) select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from s"""


@query(f"select * from ({VECTOR}) where rank <= 10")
def v01_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vectors(spark, d), "q", "v", 10)


@query("""with qs as (select vec_id as q, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select q as query, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, qs)
select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from s qualify rank <= 10""")
def v01_knn_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.knn_blocks(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", "score", "rank")


QUESTIONS = [(1, "gradient descent learning rate"), (2, "weekly inflow revision"), (3, "decision boundary small training sets")]


def _bm25_sql() -> str:
    qs = ", ".join(str(q) for q in QUESTIONS)
    return f"""with qs as (select * from (values {qs}) t(query, q)), qt as (select distinct query, unnest(string_split(q, ' ')) as term from qs), t as (select doc_id, {words("coalesce(text, '')")} as w from documents),
dl as (select doc_id, len(w) as dl from t where len(w) > 0), st as (select count(*) as n, avg(dl) as a from dl), p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from t) group by 1, 2),
df as (select term, count(*) as df from p group by 1)
select query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a)))), 6) as score from qt join p using (term) join df using (term) join dl using (doc_id), st group by 1, 2"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    qs = spark.createDataFrame(QUESTIONS, "q int, question string")
    return search.bm25(table(spark, d, "documents"), "doc_id", {"content": ("text", 1.0)}, qs, "q", "question")


@query(f"select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as rank from ({_bm25_sql()}) qualify rank <= 10")
def v02_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(_bm25(spark, d), "doc_id", 10)


@query(f"""with k as (select query, doc_id as id, score from (select *, row_number() over (partition by query order by score desc, doc_id) as r from ({_bm25_sql()})) where r <= 50),
qs as (select row_number() over (order by vec_id) as query, embedding::double[] as v from (select * from embeddings where label = 0 order by vec_id limit 3)),
ve as (select query, vec_id as id, score from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as r from (select query, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, qs)) where r <= 50),
kn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from k window w as (partition by query)),
vn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from ve window w as (partition by query)),
f as (select query, id, round((0.7 * coalesce(vn.s, 0) + 0.3 * coalesce(kn.s, 0)) / 1.0, 6) as score from vn full join kn using (query, id))
select query, id, score, row_number() over (partition by query order by score desc, id) as rank from f qualify rank <= 10""")
def v03_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    k = search.top(_bm25(spark, d), "doc_id", 50).withColumnRenamed("doc_id", "id").drop("rank")
    e = table(spark, d, "embeddings")
    three = e.where("label = 0").orderBy("vec_id").limit(3)
    qs = three.select(F.row_number().over(Window.orderBy("vec_id")).alias("q"), F.col("embedding").alias("v"))  # three rows
    v = search.vector_topk(e, "vec_id", "embedding", qs, "q", "v", 50).withColumnRenamed("vec_id", "id").drop("rank")
    return search.top(search.fuse(v, k, "id"), "id", 10).select("query", "id", "score", "rank")


@query("""with v as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) as term from documents), q as (select unnest(['gradeint', 'wekly', 'inflw', 'surfce']) as query_term)
select query_term, term, levenshtein(term, query_term) as edits from v, q where abs(length(term) - length(query_term)) <= case when length(query_term) <= 2 then 0 when length(query_term) <= 5 then 1 else 2 end
and levenshtein(term, query_term) <= case when length(query_term) <= 2 then 0 when length(query_term) <= 5 then 1 else 2 end""")
def v05_fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    vocab = table(spark, d, "documents").select(F.explode(tx.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return search.fuzzy_terms(vocab, spark.createDataFrame([("gradeint",), ("wekly",), ("inflw",), ("surfce",)], "term string"))


@query(f"select * from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from (select query, vec_id, score from ({VECTOR}) join embeddings using (vec_id) where label in (1, 2))) where rank <= 10")
def v06_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    corpus = search.metadata_filter(table(spark, d, "embeddings"), {}, {"label": [1, 2]})
    return search.vector_topk(corpus, "vec_id", "embedding", _query_vectors(spark, d), "q", "v", 10)


TWENTIETHS = "select a.vec_id as query, b.vec_id, round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6) as score, b.label from embeddings a, embeddings b where a.vec_id % 20 = 0"


@query(f"select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from ({TWENTIETHS}) where label in (1, 2) qualify rank <= 10")
def v06_filtered_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows that pass the filter."""
    e = table(spark, d, "embeddings")
    corpus = search.metadata_filter(e, {}, {"label": [1, 2]})
    return search.knn_blocks(corpus, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", "score", "rank")


@query(f"""with k as (select query as question, doc_id as id, score from (select *, row_number() over (partition by query order by score desc, doc_id) as r from ({_bm25_sql()})) where r <= 50),
kq as (select vec_id as query, id, score from embeddings join k on question = (vec_id // 20) % {len(QUESTIONS)} + 1 where vec_id % 20 = 0),
ve as (select query, vec_id as id, score from (select *, row_number() over (partition by query order by score desc, vec_id) as r from ({TWENTIETHS})) where r <= 50),
kn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from kq window w as (partition by query)),
vn as (select query, id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from ve window w as (partition by query)),
f as (select query, id, round(0.7 * coalesce(vn.s, 0) + 0.3 * coalesce(kn.s, 0), 6) as score from vn full join kn using (query, id))
select query, id, score, row_number() over (partition by query order by score desc, id) as rank from f qualify rank <= 10""")
def v03_hybrid_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows, fused with the keyword hits of one of the questions in turn."""
    e = table(spark, d, "embeddings")
    qs = e.where("vec_id % 20 = 0")
    k = search.top(_bm25(spark, d), "doc_id", 50).select(F.col("query").alias("question"), F.col("doc_id").alias("id"), "score")
    asked = qs.select(F.col("vec_id").alias("query"), (F.pmod(F.floor(F.col("vec_id") / 20), F.lit(len(QUESTIONS))) + 1).cast("int").alias("question"))
    v = search.knn_blocks(e, "vec_id", "embedding", qs, "vec_id", "embedding", 50).withColumnRenamed("vec_id", "id").drop("rank")
    return search.top(search.fuse(v, asked.join(k, "question").select("query", "id", "score"), "id"), "id", 10).select("query", "id", "score", "rank")


_SAME = "len(list_intersect(y.ws, x.ws))"


@query(f"""with h as (select module_name, result_id, list_distinct({words("coalesce(text, '')")}) as ws, score from search_chunks where module_name is not null and score is not null),
o as (select module_name, list({{'k': result_id, 'ws': ws}} order by score desc, result_id) as l from h group by 1),
r as (select module_name, list_reduce(l, lambda a, x: case when len(a) < 10 and len(list_filter(a, lambda y: {_SAME} >= 0.85 * greatest(1, len(y.ws) + len(x.ws) - {_SAME}))) = 0 then a || [x] else a end, []::struct(k bigint, ws varchar[])[]) as s from o)
select module_name, unnest(list_transform(s, lambda x: x.k)) as result_id, generate_subscripts(s, 1) as rank from r""")
def d10_greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_chunks").where("module_name is not null and score is not null")
    return search.greedy_selection(h, "module_name", "result_id", "text", "score")


# ---- the screener's records

REC = """select record_id, stream_id, file_no, json_extract_string(p, '$.block_id') as block, p from (select *, case when json_valid(payload) then payload end as p from screener_records) where p is not null"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "screener_records").select("record_id", "stream_id", "file_no", F.try_parse_json("payload").alias("v")).where("v is not null")
    return r.withColumn("block", F.try_variant_get("v", "$.block_id", "string"))


@query(rf"""select record_id, nullif(regexp_extract(block, '^(t\d+_r\d+_c\d+)_', 1), '') as cell, try_cast(nullif(regexp_extract(block, '(?:^|_)p(\d+)_r\d+$', 1), '') as int) as para,
try_cast(nullif(regexp_extract(block, '_r(\d+)$', 1), '') as int) as run from ({REC}) where block is not null""")
def w07_block_parts(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where("block is not null").select("record_id", screener.block_parts(F.col("block")).alias("b"))
    return r.select("record_id", "b.cell", "b.para", "b.run")


@query(rf"""with b as (select record_id, stream_id, file_no, block, coalesce(nullif(regexp_extract(block, '^(t\d+_r\d+_c\d+)_', 1), ''), '') as cell, try_cast(nullif(regexp_extract(block, '(?:^|_)p(\d+)_r\d+$', 1), '') as int) as para,
try_cast(nullif(regexp_extract(block, '_r(\d+)$', 1), '') as int) as run from ({REC}) where block is not null), o as (select *, row_number() over (partition by stream_id, file_no, cell order by para nulls first, run nulls first, block, record_id) as nr from b),
l as (select *, case when (para = lag(para) over w and run - lag(run) over w <= 1) or para - lag(para) over w = 1 then 0 else 1 end as new from o window w as (partition by stream_id, file_no, cell order by nr)),
i as (select *, sum(new) over (partition by stream_id, file_no, cell order by nr) as island from l) select stream_id, file_no, cell, island, count(*) as n from i group by all""")
def w07_islands(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where("block is not null").select("record_id", "stream_id", "file_no", "block")
    return screener.islands(r, ["stream_id", "file_no"], "block").groupBy("stream_id", "file_no", "cell", "island").agg(F.count("*").alias("n"))


CHECKED = """select record_id, stream_id, list_filter([case when json_extract_string(p, '$.observed.font') <> json_extract_string(p, '$.expected.font') then 'font_mismatch' end,
case when abs(try_cast(json_extract_string(p, '$.observed.size') as double) - try_cast(json_extract_string(p, '$.expected.size') as double)) > 0.1 then 'size_mismatch' end,
case when json_extract_string(p, '$.observed.bold') <> json_extract_string(p, '$.expected.bold') then 'bold_mismatch' end, case when json_extract_string(p, '$.observed.italic') <> json_extract_string(p, '$.expected.italic') then 'italic_mismatch' end,
case when json_extract_string(p, '$.observed.underline') <> json_extract_string(p, '$.expected.underline') then 'underline_mismatch' end,
case when lower(json_extract_string(p, '$.observed.color')) <> lower(json_extract_string(p, '$.expected.color')) then 'color_mismatch' end], lambda x: x is not null) as v from (""" + REC + ")"


def _checked(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "screener_records").where(F.try_parse_json("payload").isNotNull())
    get = lambda side: {a: F.get_json_object("payload", f"$.{side}.{a}") for a in screener.ATTRIBUTES}
    o, e = get("observed"), get("expected")
    for x in (o, e):
        x["size"] = x["size"].try_cast("double")
    return r.select("record_id", "stream_id", screener.violations(o, e).alias("v"))


@query(f"select record_id, array_to_string(v, ',') as violations from ({CHECKED})")
def x21_rule_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("record_id", F.array_join("v", ",").alias("violations"))


@query(f"""select stream_id, array_to_string(list_sort(list_distinct(v)), ',') as signature, min(record_id) as record_id, count(*) - 1 as more,
case when count(*) - 1 = 0 then '' else '(' || (count(*) - 1) || ' more similar error' || case when count(*) - 1 > 1 then 's' else '' end || ' found)' end as comment from ({CHECKED}) where len(v) > 0 group by 1, 2""")
def a32_signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = screener.by_signature(_checked(spark, d), ["stream_id"], "v", "record_id", ["record_id"])
    return s.withColumn("comment", screener.more_comment(F.col("more")))


@query(f"select count(*) as total, count(*) filter (len(v) = 0) as passed, count(*) filter (len(v) > 0) as failed, round(100.0 * count(*) filter (len(v) = 0) / count(*), 2) as pass_rate from ({CHECKED})")
def a33_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return screener.pass_rate(_checked(spark, d), F.size("v") == 0)


@query(f"""with i as (select stream_id, record_id, unnest(v) as violation from ({CHECKED})) select stream_id, violation, count(*) as n, min(record_id) as first_record from i group by 1, 2""")
def a31_violation_counts(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("stream_id", "record_id", F.explode("v").alias("violation")).groupBy("stream_id", "violation").agg(F.count("*").alias("n"), F.min("record_id").alias("first_record"))


@query("""select result_id, case when length(section_title) > 20 then left(section_title, 20) || '...' else section_title end as preview from search_chunks""")
def x22_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").select("result_id", tx.preview(F.col("section_title"), 20).alias("preview"))
