"""Vector, keyword and hybrid search over tables: exact cosine, BM25 over a postings table, weighted fusion, fuzzy terms.

Query sets are small (a search asks a handful of questions), and their number is checked before they are broadcast; the corpus side is
scanned once for all queries, and only the k best of each query per partition leave it (window group limit).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens
from fathom.session import cut_lineage

MAX_QUERIES = 10_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; null if one has no length."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _few(queries: DataFrame) -> DataFrame:
    n = queries.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one search; use knn_blocks")
    return F.broadcast(queries)


def vector_topk(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int = 10) -> DataFrame:
    """(query, key, score, rank): the k nearest by cosine, ties by key."""
    d = lambda c: F.col(c).cast("array<double>")
    norm = lambda c: F.sqrt(_dot(d(c), d(c)))
    q = _few(queries.select(F.col(query).alias("query"), d(query_vector).alias("_q"), norm(query_vector).alias("_nq")))
    c = corpus.select(F.col(key), d(vector).alias("_v"), norm(vector).alias("_nv"))
    score = F.try_divide(_dot(F.col("_v"), F.col("_q")), F.col("_nv") * F.col("_nq"))
    s = c.join(q, F.lit(True)).select("query", key, F.round(score, 6).alias("score")).where("score is not null")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(term, field, key, tf, dl): terms with their frequency and the length of the field. Texts are tokenised once; a text's terms are counted where it is."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("t")) for f, c in fields.items()]))
    toks = docs.select(F.col(key), each.alias("x")).select(key, "x.field", tokens(F.col("x.t")).alias("_w")).where(F.size("_w") > 0)
    return toks.select("field", key, F.size("_w").alias("dl"), F.explode("_w").alias("term")).groupBy("term", "field", key, "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, fields: dict[str, tuple[str, float]], queries: DataFrame, query: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score): best of the boosted fields, each the sum over the query's terms. Only terms of the queries are exploded and scored; the
    lengths of the fields come from the same tokens."""
    q = _few(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")))
    asked = sorted({r["term"] for r in q.select("term").distinct().collect()})  # of a checked number of queries
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("t")) for f, (c, _) in fields.items()]))
    toks = docs.select(F.col(key), each.alias("x")).select(key, "x.field", tokens(F.col("x.t")).alias("_w"))
    toks = toks.select(key, "field", F.size("_w").alias("dl"), "_w").where("dl > 0")
    if len(asked) <= 256:
        told = cut_lineage(toks.withColumn("_w", F.filter("_w", lambda w: w.isin(asked)) if asked else F.array().cast("array<string>")))
        each_term = told.select(key, "field", "dl", F.explode("_w").alias("term"))
    else:
        told = toks
        each_term = toks.select(key, "field", "dl", F.explode("_w").alias("term")).join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    stats = F.broadcast(told.groupBy("field").agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl")))  # a row per field
    p = each_term.groupBy("term", "field", key, "dl").agg(F.count("*").alias("tf"))
    df = F.broadcast(p.groupBy("term", "field").agg(F.count("*").alias("df")))  # a row per asked term and field
    j = p.join(df, ["term", "field"]).join(stats, "field").join(q, "term")
    idf = F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    boost = F.lit(1.0)
    for f, (_, w) in fields.items():
        boost = F.when(F.col("field") == f, F.lit(w)).otherwise(boost)
    per_field = j.groupBy("query", key, "field").agg(F.sum(idf * tf).alias("s")).withColumn("s", F.col("s") * boost)
    return per_field.groupBy("query", key).agg(F.round(F.max("s"), 6).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _min_max(s: DataFrame, name: str, key: str) -> DataFrame:
    w = Window.partitionBy("query")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return s.select("query", key, F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))


def fuse(vector: DataFrame, keyword: DataFrame, key: str, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(query, key, score) of two candidate lists: each scaled to 0..1 within its query, then the weighted mean; a missing side is 0."""
    j = _min_max(vector, "_v", key).join(_min_max(keyword, "_k", key), ["query", key], "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select("query", key, F.round((weights[0] * z("_v") + weights[1] * z("_k")) / sum(weights), 6).alias("score"))


def fuzzy_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_term, term, edits): vocabulary within 0, 1 or 2 edits for terms of up to 2, up to 5 and more characters. ``terms`` is a
    checked, small side; lengths are compared before edits are counted."""
    q = _few(terms.select(F.col("term").alias("query_term")).distinct())
    allowed = F.when(F.length("query_term") <= 2, 0).when(F.length("query_term") <= 5, 1).otherwise(2)
    near = F.abs(F.length("term") - F.length("query_term")) <= allowed
    j = vocabulary.select("term").distinct().join(q, near)
    return j.withColumn("edits", F.levenshtein("term", "query_term")).where(F.col("edits") <= allowed).select("query_term", "term", "edits")


def with_fuzzy_terms(queries: DataFrame, query: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """The queries with every term of the ``vocabulary`` (term) that one of theirs may mean by ``fuzzy_terms`` added to their text."""
    own = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    near = fuzzy_terms(vocabulary, own).select(F.col("query_term").alias("term"), F.col("term").alias("meant"))
    more = own.join(near, "term").groupBy("query").agg(F.array_sort(F.collect_set("meant")).alias("m"))
    out = queries.join(more, F.col(query) == F.col("query"), "left").select(F.col(query), F.concat_ws(" ", F.col(text), F.array_join("m", " ")).alias(text))
    return cut_lineage(out)  # a row a query


def metadata_filter(df: DataFrame, equal: dict[str, object], any_of: dict[str, list]) -> DataFrame:
    """Scalar values have to be equal, lists to share an element with an array or to contain a scalar."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    for c, vs in any_of.items():
        is_array = df.schema[c].dataType.typeName() == "array"
        df = df.where(F.arrays_overlap(c, F.array(*[F.lit(v) for v in vs])) if is_array else F.col(c).isin(vs))
    return df


def greedy_selection(hits: DataFrame, query: str, key: str, text: str, score: str, limit: float = 0.85, most: int = 10) -> DataFrame:
    """(query, key, rank): hits of each query in order of score, leaving out those too similar to one already taken. Of hits
    with equal word sets (of some words) only the best can be taken, so the others are left out first; the rest stream by score through one task a query,
    which holds no more than the taken ones, and goes on until ``most`` are taken or the hits end."""
    import pandas as pd

    words = F.array_sort(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))))
    cand = hits.select(F.col(query).alias("q"), F.col(key).alias("k"), F.col(score).alias("s"), words.alias("ws"))
    # Greatest score first, nulls last, ties by key.
    order = F.struct(F.col("s").isNull().alias("no"), (-F.col("s")).alias("minus"), F.col("k").alias("k"))
    firsts = cand.groupBy("q", "ws", F.when(F.size("ws") == 0, F.col("k"))).agg(F.min(order).alias("o")).select("q", "o.no", "o.minus", "o.k", "ws")
    ordered = firsts.repartition("q").sortWithinPartitions("q", "no", "minus", "k").select("q", "k", "ws")

    def take(batches):  # noqa: ANN001, ANN202
        now, kept = object(), []
        for b in batches:
            rows = []
            for q, k, ws in zip(b["q"], b["k"], b["ws"]):
                q = None if pd.isna(q) else q
                if q != now:
                    now, kept = q, []
                if len(kept) >= most:
                    continue
                w = set(ws)
                if not any(len(w & o) >= limit * max(1, len(w | o)) for o in kept):
                    kept.append(w)
                    rows.append((q, k, len(kept)))
            yield pd.DataFrame(rows, columns=[query, key, "rank"])

    t = lambda c: hits.schema[c].dataType.simpleString()
    return ordered.mapInPandas(take, f"{query} {t(query)}, {key} {t(key)}, rank int")


def knn_blocks(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int = 10, block: int = 20_000, stripes: int | None = None) -> DataFrame:
    """Like ``vector_topk`` for query sets of any size, as matrix products of Arrow batches of which the k best of each query are kept. A set of up to
    ``block`` queries is broadcast and the corpus stays where it is; a larger one is cut into blocks that meet stripes of the corpus in executors,
    each pair of them in a task: no vector passes the driver then, and the corpus goes over the network once for each block."""
    import numpy as np
    import pandas as pd

    kinds = queries.schema[query].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    vec = lambda c: F.col(c).cast("array<double>").alias("v")
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).alias("q"), vec(query_vector))
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), vec(vector))
    columns = f"query {kinds[0]}, {key} {kinds[1]}, score double"

    def unit(vs):  # noqa: ANN001, ANN202
        m = np.stack([np.asarray(v) for v in vs])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(names, m, parts):  # noqa: ANN001, ANN202
        """The k best of each query over parts of (keys, unit vectors), a part at most so large that its scores take 80 MB."""
        top_s = top_k = None
        for keys, v in parts:
            step = max(k, 10_000_000 // len(names))
            for i in range(0, len(keys), step):
                s = np.round(m @ v[i : i + step].T, 6)
                ks = np.broadcast_to(keys[i : i + step], s.shape)
                if top_s is not None:
                    s, ks = np.concatenate((top_s, s), 1), np.concatenate((top_k, ks), 1)
                o = np.lexsort((ks, -s), axis=1)[:, :k]
                top_s, top_k = np.take_along_axis(s, o, 1), np.take_along_axis(ks, o, 1)
        if top_s is not None:
            yield pd.DataFrame({"query": np.repeat(np.array(names), top_s.shape[1]), key: top_k.ravel(), "score": top_s.ravel()})

    n = asked.limit(block + 1).count()
    if n == 0:
        return top(corpus.sparkSession.createDataFrame([], columns), key, k)
    if n <= block:
        few = asked.collect()
        held = corpus.sparkSession.sparkContext.broadcast(([r["q"] for r in few], unit([r["v"] for r in few])))

        def against_all(batches):  # noqa: ANN001, ANN202
            yield from best(*held.value, ((b["k"].to_numpy(), unit(b["v"])) for b in batches if len(b)))

        return top(rows.mapInPandas(against_all, columns), key, k)
    blocks = -(-asked.count() // block)
    stripes = stripes or max(1, corpus.sparkSession.sparkContext.defaultParallelism // blocks)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    left = asked.select(spread("q", blocks).alias("b"), every(stripes).alias("s"), F.lit(0).alias("side"), "q", none(kinds[1]).alias("k"), "v")
    right = rows.select(every(blocks).alias("b"), spread("k", stripes).alias("s"), F.lit(1).alias("side"), none(kinds[0]).alias("q"), "k", "v")
    both = left.unionByName(right).withColumn("_p", (F.col("b") * stripes + F.col("s")).cast("int")).repartitionById(blocks * stripes, "_p").sortWithinPartitions("side")

    def of_stripe(batches):  # noqa: ANN001, ANN202
        names, vs = [], []

        def parts(first):  # noqa: ANN001, ANN202
            for b in itertools.chain([first], batches):
                if len(b):
                    yield b["k"].to_numpy(), unit(b["v"])

        for b in batches:  # the queries come first
            mine, other = b[b["side"] == 0], b[b["side"] == 1]
            names += mine["q"].tolist()
            vs += mine["v"].tolist()
            if len(other) and names:
                yield from best(names, unit(vs), parts(other))
                return

    return top(both.select("side", "q", "k", "v").mapInPandas(of_stripe, columns), key, k)
