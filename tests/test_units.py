"""Chunks, near duplicates, checks, shapes, guards and cells on small tables, against brute force where there is one."""

import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import session
from fathom.functions import numbers, web
from fathom.functions import text as tx
from fathom.operators import chunking, citations, dedup, quality, rules, screener, search
from fathom.plans import units
from fathom.sources import files, html, shapes
from fathom.streaming import incremental


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


# ---- near duplicates


def grams(t):
    t = " ".join((t or "").lower().split())
    return frozenset(t[i : i + 3] for i in range(len(t) - 2)) or frozenset([t])


def texts(n=60, seed=3):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        if i and r.random() < 0.6:
            w = out[r.choice(list(out))].split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"w{r.randrange(99)}"
        else:
            w = [f"w{r.randrange(99)}" for _ in range(r.choice([1, 8, 40, 120]))]
        out[i] = " ".join(w)
    return out


def frame(spark, ts):
    return spark.createDataFrame([(k, t, "s", 1) for k, t in ts.items()], "id long, text string, s string, rep int")


@pytest.mark.parametrize("most_sent", [4_000_000, 0])
def test_near_texts_are_all_pairs_of_sets(spark, most_sent):
    ts = texts() | {900: None, 901: "", 902: "ab"}
    sets = {}
    for k in sorted(ts):
        sets.setdefault(grams(ts[k]), k)
    want = {(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) / len(x | y) >= 0.7}
    members, pairs = dedup.near_texts(frame(spark, ts), "id", "text", 0.7, most_sent=most_sent)
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.k: r.rep for r in members.collect()} == {k: sets[grams(t)] for k, t in ts.items()}
    assert [x.count() for x in dedup.near_texts(frame(spark, ts).limit(0), "id", "text")] == [0, 0]


def test_sets_as_near_as_the_limit_share_a_projection():
    r = random.Random(8)
    for _ in range(300):
        a = "".join(r.choice("abcdefghij") for _ in range(r.choice([5, 30, 200, 900])))
        b = list(a)
        for _ in range(r.randint(0, max(1, len(a) // 60))):
            b[r.randrange(len(b))] = r.choice("xyz")
        g = dedup.Grams([a, "".join(b) + "q" * r.randint(0, 2)], 3)
        x, y = (set(g.h[g.doc == i].tolist()) for i in (0, 1))
        for limit in (0.9, 0.92, 0.97):
            if len(x & y) >= limit * len(x | y):
                doc, key = dedup.projections(g, limit)
                assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()), (a, b, limit)


def test_no_join_of_near_duplicates_is_broadcast(spark):
    """By the planner's guess, an array takes a few bytes: a table of them was sent to the driver."""
    ts = texts(40, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for pairs in (dedup.near_texts(frame(spark, ts), "id", "text")[1], dedup.lsh_pairs(frame(spark, ts), "id", "text")[1], dedup.two_stages(frame(spark, ts), "id", "text"), dedup.stage_stats(dedup.two_stages(frame(spark, ts), "id", "text"))):
            pairs.collect()
            assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_step_before_the_pairs_is_broadcast(spark, monkeypatch):
    """The joins behind a checkpoint have plans of their own."""
    plans, cut = [], dedup.cut_lineage

    def kept(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(dedup, "cut_lineage", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        dedup.lsh_pairs(frame(spark, texts(40, 5)), "id", "text")
        dedup.two_stages(frame(spark, texts(40, 5)), "id", "text")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_sets_of_a_pair_are_made_once(spark):
    """A function in a column was called in one Python process for the limit and in a second one for the value."""
    for pairs in (dedup.lsh_pairs(frame(spark, texts(40, 5)), "id", "text")[1], dedup.near_texts(frame(spark, texts(40, 5)), "id", "text")[1]):
        above = pairs._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]
        assert sum(above.count(x) for x in ("MapInArrow", "EvalPython")) == 1


def test_long_texts_are_verified_in_groups(spark):
    """Pairs are verified up to a number of characters at a time; a pair above it stands alone."""
    r = random.Random(4)
    ts = {i: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(2000)) for i in range(6)}
    ts |= {i + 10: t + "ä" * 3 for i, t in ts.items()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dedup, "CHARS", 1000)  # goes to the workers with the function
        pairs = dedup.lsh_pairs(frame(spark, ts), "id", "text")[1].collect()
    assert {(x.a, x.b) for x in pairs} <= {(i, i + 10) for i in range(6)} and len(pairs) >= 3
    for x in pairs:
        a, b = grams(ts[x.a]), grams(ts[x.b])
        assert abs(x.similarity - len(a & b) / len(a | b)) < 1e-12


def test_keys_travel_short_and_in_few_parts(spark):
    """12 bytes a key, and no more parts than its keys need, however many partitions shuffles have."""
    docs = dedup._normal(frame(spark, texts(40, 5)), "id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert dedup._parts(dedup._sets(docs, 3)[2], 0.1, 2) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    rows = dedup._entries(docs, 3, 7, lambda g: dedup.projections(g, 0.92)).collect()
    assert rows and all(len(r.h) // 4 == len(r.f) // 8 for r in rows)


def test_signatures_estimate_and_bands_find(spark):
    ts = texts(40, 9)
    got = {r.id: (list(r.signature), r.fingerprint) for r in dedup.minhash(frame(spark, ts), "id", "text").collect()}
    for a, b in zip(list(ts), list(ts)[1:]):
        x, y = grams(ts[a]), grams(ts[b])
        same = np.mean(np.array(got[a][0]) == np.array(got[b][0]))
        assert abs(same - len(x & y) / len(x | y)) < 0.2 and len(got[a][1]) == 128
    assert [dedup.lsh_bands(t) for t in (0.5, 0.8, 0.92)] == [(25, 5), (9, 13), (4, 29)]
    found = {(r.a, r.b) for r in dedup.lsh_pairs(frame(spark, ts), "id", "text", 0.8)[1].collect()}
    exact = {(r.a, r.b) for r in dedup.near_texts(frame(spark, ts), "id", "text", 0.8)[1].collect()}
    assert found <= exact and len(found) >= 0.7 * len(exact)
    assert one(spark, dedup.signature_similarity(F.lit([1, 2, 3, 4]), F.lit([1, 9, 3, 8]))).c0 == 0.5


def test_two_stages_and_their_toggles(spark):
    long = "the survey panel confirms the seasonal pattern for the pilot group of the year " * 3
    ts = {1: long, 2: long.upper(), 3: long + "x", 4: "something else entirely", 5: None, 6: None}
    df = frame(spark, ts)
    stages = lambda **kw: {r.id: (r.stage, r.canonical) for r in dedup.two_stages(df, "id", "text", **kw).collect()}
    assert stages() == {1: ("unique", 1), 2: ("exact", 1), 3: ("near", 1), 4: ("unique", 4), 5: ("unique", 5), 6: ("exact", 5)}
    assert stages(near=False)[3] == ("unique", 3) and stages(exact=False)[2] == ("near", 1)
    assert set(stages(exact=False, near=False).values()) == {("unique", i) for i in ts}
    s = dedup.stage_stats(dedup.two_stages(df, "id", "text")).first()
    assert (s.total, s.exact_removed, s.near_removed, s.kept, s.removal_pct) == (6, 2, 1, 3, 50.0)
    assert dedup.stage_stats(dedup.two_stages(df.limit(0), "id", "text")).first().total == 0


# ---- chunks


def test_recursive_pieces_keep_limit_order_and_words():
    r = random.Random(2)
    for _ in range(40):
        t = "".join(f"w{i}" + r.choice([" ", f" and{i} ", "\n", "\n\n", "x" * r.randint(1, 90)]) for i in range(r.randint(0, 200)))
        ps = chunking.recursive_pieces(t, 100, 20)
        assert all(0 < len(p) <= 100 for p in ps)
        at = 0
        for p in ps:  # the pieces cover the text in order, blanks apart
            found = t.find(p, max(0, at - 100))
            assert found >= 0 and t[at:found].strip() == ""
            at = max(at, found + len(p))
        assert t[at:].strip() == ""
        assert "".join(t.split()) == "" or ps
    assert chunking.recursive_pieces("a b", 100) == ["a b"] and chunking.recursive_pieces("") == []
    assert chunking.recursive_pieces("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert chunking.recursive_pieces("aaa\n\nbbb\n\nccc", 7, 0) == ["aaa", "bbb", "ccc"]


def test_unit_chunks(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"t{i}" for i in range(25))), (3, "  \n "), (4, None)], "id long, text string")
    got = {}
    for r in chunking.unit_chunks(df, ["id"], "text", 10, 2).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.chunk, r.token_count, r.position))
    assert got[1] == [("a b c", 3, "only")] and [n for _, n, _ in got[2]] == [10, 10, 9] and [p for _, _, p in got[2]] == ["beginning", "middle", "end"] and set(got) == {1, 2}
    assert {r.chunked_as for r in chunking.routed_chunks(df.withColumn("kind", F.lit("PDF")), ["id"], "kind", "text").collect()} == {"pages"}
    assert chunking.routed_chunks(df.withColumn("kind", F.lit("zip")), ["id"], "kind", "text").count() == 0


def test_long_paragraphs_are_cut(spark):
    df = spark.createDataFrame([(1, "short one\n\n" + "y" * 100 + "\n\nlast"), (2, None)], "id long, text string")
    got = [r.chunk for r in chunking.pack_paragraphs(df, "id", "text", 10, 2).orderBy("chunk_index").collect()]
    assert got == ["short one", "y" * 40, "y" * 40, "y" * 36, "last"]


def test_sections_and_slides(spark):
    r = one(
        spark, chunking.section_text(F.lit(0), F.lit("T"), F.lit(["list", "quote", "p"]), F.lit([2, 0, 0]), F.array(F.lit("a"), F.lit("b"), F.lit(None))),
        chunking.section_of(F.lit([10.0, 20.0]), F.lit([False, False]), F.lit(["no", " Big "])), chunking.section_of(F.lit([10.0]), F.lit([True]), F.lit(["x" * 100])),
        chunking.full_text(F.lit("A"), F.lit(" "), F.lit(None).cast("string"), F.lit(["t1", "t2"])),
    )
    assert (r.c0, r.c1, r.c2, r.c3) == ("# T\n\n    • a\n\n> b", "Big", None, "A\n\nTable 1: t1\n\nTable 2: t2")


# ---- checks


def test_quartiles_are_exact(spark):
    r = random.Random(1)
    for values in ([], [5.0], [1.0, 2.0], [3.0] * 50, [r.gauss(0, 1) for _ in range(20_001)], [float(r.randint(0, 3)) for _ in range(777)] + [None, float("nan")]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        clean = [v for v in values if v is not None and v == v]
        want = tuple(np.percentile(clean, [25, 75])) if clean else (None, None)
        for few in (50_000, 1_000):
            got = quality.exact_quartiles(df, ["v"], few)[0]
            assert got == want if not clean else np.allclose(got, want, atol=1e-9), (values[:3], few)


def test_validate_has_all_checks(spark):
    rows = [(i % 2, f"20{10 + i % 12}-01-01", float(i % 7), -5.0 if i == 3 else 2000.0 if i == 4 else 5.0, 0.0) for i in range(40)] + [(1, "1990-01-01", None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "s int, d string, price double, pct double, volume double").withColumn("d", F.to_date("d"))
    got = {(r.check, r.column, r.severity) for r in quality.validate(df, ["price", "pct", "volume"], ["s", "d"], "d", "2020-01-01", max_rows=10, required=["price", "cost"], percents=["pct"], volumes=["volume"], prices=["price"], series="s").collect()}
    want = {("negative", "pct", "warning"), ("percent range", "pct", "warning"), ("zero volumes", "volume", "warning"), ("missing column", "cost", "error"), ("too many rows", None, "warning"), ("future dates", "d", "warning"), ("early dates", "d", "warning"), ("date gaps", "d", "warning"), ("jumps", "price", "warning")}
    assert want <= got
    assert {r.check for r in quality.validate(df.limit(0), ["price"], ["s"], "d", "2020-01-01").collect()} == {"too few rows"}
    assert quality.empty_frame(spark, {"a": "int", "b c": "string"}).columns == ["a", "b c"]


# ---- shapes, guards and cells


def test_shapes_and_strategies(spark):
    docs = ["{}", "[]", "[1]", "[[1]]", '[{"a":1}]', "5", "{", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, doc string")
    assert [r.s for r in df.select("i", shapes.json_shape(F.col("doc")).alias("s")).orderBy("i").collect()] == ["object", "empty_array", "array_of_values", "array_of_arrays", "array_of_objects", "value", "invalid", "invalid"]
    bodies = {'{"a": 1}': "api", "<html><script>var x = {1}</script>": "embedded", "<p><TABLE></table>": "table", "a;b\n1;2": "csv", "<?xml version='1'?><r/>": "xml", "words only": None, "": None}
    df = spark.createDataFrame(list(bodies.items()), "body string, want string")
    assert df.where(~shapes.strategy(F.col("body")).eqNullSafe(F.col("want"))).count() == 0
    found = {"x ```json\n{\"a\": 1}\n``` y": '{"a": 1}', "so {\"b\": {\"c\": 2}} it is": '{"b": {"c": 2}}', "none {here": None, "{broken: }}": None}
    df = spark.createDataFrame(list(found.items()), "t string, want string")
    assert df.where(~shapes.extract_json(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_picks_sheets_and_registries(spark):
    df = spark.createDataFrame([(3, 9.0, "x")], "total_n int, big double, note string")
    assert df.select(shapes.picked_value(df, ["total"]), shapes.picked_value(df, ["none"])).first() == (3.0, 9.0)
    sheet = spark.createDataFrame([(0, ["title"]), (1, ["DATE ", "v"]), (2, ["2020", "1"]), (3, ["", "2"])], "nr int, cells array<string>")
    assert [tuple(r) for r in shapes.sheet_table(sheet, "nr", "cells", {"day": "Date", "value": "V"}).collect()] == [("2020", "1")]
    reg = spark.createDataFrame([("a", "u", "daily"), ("b", " ", "odd"), ("b", None, None)], "k string, url string, cadence string")
    got = sorted((r.k, r.finding) for r in shapes.registry_findings(reg, "k", ["url"], {"cadence": ["daily"]}).collect())
    assert got == [("b", "cadence unknown"), ("b", "key repeated"), ("b", "url missing"), ("b", "url missing")]
    both, errors = shapes.union_or_errors({"x": reg.select("k"), "y": ValueError("gone")}, "tag")
    assert both.count() == 3 and errors == "y: gone" and shapes.union_or_errors({}, "tag") == (None, "")


@pytest.mark.parametrize(
    ("kind", "message", "want"),
    [
        ("ConnectionError", "HTTP 429", "rate_limit"), ("HTTPError", "403", "bot_detection"), ("Timeout", "", "network"), ("X", "Unauthorized", "auth"), ("X", "Too Many Requests", "rate_limit"),
        ("X", "captcha", "bot_detection"), ("X", "timeout of the query", "rate_limit"), ("X", "selector not found", "parsing"), ("KeyError", "a", "parsing"), ("X", "invalid", "validation"), ("X", None, "unknown"), (None, "", "unknown"),
    ],
)
def test_error_classes(spark, kind, message, want):
    assert one(spark, rules.classify_error(F.lit(kind).cast("string"), F.lit(message).cast("string"))).c0 == want


def test_guards(spark):
    null = F.lit(None)
    passed, reasons = rules.guarded({"a": F.lit(True), "b": null.cast("boolean"), "c": F.lit(False), "d": F.lit(False)})
    r = one(spark, passed, reasons, rules.grounding(F.lit("the big model"), F.lit("a big one")), rules.grounding(F.lit("x"), null.cast("string")), rules.reply(F.lit("q"), {"p": "1"}, "?"), rules.reply(null.cast("string"), {"p": "1"}, "?"), rules.scope_verdict(null.cast("double")))
    assert tuple(r) == (False, "c; d", 0.5, None, "?", None, "out_of_scope")


def test_cells_and_names(spark):
    cells = ["1,200", "$1.5M", "12%", "n/a", "1.2T", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    n, t = numbers.converted(F.col("c"))
    assert [(r.n, r.t) for r in df.select("i", n.alias("n"), t.alias("t")).orderBy("i").collect()] == [(1200.0, None), (1.5e6, None), (12.0, None), (None, "n/a"), (None, "1.2T"), (None, None)]
    r = one(spark, tx.clean_name(F.lit(" A - b%c ")), tx.clean_name(F.lit("%%")), tx.printable(F.lit("a\u0007  b")), numbers.is_numeric_cell(F.lit("1,5x")), web.folder_module(F.lit("data/Week 3/a.pdf")))
    assert tuple(r) == ("a_b_c", "column", "a b", False, "Week 3")
    r = one(spark, citations.sources_of(F.lit("Source: [A | Week 1 | f.pdf] y Source: [B | g.pdf]")), screener.merged_text(F.lit(["a", "b"])))
    assert (list(r.c0), r.c1) == (["A | Week 1 | f.pdf", "B | g.pdf"], "a\nb")


# ---- search, files, streams, session


def test_blocks_of_queries_find_the_nearest(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(70, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    want = {(q, int(k)) for q in range(0, 70, 7) for k in np.lexsort((np.arange(70), -s[q]))[:3]}
    for block, stripes in ((2000, None), (3, 4), (1, 1)):
        got = search.knn_blocks(df, "id", "v", df.where("id % 7 = 0"), "id", "v", 3, block, stripes).collect()
        assert {(x["query"], x["id"]) for x in got} == want
    assert search.knn_blocks(df.limit(0), "id", "v", df, "id", "v").count() == 0


def test_many_query_terms_score_alike(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i} w{i % 7}") for i in range(300)] + [(900, None), (901, "")], "id long, text string")
    few = spark.createDataFrame([(1, "alpha w3"), (2, "w5 w6")], "q int, t string")
    many = few.unionByName(spark.createDataFrame([(3, " ".join(f"x{i}" for i in range(300)))], "q int, t string"))
    score = lambda qs: {(r["query"], r["id"]): r["score"] for r in search.bm25(docs, "id", {"c": ("text", 1.0)}, qs, "q", "t").collect()}
    assert score(few) == score(many) and len(score(few)) > 300
    assert search.bm25(docs, "id", {"c": ("text", 1.0)}, few.limit(0), "q", "t").count() == 0
    fuzzy = search.with_fuzzy_terms(spark.createDataFrame([(1, "alpho"), (2, "zz")], "q int, t string"), "q", "t", docs.select(F.explode(tx.tokens(F.col("text"))).alias("term")))
    assert {r.q: r.t for r in fuzzy.collect()} == {1: "alpho alpha", 2: "zz"}


def test_files_and_streams(spark, tmp_path):
    files.save_raw(spark.createDataFrame([("a", "r1", "x")], "site string, run string, body string"), str(tmp_path / "raw"), "site", "run")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 1
    spark.createDataFrame([("A b", "2024-01-01 00:00:00"), ("a  B", "2024-01-01 00:10:00"), ("c", "2024-01-01 00:20:00")], "t string, at string").select("t", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, at timestamp").parquet(str(tmp_path / "in"))
    q = incremental.first_seen(stream, "t", "at").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


@pytest.mark.parametrize("folder", [True, False])
def test_a_table_of_one_file_or_a_folder_streams(spark, tmp_path, folder):
    rows = spark.createDataFrame([(2, "A b!"), (1, "a  b"), (3, "c"), (4, None)], "doc_id long, text string")
    path = tmp_path / "documents.parquet"
    if folder:
        rows.repartition(2).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    assert sorted(r.doc_id for r in units.r01_incremental(spark, str(tmp_path)).collect()) == [1, 3, 4]


def test_a_cluster_needs_a_shared_folder():
    none = types.SimpleNamespace(isDefined=lambda: False)
    sc = types.SimpleNamespace(_jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(types.SimpleNamespace(sparkContext=sc))


def test_selectors_of_pages():
    page = '<div class="card wide"><h2 id="t">Ti &amp; x</h2><br><p>Score <span class="v x">0.5</span></p></div><span class=v>0</span><a data-k="1" href=x>q</a>'
    pick = {s: html.selected(page, s) for s in (".card span.v", "span.v", "#t", "div p", "a[data-k=1]", "a[data-k=2]", "h3", "div")}
    assert pick == {".card span.v": ["0.5"], "span.v": ["0.5", "0"], "#t": ["Ti & x"], "div p": ["Score 0.5"], "a[data-k=1]": ["q"], "a[data-k=2]": [], "h3": [], "div": ["Ti & xScore 0.5"]}
    assert html.selected("<div><div>in</div> out</div>", "div") == ["in out", "in"] and html.selected(None, "a") == [] and html.selected("<b>open", "b") == []


def test_entities_and_phrases(spark):
    df = spark.createDataFrame([(1, "It rose 5 % on 2024-01-02, then 5 % and $1,200.50 for 12 weeks."), (2, None), (3, "")], "id long, text string")
    got = {r.id: [(e.text, e.label) for e in r.e] for r in df.select("id", rules.entities(F.col("text")).alias("e")).collect()}
    assert got == {1: [("5 %", "PERCENT"), ("$1,200.50", "MONEY"), ("2024-01-02", "DATE"), ("12 weeks", "QUANTITY")], 2: [], 3: []}
    docs = spark.createDataFrame([(1, "gradient descent on a gradient descent"), (2, "other words here"), (3, None)], "id long, text string")
    best = {r.id: r.phrase for r in rules.keyphrases(docs, "id", "text").where("rank = 1").collect()}
    assert best[1] == "gradient descent" and set(best) == {1, 2}


def test_series_bodies_and_signs(spark):
    r = one(spark, web.looks_like_series(F.lit('[{"date": 1, "v": 2}, {"date": 2}]')), web.looks_like_series(F.lit('{"date": 1}')), web.looks_like_series(F.lit(None).cast("string")))
    assert tuple(r) == (True, False, False)
    df = spark.createDataFrame([(-1.0, -1.0, -1.0, 1.0)], "net_inflow double, price double, other double, volume double")
    got = {(x.column, x.severity) for x in quality.negative_findings(quality.column_stats(df, df.columns)).collect()}
    assert got == {("price", "error"), ("other", "warning")}
