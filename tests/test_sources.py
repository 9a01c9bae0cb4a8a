import json

from pyspark.sql import functions as F

from fathom.functions import numbers
from fathom.operators import chunking, dedup, frames, quality, rules, screener, search
from fathom.sources import files, html, structured
from fathom.sources.observations import ObservationFiles
from fathom.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_numbers(spark):
    cases = {
        numbers.price: {"$1,234.50": 1234.5, "(1,200)": -1200.0, "€ 99": 99.0, "-$3": -3.0, "1.2B": None, "abc": None, "12d": None, None: None, "": None},
        numbers.percentage: {"12.5%": 12.5, "(3%)": -3.0, "-1,000%": -1000.0},
        numbers.number: {"1.2B": 1.2e9, "$3.5k": 3500.0, "2T": 2e12, "(500)": -500.0, "(1.2K)": None, "12%": None},
        numbers.ticker: {"NASDAQ:AAPL": "AAPL", "AAPL.NASDAQ": "AAPL", "BRK.B": "BRK", " btc-usd ": "BTCUSD", "---": None},
    }
    for f, table in cases.items():
        df = spark.createDataFrame([(k,) for k in table], "t string")
        assert [r[0] for r in df.select(f(F.col("t"))).collect()] == list(table.values()), f
    assert one(spark, numbers.amount(F.lit("–5M"))) is None and one(spark, numbers.amount(F.lit("–5M"), True)) == -5e6
    assert one(spark, numbers.in_millions(F.lit(1234567.0))) == "1.23M" and numbers.column_role("open_interest") == "price"


def test_csv(spark, tmp_path):
    assert structured.sniff_csv(["a,b", "1,2"]) == (",", True)
    assert structured.sniff_csv(["1,2", "3,4"]) == (",", False)
    assert structured.sniff_csv(["a,b", "x,y"]) == (",", False)
    assert structured.sniff_csv(["a;b;c,d", "1;2;3"])[0] == ";" and structured.sniff_csv([]) == (",", False)
    (tmp_path / "t.csv").write_text("The Date;Value (USD)\n2020-01-01;5\n2020-01-02;6\n")
    df = structured.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["the_date", "value_usd"] and df.count() == 2


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in structured.read_json(spark, str(tmp_path / "a.json"), "a int").collect() if r.a) == [1, 2]
    df = spark.createDataFrame([(1, json.dumps({"status": "ok", "data": {"series": [{"d": "x", "v": 1}, {"d": "y", "v": 2}]}}))], "k int, doc string")
    assert one(spark, structured.json_path(F.lit('{"a":{"b":[{"c":5}]}}'), "a.b[0].c")) == "5"
    s = structured.rows_of_objects(df, ["k"], structured.json_path(F.col("doc"), "data.series"), "d string, v int").collect()
    assert [(r.nr, r.d, r.v) for r in s] == [(0, "x", 1), (1, "y", 2)]
    arrays = spark.createDataFrame([(1, "[[1, 2], [3]]")], "k int, doc string")
    assert [(r.a, r.b) for r in structured.rows_of_arrays(arrays, ["k"], F.col("doc"), ["a", "b"]).collect()] == [("1", "2"), ("3", None)]
    flat = {r.name: r.value for r in structured.flat_fields(df, ["k"], F.col("doc")).collect()}
    assert flat["status"] == "ok" and "data_series" in flat
    nested = spark.createDataFrame([(1, (2, [3]))], "a int, b struct<c:int,d:array<int>>")
    assert structured.nested_arrays(nested.schema) == ["b.d"]
    assert structured.apply_mapping(nested, {"b.c": "x"}).columns == ["x", "a"]
    assert structured.resolve_column(["Date", "close_price"], "price") == "close_price" and structured.resolve_column(["a"], "zzz") is None


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item id='1'><v>5</v></item><item id='2'><v>6</v></item></r>")
    assert sorted((r._id, r.v) for r in structured.read_xml(spark, str(tmp_path / "a.xml"), "item").collect()) == [(1, 5), (2, 6)]
    assert one(spark, structured.xml_values(F.lit("<a><b>x</b><b>y</b></a>"), "a/b/text()")) == ["x", "y"]


def test_html(spark):
    page = "<p>x<table><tr><th>Date<th>Close<tr><td>2020</td><td>5</td></tr><tr><td colspan=2>6</tr></table><table><tr><td>a</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string")
    t = html.html_tables(df, ["k"], "h")
    assert sorted((r.k, r.table_no, r.row_no, r.header, r.cells) for r in t.collect()) == [(1, 0, 0, ["Date", "Close"], ["2020", "5"]), (1, 0, 1, ["Date", "Close"], ["6", "6"]), (1, 1, 0, ["Column_0"], ["a"])]
    assert [(r.k, r.table_no) for r in html.best_tables(t, ["k"], 1).collect()] == [(1, 0)]
    src = F.lit('<script>var chart = {"a": [1]};</script><div data-price="7">next</div><a href="?page=12">Next</a><a href="?page=3">')
    assert one(spark, html.embedded_json(src, "chart")) == '{"a": [1]}' and one(spark, html.data_attribute(src, "price")) == "7"
    assert one(spark, html.list_pages(src)).last_page == 12 and one(spark, html.first_of(src, ["nothing(x)", r"page=(\d+)"])) == "12"


def test_files(spark, tmp_path):
    for n in ("a.pdf", "sub/b.PPTX", "c.docx", "d.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    assert sorted(r.document_type for r in files.discover(spark, str(tmp_path)).collect()) in (["docx", "pdf"], ["docx", "pdf", "pptx"])
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.export(df, str(tmp_path / "out"), "csv", "k")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/data")).count() == 2
    assert {r.property: r.value for r in spark.read.json(str(tmp_path / "out/metadata")).collect()}["rows"] == "2"
    assert sorted((r.k, r.v) for r in files.upserted(df, df.where("k = 2").withColumn("v", F.lit("z")), "k").collect()) == [(1, "a"), (2, "z")]


def test_observation_source(spark, tmp_path):
    (tmp_path / "S1.json").write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-01-02", "value": "."}]}))
    spark.dataSource.register(ObservationFiles)
    got = spark.read.format("fathom_observations").load(str(tmp_path)).collect()
    assert sorted((r.series, r.date, r.value) for r in got) == [("S1", "2020-01-01", 1.5), ("S1", "2020-01-02", None)]


def test_series(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0), ("2020-01-02", None, 3.0)], "date string, btc_volume_7dma double, price double")
    long = frames.to_long(wide, "date", ["btc_volume_7dma", "price"])
    assert sorted({(r.asset, r.metric) for r in long.collect()}) == [("BTC", "volume_7dma"), ("UNKNOWN", "price")] and long.count() == 4
    assert one(spark, quality.quality_score(F.lit(1), F.lit(2), F.array(F.lit(20.0)), F.lit(10.0))) == 100 - 10 - 4 - 10 - 3
    j = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 5.5), ("a", 4, 20.0)], "s string, t int, v double")
    assert quality.jumps(j, "s", ["t"], "v").first()["n_jumps"] == 2
    assert quality.zscore_anomalies(j, ["v"]).count() == 0 and quality.duplicates(j.limit(0), ["s"]).first()["n_rows"] == 0


def test_chunks_and_rules(spark):
    starts = lambda n, m, o: one(spark, chunking.window_starts(F.lit(n), m, o))
    assert starts(2500, 1000, 50) == [0, 950, 1900] and starts(1001, 1000, 50) == [0, 950] and starts(40, 1000, 50) == [0]
    p = chunking.pack_paragraphs(spark.createDataFrame([(1, "a" * 40 + "\n\n" + "b" * 40 + "\n \n" + "c" * 400 + "\n\nd"), (2, None)], "k int, t string"), "k", "t", 20, 0).collect()
    assert [r.chunk for r in p] == ["a" * 40 + "\n\n" + "b" * 40, *["c" * 80] * 5, "d"]
    assert one(spark, chunking.heading_path(F.array(*[F.lit(x) for x in (1, 2, 3, 2)]), F.array(*[F.lit(x) for x in "abcd"]))) == ["a", "d"]
    assert one(spark, rules.first_match(F.lit("What's the WEATHER?"), [("g", "weather")])) == "g" and one(spark, rules.intent(F.lit("Step 1: go"))) == "tutorial"
    b = screener.block_parts(F.lit("t0_r1_c1_p26_r3"))
    assert tuple(one(spark, b)) == ("table", "t0_r1_c1", 26, 3)
    rows = [("s", x) for x in ("p5_r0", "p5_r1", "p6_r3", "p9_r0", "t0_r0_c0_p5_r0", "t0_r0_c1_p6_r0")]
    got = screener.islands(spark.createDataFrame(rows, "g string, b string"), ["g"], "b").groupBy("cell", "island").count().collect()
    assert sorted((r.cell, r["count"]) for r in got) == [("", 1), ("", 3), ("t0_r0_c0", 1), ("t0_r0_c1", 1)]


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "k int, e array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q int, v array<double>")
    assert [(r.k, r.score) for r in search.vector_topk(v, "k", "e", q, "q", "v", 3).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    a = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)], "query int, k int, score double")
    b = spark.createDataFrame([(1, 2, 8.0), (1, 4, 2.0)], "query int, k int, score double")
    assert {r.k: r.score for r in search.fuse(a, b, "k").collect()} == {1: 0.7, 2: 0.65, 3: 0.0, 4: 0.0}


def test_near_texts(spark):
    import random

    r = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("an", "el", "ir", "ost", "und")]
    texts = {}
    for i in range(40):
        w = list(texts[r.randrange(i)].split()) if i > 5 and r.random() < 0.6 else [r.choice(words) for _ in range(80)]
        w[r.randrange(len(w))] = r.choice(words)
        texts[i] = " ".join(w)
    texts[40], texts[41], texts[42] = texts[0].upper(), None, "ab"
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} or {t}
    s = {}
    for i, t in texts.items():  # sets count once, by their smallest key
        if grams((t or "").lower()) not in s.values():
            s[i] = grams((t or "").lower())
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.92 * len(s[a] | s[b])}
    got = {(x.a, x.b) for x in dedup.near_texts(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t")[1].collect()}
    assert got == want and len(want) > 3


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "A b!"), (2, "a  b"), (3, "c")], "id int, text string")
    src.write.parquet(str(tmp_path / "in"))
    write = incremental.into_table(str(tmp_path / "out"), "text", "id")
    q = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) in (["A b!", "c"], ["A b!", "a  b", "c"])
    log = spark.createDataFrame([("u", i, 1_700_000_000 + i) for i in range(8)] + [("v", 9, 1_700_000_000)], "u string, k int, s long").withColumn("t", F.timestamp_seconds("s"))
    got = incremental.token_bucket_trace(log, "u", "t", "k", 0.5, 3.0).orderBy("k").collect()
    assert [r.granted for r in got] == [True, True, True, True, True, False, True, False, True]
