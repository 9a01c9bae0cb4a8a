from fathom.operators.search import greedy_selection


def test_greedy_selection_goes_on_behind_many_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "a", f"{base} x{i}", 10.0 - i / 1000) for i in range(2500)] + [(5000 + i, "a", f"other{i} text{i}", 1.0 - i / 100) for i in range(3)] + [(6000, "b", None, 1.0), (6001, "b", "", 0.5)]
    df = spark.createDataFrame(rows, "id long, module string, text string, score double")
    got = {(r.module, r.id, r.rank) for r in greedy_selection(df, "module", "id", "text", "score").collect()}
    assert got == {("a", 0, 1), ("a", 5000, 2), ("a", 5001, 3), ("a", 5002, 4), ("b", 6000, 1), ("b", 6001, 2)}


def test_searches_run_for_every_twentieth_row(spark):
    from fathom.plans import registry

    d = "/root/testdata/sf0.001"
    want = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 = 0 and embedding is not null").collect()}
    for name in ("v03_hybrid_blocks", "v06_filtered_blocks", "v09_reranked_blocks"):
        assert want <= {r["query"] for r in registry.queries()[name](spark, d).select("query").distinct().collect()}, name
