import json

from fathom.operators import drift
from fathom.operators.drift import consistent_table, correspondences, record_fields, schema_changes

SCHEMA = "id long, stream string, file_no int, payload string, extra string"


def changes(spark, files, **kw):
    rows = []
    for f, records in enumerate(files, 1):
        for r in records:
            rows.append((len(rows), "s", f, r if isinstance(r, str) else json.dumps(r), "e"))
    df = spark.createDataFrame(rows, SCHEMA)
    fields = record_fields(df, "id", "stream", "file_no", "payload")
    return df, fields, schema_changes(df, "id", "stream", "file_no", "payload", **kw)


def found(c):
    return {(r.file_no, r.change, r.old_path, r.new_path) for r in c.collect()}


def test_each_kind_of_change(spark):
    status = ["PASS", "FAIL", "WARN"]
    a = [{"status": status[i % 3], "observed": {"italic": True, "size": 10 + i}} for i in range(6)]
    b = [{"outcome": status[i % 3], "observed": {"italic": True, "size": 10 + i}} for i in range(6)]
    c = [{"outcome": status[i % 3], "observed": {"italic": "yes", "size": 10 + i, "strike": False}} for i in range(6)]
    d = [{"outcome": status[i % 3], "observed": {"is_italic": "yes", "strike": False}} for i in range(6)]
    _, _, ch = changes(spark, [a, b, c, d])
    assert found(ch) == {
        (2, "renamed", "status", "outcome"), (3, "type_changed", "observed.italic", "observed.italic"), (3, "added", "", "observed.strike"),
        (4, "renamed", "observed.italic", "observed.is_italic"), (4, "removed", "observed.size", ""),
    }


def test_unrelated_fields_are_no_rename(spark):
    a = [{"id": f"p{i}_r1", "note": f"some words {i} here"} for i in range(8)]
    b = [{"id": f"p{i}_r1", "count": i * 7} for i in range(8)]
    assert found(changes(spark, [a, b])[2]) == {(2, "removed", "note", ""), (2, "added", "", "count")}


def test_values_that_never_recur_are_told_by_their_shape(spark):
    a = [{"id": f"p{i}_r1", "text_preview": f"Of {w} words and the end..."} for i, w in enumerate("many few other long short".split())]
    b = [{"id": f"p{i}_r1", "sentence": f"On {w}, a line that goes..."} for i, w in enumerate("top hills roads lakes trees".split())]
    assert found(changes(spark, [a, b])[2]) == {(2, "renamed", "text_preview", "sentence")}


def test_unreadable_null_and_empty(spark):
    a = [{"x": 1, "y": None}, '{"x": 1, "z', "[1]", "5"]
    b = [{"x": "1", "y": "late"}, {"x": "2"}]
    _, _, ch = changes(spark, [a, b])
    assert found(ch) == {(2, "type_changed", "x", "x")}
    df = spark.createDataFrame([(1, None, 1, "{}", "e"), (2, "s", None, '{"a":1}', "e"), (3, "s", 1, None, "e")], SCHEMA)
    assert record_fields(df, "id", "stream", "file_no", "payload").count() == 0
    assert found(changes(spark, [])[2]) == set()


def test_table_has_one_column_per_family(spark):
    a = [{"status": "PASS", "observed": {"size": 10}}] * 3 + [{"status": "FAIL", "observed": {"size": 11}}] * 3
    b = [{"outcome": "PASS", "observed": {"size": "12"}}] * 3 + [{"outcome": "FAIL", "observed": {"size": "big"}}]
    df, fields, ch = changes(spark, [a, b])
    t = consistent_table(df, fields, ch, "id").orderBy("id").collect()
    assert len(t) == 10 and t[0]["extra"] == "e"
    assert [r["f_status"] for r in t] == ["PASS"] * 3 + ["FAIL"] * 3 + ["PASS"] * 3 + ["FAIL"]
    assert [r["f_observed_size"] for r in t] == [10.0] * 3 + [11.0] * 3 + [12.0] * 3 + [None]
    assert [(u["field"], u["value"]) for u in t[9]["uncast"]] == [("observed.size", "big")]


def test_ties_are_consistent():
    f = lambda p: {"path": p, "kind": "boolean", "n": 5, "vals": {1, 2}, "shapes": {1}}
    got = correspondences([f("bold"), f("italic")], [f("is_italic"), f("is_bold")])
    assert sorted((i, j) for i, j, _ in got) == [(0, 1), (1, 0)]


def test_large_files_are_told_apart_like_small_ones(spark):
    a = [{"id": f"p{i % 50}_r1", "weight": i * 7 + 1, "code": f"k{i % 900}"} for i in range(2500)]
    b = [{"id": f"p{i % 50}_r1", "volume": 10**6 + i * 3, "mark": f"k{(i * 7) % 900}"} for i in range(2500)]
    assert found(changes(spark, [a, b])[2]) == {(2, "removed", "weight", ""), (2, "added", "", "volume"), (2, "renamed", "code", "mark")}


def test_without_flooding_names_and_contents_alone_miss_renames(spark, monkeypatch):
    f = lambda p, kind, vals: {"path": p, "kind": kind, "n": 6, "vals": vals, "shapes": {1}}
    a = [f("id", "string", {1, 2}), f("status", "boolean", {3}), f("size", "number", {5, 6})]
    b = [f("id", "string", {1, 2}), f("outcome", "boolean", {3}), f("size", "number", {5, 6})]
    assert [(i, j) for i, j, _ in correspondences(a, b)] == [(1, 1)]
    monkeypatch.setattr(drift, "flood", lambda start, edges: start)
    assert correspondences(a, b) == []


def test_fields_that_compete_need_more_than_their_place():
    f = lambda p, vals: {"path": p, "kind": "string", "n": 6, "vals": vals, "shapes": {1}}
    a = [f("left", {1, 2}), f("right", {3, 4})]
    assert correspondences(a, [f("upper", {5, 6}), f("lower", {7, 8})]) == []
    assert [(i, j) for i, j, _ in correspondences(a, [f("upper", {5, 6}), f("lower", {1, 2})])] == [(0, 1)]


def test_types_that_changed_together_count_for_a_rename():
    f = lambda p, kind: {"path": p, "kind": kind, "n": 6, "vals": set(), "shapes": set()}
    old = [f(p, "number") for p in "abcdefgh"]
    alike = [*old, f("font_size", "number")], [*(f(p, "string") for p in "abcdefgh"), f("size_pt", "string")]
    apart = [*old, f("font_size", "number")], [*old, f("size_pt", "string")]
    assert correspondences(*alike)[0][2] > correspondences(*apart, accept=0.0)[0][2]


def test_names_side_by_side_stay_apart_and_no_value_is_lost(spark):
    a = [{"status": "PASS", "n": 1}] * 4 + [{"status": "FAIL", "n": 1}] * 4
    b = [{"outcome": "PASS", "n": 1}] * 4 + [{"outcome": "FAIL", "n": 1}] * 4
    df, fields, ch = changes(spark, [a, b, [{"status": "A", "outcome": "B", "n": 1}] * 2])
    t = consistent_table(df, fields, ch, "id").orderBy("id").collect()
    assert [(r["f_status"], r["f_outcome"]) for r in t[-2:]] == [("A", "B")] * 2 and t[0]["f_status"] == "PASS" and t[8]["f_outcome"] == "PASS"
    few = consistent_table(df, fields, ch, "id", most_columns=1).orderBy("id").collect()
    assert few[-1]["f_n"] == 1 and few[-1]["f_more"] == {"status": "A", "outcome": "B"}


def test_shuffled_like_broadcast(spark):
    a, b = [{"status": "PASS", "n": 1}, {"status": "FAIL", "n": 2}], [{"outcome": "PASS", "n": 1}, {"outcome": "FAIL", "n": 2}]
    assert found(changes(spark, [a, b], most_sent=0)[2]) == found(changes(spark, [a, b])[2]) == {(2, "renamed", "status", "outcome")}
