import datetime as dt

from fathom.operators.grid import weekday_grid


def test_grid_fills_marks_and_keeps_the_last_reading(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, "a", t(1), 1.0, None, "z"), (2, "a", t(1, 5), 2.0, None, "z"), (3, "a", t(3), None, 5.0, "z"), (4, "a", t(6), 9.0, 9.0, "z"), (5, "a", t(16), 4.0, float("nan"), "z"), (6, "a", None, 1.0, 1.0, "z"), (7, None, t(2), 7.0, 7.0, "z")]
    df = spark.createDataFrame(rows, "id long, feed string, at timestamp_ntz, x double, y double, field string")
    g = {(r.src, r.field, r.day.day): (r.value, r.status) for r in weekday_grid(df, "feed", "at", ["x", "y"], "id", 2).collect()}
    assert [g["a", "x", d] for d in (1, 2, 3, 4, 16)] == [(2.0, "observed"), (2.0, "filled"), (2.0, "filled"), (None, "missing"), (4.0, "observed")]
    assert g["a", "y", 3] == (5.0, "observed") and g["a", "y", 16] == (None, "missing")
    assert ("a", "x", 6) not in g and g[None, "x", 2] == (7.0, "observed")
    assert len(g) == 2 * 12 + 2
    assert weekday_grid(df.limit(0), "feed", "at", ["x"]).count() == 0
