import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathom.operators.instants import FORMATS, mixture, normalise_instants, query_moments, readings

UTC = dt.timezone.utc


def us(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "locale", "want"),
    [
        ("2023-01-02", "Asia/Tokyo", "en-US", us(2023, 1, 1, 15)),
        ("2020-07-02 02:16:09 Australia/Sydney", "UTC", "en-GB", us(2020, 7, 1, 16, 16, 9)),
        ("2019-06-04 22:22:21 America/New_York", "America/New_York", "en-US", us(2019, 6, 5, 2, 22, 21)),
        ("29 Oct 2023 01:57 BST", "Europe/London", "en-GB", us(2023, 10, 29, 0, 57)),
        ("29 Oct 2023 01:57 GMT", "Europe/London", "en-GB", us(2023, 10, 29, 1, 57)),
        ("2023-10-29 01:57:00", "Europe/London", "en-GB", us(2023, 10, 29, 0, 57)),
        ("2023-03-26T01:30", "Europe/London", "en-GB", us(2023, 3, 26, 1, 30)),
        ("9. August 2020, 08:44 Uhr", "Europe/Berlin", "de-DE", us(2020, 8, 9, 6, 44)),
        ("13. Mär 2021", "Europe/Berlin", "de-DE", us(2021, 3, 12, 23)),
        ("8 août 2019 07h11", "Europe/Berlin", "fr-FR", us(2019, 8, 8, 5, 11)),
        ("November 9, 2020 6:26:34 AM", "UTC", "en-US", us(2020, 11, 9, 6, 26, 34)),
        ("10/2/2018 11:51 PM", "UTC", "en-US", us(2018, 10, 2, 23, 51)),
        (" 2023/02/12 08:24:56 utc ", "Asia/Tokyo", "en-GB", us(2023, 2, 12, 8, 24, 56)),
        ("Sun, 06 Jun 2021 09:47:20 GMT", "UTC", "en-US", us(2021, 6, 6, 9, 47, 20)),
        ("2020-09-03T12:08+09", "UTC", "en-GB", us(2020, 9, 3, 3, 8)),
        ("20180919T133106Z", "UTC", "en-GB", us(2018, 9, 19, 13, 31, 6)),
        ("1703611160.02", "UTC", "en-GB", 1703611160020000),
        ("1572453202848", "UTC", "en-GB", 1572453202848000),
        ("1656917760123456", "UTC", "en-GB", 1656917760123456),
        ("2018-09-04T04:48:05.573034400Z", "UTC", "en-GB", us(2018, 9, 4, 4, 48, 5) + 573034),
    ],
)
def test_each_way_of_writing(text, zone, locale, want):
    assert want in [v for _, v in readings(text, zone, locale)]


@pytest.mark.parametrize("text", [None, "", "n/a", "25:61", "31/31/2021 10:00", "0000-00-00", "2023-02-30T00:00:00Z", "2022-13-01", "yesterday", "-", "1" * 500])
def test_no_moment(text):
    assert readings(text, "UTC", "en-US") == []


def test_long_texts_are_read_too():
    assert [v for _, v in readings(" " * 200 + "2023-01-02T00:00:00Z" + "\n" * 90, "UTC", "en-US")] == [us(2023, 1, 2)]


DMY, MDY, ISO = (FORMATS.index(f) for f in ("dmy", "mdy", "iso"))


def test_mixture_learns_the_order_from_the_values_that_tell_it():
    flat = [1.0] * len(FORMATS)
    sets = [((DMY, MDY), 10), ((MDY,), 5), ((ISO,), 3)]
    w = mixture(sets, flat)
    assert w[MDY] > 5 * w[DMY]
    start = mixture(sets, flat, rounds=0)  # without the steps of the algorithm nothing is told
    assert start[MDY] == start[DMY]
    general = mixture([((DMY, MDY), 900), ((DMY,), 600)], flat)
    assert mixture([((DMY, MDY), 4)], [4 * x for x in general])[DMY] > 0.6  # the locale's order
    w = mixture([((DMY, MDY), 40), ((MDY,), 60)], [4 * x for x in general])
    assert w[MDY] > w[DMY]  # which the source's own values overturn


def rows_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, text string, s string, z string, l string, format int")
    out = normalise_instants(df, "id", F.col("text"), F.col("s"), F.col("z"), F.col("l"), **kw)
    return sorted((r.row_key, r.utc_micros, r.format, r.status) for r in out.collect())


def test_rows(spark):
    rows = [(1, "03/04/2021 10:00", "a", "UTC", "en-US", 9), (1, "03/04/2021 10:00", "a", "UTC", "en-US", 9), (2, "03/04/2021 10:00", "b", "Europe/Berlin", "de-DE", 9), (3, None, "a", None, None, 9), (4, "2021-01-01", None, "No/Where", None, 9)]
    assert rows_of(spark, rows) == [(1, us(2021, 3, 4, 10), "mdy", "customary")] * 2 + [(2, us(2021, 4, 3, 8), "dmy", "customary"), (4, us(2021, 1, 1), "iso", "certain")]
    assert rows_of(spark, []) == []


def test_values_of_the_source_or_its_locale_resolve(spark):
    tell = [(10 + i, f"0{i}/{13 + i}/2021", "told", "UTC", "en-US", 0) for i in range(1, 9)]
    got = rows_of(spark, [*tell, (1, "03/04/2021", "told", "UTC", "en-US", 0), (2, "03/04/2021", "other", "UTC", "en-US", 0), (3, "03/04/2021", "told", "UTC", "fr-FR", 0), (4, "05/05/2021", "x", "UTC", "fr-FR", 0)])
    assert got[:4] == [(1, us(2021, 3, 4), "mdy", "resolved"), (2, us(2021, 3, 4), "mdy", "resolved"), (3, us(2021, 4, 3), "dmy", "customary"), (4, us(2021, 5, 5), "dmy", "certain")]


def test_values_that_speak_both_ways_are_ambiguous(spark):
    tell = [(10 + i, d, f"s{i}", "UTC", "en-US", 0) for i, d in enumerate(["05/13/2021", "13/05/2021"] * 4)]
    assert rows_of(spark, [*tell, (1, "03/04/2021", "other", "UTC", "en-US", 0)])[0] == (1, us(2021, 3, 4), "mdy", "ambiguous")


def test_query_parameters(spark):
    urls = ["https://h/p?from=2021-09-09T03%3A24%3A21%2B09%3A00&v=20210101&to=2022-04-20+02%3a37%3a20#x", "https://h/p", None, "https://h/p?ts=", "https://h/p?ts=%zz&asof=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: [(m.field, m.value) for m in r.m or []] for r in df.select("i", query_moments(F.col("url"), ("from", "to", "ts", "asof")).alias("m")).collect()}
    assert got[0] == [("from", "2021-09-09T03:24:21+09:00"), ("to", "2022-04-20 02:37:20")]
    assert got[1] == [] and got[2] == [] and got[3] == [("ts", "")] and got[4] == [("ts", None), ("asof", "1")]
