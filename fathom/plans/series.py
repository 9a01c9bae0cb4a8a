"""Queries over time series, tables and numbers, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import dates, numbers, web
from fathom.operators import frames, quality
from fathom.session import table
from fathom.streaming import incremental

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


# ---- reshaping and merging


def _daily_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("orders_total"), F.count("*").alias("orders_count"))


def _daily_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("lines_total"), F.count("*").alias("lines_count"))


ORDERS = "select o_orderdate::date as date, round(sum(o_totalprice), 2) as orders_total, count(*) as orders_count from orders group by 1"
LINES = "select l_shipdate::date as date, round(sum(l_extendedprice), 2) as lines_total, count(*) as lines_count from lineitem group by 1"


@query(f"""with o as ({ORDERS}) select date, 'ORDERS' as asset, 'total' as metric, orders_total::double as value from o
union all select date, 'ORDERS', 'count', orders_count::double from o""")
def frame_p01_melt(spark: SparkSession, d: str) -> DataFrame:
    return frames.to_long(_daily_orders(spark, d), "date", ["orders_total", "orders_count"])


@query("""select ts::date as date, round(sum(value) filter (event_type = 'click'), 4) as click_value, round(sum(value) filter (event_type = 'purchase'), 4) as purchase_value,
round(sum(value) filter (event_type = 'view'), 4) as view_value from events group by 1""")
def frame_p02_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.sum("value").alias("value"))
    e = e.withColumns({"metric": F.lit("value"), "nr": F.lit(1)})
    names = ["click_value", "purchase_value", "view_value"]
    return frames.to_wide(e, "date", "event_type", "metric", "value", names, "nr").select("date", *[F.round(n, 4).alias(n) for n in names])


@query("""select ts as date, try_cast(json_extract_string(props, '$.k') as double) as k, round(value, 4) as value, event_id from events where ts is not null""")
def frame_p03_normalise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = numbers.guarded_double(F.get_json_object("props", "$.k"))
    return frames.normalise(e, F.col("ts"), {"k": k}, ["value", "event_id"]).select("date", "k", F.round("value", 4).alias("value"), "event_id")


@query(f"select *, year(date) as year, month(date) as month, day(date) as day from ({ORDERS})")
def frame_p05_calendar(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_calendar(_daily_orders(spark, d), "date")


@query(f"select * from ({ORDERS}) full join ({LINES}) using (date)")
def j01_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    return frames.merge([_daily_orders(spark, d), _daily_lines(spark, d)], "date", "full")


@query("""with a as (select date_trunc('month', o_orderdate)::date as date, round(sum(o_totalprice), 2) as orders_total from orders group by 1),
b as (select date_trunc('month', l_shipdate)::date as date, round(sum(l_quantity), 2) as quantity from lineitem group by 1)
select *, year(date) as year, month(date) as month, day(date) as day from a full join b using (date)""")
def j02_series_calendar(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("orders_total"))
    b = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return frames.with_calendar(frames.merge([a, b], "date"), "date")


@query(f"""select o.*, l.lines_total, l.lines_count, e.events_count from ({ORDERS}) o left join ({LINES}) l using (date)
left join (select ts::date as date, count(*) as events_count from events group by 1) e using (date)""")
def j03_left_align(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("events_count"))
    return frames.align_left(_daily_orders(spark, d), [_daily_lines(spark, d), e], "date")


@query("""select c_custkey as id, c_name as name, c_mktsegment as segment, 'customer' as source from customer union all select s_suppkey, s_name, null, 'supplier' from supplier""")
def u01_union_tagged(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return frames.union_tagged({"customer": c, "supplier": s})


@query("select c_custkey, c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer qualify rank <= 3")
def o02_topk_within(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return frames.top_k(c, [F.desc("c_acctbal"), F.asc("c_custkey")], 3, ["c_mktsegment"])


@query("select event_id, ts, value from events order by ts desc, event_id limit 10")
def o03_preview(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_k(table(spark, d, "events").select("event_id", "ts", "value"), [F.desc("ts"), F.asc("event_id")], 10)


@query("""select user_id, event_id, event_type, tried_before from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as tried_before,
sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as p from events)
where event_type = 'purchase' and coalesce(p, 0) = 0""")
def s36_first_success(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return frames.first_success(e, ["user_id"], "at", F.col("event_type") == "purchase").select("user_id", "event_id", "event_type", "tried_before")


# ---- validation

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(template: str, cols: list[str]) -> str:
    return " union all ".join(template.replace("{c}", c) for c in cols)


@query(_per_column("""select '{c}' as "column", count(*) as n, count(*) - count({c}) as n_null, min({c}) as lo, max({c}) as hi, round(avg({c}), 6) as mean,
round(stddev_samp({c}), 6) as std, count(*) filter ({c} < 0) as n_negative, 100.0 * (count(*) - count({c})) / count(*) as null_pct from lineitem""", LINE_COLUMNS))
def a06_numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    s = quality.column_stats(table(spark, d, "lineitem"), LINE_COLUMNS)
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


FIELDS = ["esi_eu", "esi_ea", "eei_eu", "eei_ea", "flash_consumer_confidence_ea"]


@query(_per_column("""select '{c}' as "column", count(*) as n, count(*) filter ({c} is null or isnan({c})) as n_null,
case when 100.0 * count(*) filter ({c} is null or isnan({c})) / count(*) > 50 then 'error' when 100.0 * count(*) filter ({c} is null or isnan({c})) / count(*) > 10 then 'warning' else 'ok' end as severity
from dg_ecfin_surveys""", FIELDS))
def a04_nulls(spark: SparkSession, d: str) -> DataFrame:
    s = quality.column_stats(table(spark, d, "dg_ecfin_surveys"), FIELDS)
    return s.select("column", "n", "n_null", quality.null_severity(F.col("null_pct")).alias("severity"))


@query("""with g as (select panel_id, date, esi_eu, esi_ea, count(*) as n from dg_ecfin_surveys group by all) select sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_duplicates from g""")
def a03_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(table(spark, d, "dg_ecfin_surveys"), ["panel_id", "date", "esi_eu", "esi_ea"])


@query("""select count(*) as n_rows, 6 as n_columns, count(*) >= 1 as enough, count(*) <= 100000 as not_too_many from events""")
def a01_row_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.count("*")
    return e.agg(n.alias("n_rows"), F.lit(len(e.columns)).alias("n_columns"), (n >= 1).alias("enough"), (n <= 100000).alias("not_too_many"))


@query("""select min(date::date) as lo, max(date::date) as hi, date_diff('day', min(date::date), max(date::date)) as span_days, count(*) filter (date::date > '2020-01-01'::date) as n_future,
count(*) filter (date::date < '2000-01-01'::date) as n_early from dg_ecfin_surveys""")
def a05_date_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.date_range(table(spark, d, "dg_ecfin_surveys"), "date", "2020-01-01")


def _iqr(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as n, any_value(lower) as lower, any_value(upper) as upper, count(*) filter ({c} < lower or {c} > upper) as n_outliers,
100.0 * count(*) filter ({c} < lower or {c} > upper) / count({c}) as pct from dg_ecfin_surveys, (select a - 3 * (b - a) as lower, b + 3 * (b - a) as upper from (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from dg_ecfin_surveys)) q"""


@query(f"""select "column", n, round(lower, 6) as lower, round(upper, 6) as upper, n_outliers, round(pct, 6) as pct from ({" union all ".join(_iqr(c) for c in FIELDS)})""")
def a07_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = quality.iqr_outliers(table(spark, d, "dg_ecfin_surveys"), FIELDS)
    return o.select("column", "n", *[F.round(c, 6).alias(c) for c in ("lower", "upper")], "n_outliers", F.round("pct", 6).alias("pct"))


def _z(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as n, count(*) filter (abs({c} - m) > 3 * s) as n_anomalies, round(100.0 * count(*) filter (abs({c} - m) > 3 * s) / count({c}), 6) as pct
from dg_ecfin_surveys, (select avg({c}) as m, stddev_samp({c}) as s from dg_ecfin_surveys) q"""


@query(" union all ".join(_z(c) for c in FIELDS))
def a14_zscore(spark: SparkSession, d: str) -> DataFrame:
    return quality.zscore_anomalies(table(spark, d, "dg_ecfin_surveys"), FIELDS).withColumn("pct", F.round("pct", 6))


@query("""with x as (select distinct feed_id as series, date as d from breakeven_readings where date is not null), s as (select series, lag(d) over (partition by series order by d) as after, d from x),
g as (select series, after, (epoch_us(d) - epoch_us(after)) / 1e6 as gap_s from s where after is not null), m as (select series, median(gap_s) as median_s from g group by 1)
select series, after, round(gap_s, 3) as gap_s, round(median_s, 3) as median_s from g join m using (series) where gap_s > 2 * median_s""")
def a08_date_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = quality.date_gaps(table(spark, d, "breakeven_readings"), "feed_id", "date")
    return g.select("series", "after", F.round("gap_s", 3).alias("gap_s"), F.round("median_s", 3).alias("median_s"))


@query("""with s as (select series_id as series, latest_value as v, lag(latest_value) over (partition by series_id order by run_at, snapshot_id) as p from umcsent_snapshots where latest_value is not null)
select series, count(*) as n, count(*) filter (case when p = 0 then v <> 0 else abs((v - p) / nullif(p, 0)) > 0.5 end) as n_jumps from s group by 1""")
def a09_jumps(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "umcsent_snapshots").where("latest_value is not null")
    return quality.jumps(u, "series_id", ["run_at", "snapshot_id"], "latest_value")


OHLC = """select ts::date as date, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close from events where value is not null group by 1"""


@query(OHLC)
def a13_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return quality.ohlc(table(spark, d, "events"), [F.to_date("ts").alias("date")], "ts", "event_id", "value")


@query(f"select count(*) as n, count(*) filter (high < low) as n_inverted, count(*) filter (open < low or open > high or close < low or close > high) as n_outside from ({OHLC})")
def a13_ohlc_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.ohlc_violations(a13_ohlc(spark, d))


@query("""select count(*) as n, count(*) filter (value < 0) as n_negative, count(*) filter (value = 0) as n_zero, round(100.0 * count(*) filter (value = 0) / count(*), 6) as zero_pct,
count(*) filter (value < -100 or value > 1000) as n_beyond_percent from theblock_points""")
def a11_volumes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "theblock_points").agg(
        F.count("*").alias("n"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"),
        F.round(100.0 * F.count_if(v == 0) / F.count("*"), 6).alias("zero_pct"), F.count_if((v < -100) | (v > 1000)).alias("n_beyond_percent"),
    )


def _cov(c: str) -> str:
    return f"""select '{c}' as field, count(*) as n, round(100.0 * count({c}) / count(*), 6) as coverage_pct, min({c}) as lo, max({c}) as hi, max(date) filter ({c} is not null) as latest_date,
arg_max({c}, (date, {c})) filter ({c} is not null) as latest from (select date, case when isnan({c}) then null else {c} end as {c} from dg_ecfin_surveys)"""


@query(" union all ".join(_cov(c) for c in FIELDS))
def a20_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(table(spark, d, "dg_ecfin_surveys"), "date", FIELDS).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("""select series_id, arg_min(latest_value, (latest_date, latest_value)) as first_value, min(latest_date) as first_date, arg_max(latest_value, (latest_date, latest_value)) as latest_value,
max(latest_date) as latest_date, min(latest_value) as lo, max(latest_value) as hi, count(latest_value) as n from (select * from umcsent_snapshots where latest_value is not null) group by 1""")
def a21_series_summary(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "umcsent_snapshots").where("latest_value is not null").select("series_id", F.col("latest_date").alias("date"), F.col("latest_value").alias("value"))
    s = quality.series_summary(u, "series_id", "date", "value")
    return s.select("series_id", "first_value", "first_date", "latest_value", "latest_date", "lo", "hi", "n")


@query("""with s as (select snapshot_id, series_id, row_number() over (partition by series_id order by snapshot_id) as r, ['$', '€', '£', ''][1 + (length(units) + snapshot_id) % 4] || round(latest_value, 1)::varchar as t
from umcsent_snapshots where latest_value is not null and units is not null) select series_id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(t, '[$€£¥₹]'))))), '') as signs from s where r <= 10 group by 1""")
def a10_currency_mix(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "umcsent_snapshots").where("latest_value is not null and units is not null")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("$", "€", "£", "")]), (1 + (F.length("units") + F.col("snapshot_id")) % 4).cast("int"))
    t = u.withColumn("t", F.concat(sign, F.round("latest_value", 1).cast("string")))
    return quality.currency_mix(t, "series_id", "t", "snapshot_id")


@query(f"""with s as ({_per_column("select '{c}' as c, 100.0 * count(*) filter ({c} is null or isnan({c})) / count(*) as p from dg_ecfin_surveys", FIELDS)}),
dup as (select 100.0 * sum(n - 1) / sum(n) as p from (select count(*) as n from dg_ecfin_surveys group by panel_id, date))
select count(*) filter (p > 50) as n_errors, count(*) filter (p > 10 and p <= 50) as n_warnings, round(greatest(0, least(100, 100 - 10 * count(*) filter (p > 50) - 2 * count(*) filter (p > 10 and p <= 50)
- sum(least(0.5 * p, 10)) - least(0.3 * (select p from dup), 5))), 4) as score from s""")
def a15_quality_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dg_ecfin_surveys")
    s = quality.column_stats(t, FIELDS).withColumn("severity", quality.null_severity(F.col("null_pct")))
    one = s.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.collect_list("null_pct").alias("pcts"))  # a row per column
    dup = quality.duplicates(t, ["panel_id", "date"]).select((100.0 * F.col("n_duplicates") / F.col("n_rows")).alias("dup_pct"))
    score = quality.quality_score(F.col("n_errors"), F.col("n_warnings"), F.col("pcts"), F.col("dup_pct"))
    return one.join(F.broadcast(dup)).select("n_errors", "n_warnings", F.round(score, 4).alias("score"))  # one row each


def _validate_sql() -> str:
    v = lambda c: f"case when not isnan({c}) then {c} end"
    parts = ["select 'duplicates' as \"check\", null as \"column\", 'warning' as severity, (count(*) - (select count(*) from (select distinct panel_id, date from dg_ecfin_surveys)))::bigint as n from dg_ecfin_surveys having n > 0"]
    parts += [f"select '{what} dates', 'date', 'warning', count(*) as n from dg_ecfin_surveys where date::date {test} having n > 0" for what, test in (("future", "> date '2020-01-01'"), ("early", "< date '2000-01-01'"))]
    for c in FIELDS:
        parts += [
            f"select 'nulls', '{c}', case when 100.0 * n / all_n > 50 then 'error' else 'warning' end, n from (select count(*) - count({v(c)}) as n, count(*) as all_n from dg_ecfin_surveys) where 100.0 * n / all_n > 10",
            f"select 'negative', '{c}', 'warning', count(*) as n from dg_ecfin_surveys where {v(c)} < 0 having n > 0",
            f"""select 'outliers', '{c}', 'warning', n from (select count(*) filter (x < q1 - 3 * (q3 - q1) or x > q3 + 3 * (q3 - q1)) as n, count(x) as m from (select {v(c)} as x from dg_ecfin_surveys), (select quantile_cont({v(c)}, 0.25) as q1, quantile_cont({v(c)}, 0.75) as q3 from dg_ecfin_surveys)) where m >= 10 and n > 0.05 * m""",
            f"""select 'anomalies', '{c}', 'warning', n from (select count(*) filter (abs({c} - mu) > 3 * sd) as n, count({c}) as m from dg_ecfin_surveys, (select avg({c}) as mu, stddev_samp({c}) as sd from dg_ecfin_surveys)) where m >= 10 and n > 0.05 * m""",
        ]
    return " union all ".join(f"({p})" for p in parts)


@query(_validate_sql())
def a18_validate(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate(table(spark, d, "dg_ecfin_surveys"), FIELDS, ["panel_id", "date"], "date", "2020-01-01")


@query("""select 'rows' as property, count(*)::varchar as value from region union all select 'columns', '2' union all select 'names', 'r_regionkey, r_name'""")
def a30_export_metadata(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.files import export_metadata

    return export_metadata(table(spark, d, "region"))


@query("""select site_id, case when site_id like 'coinglass%' then 'crypto_metrics' when site_id like 'theblock%' then 'time_series' when site_id like 'fred%' then 'market_sentiment' else 'snapshot' end as profile
from (select distinct case chart_id % 4 when 0 then 'coinglass_' when 1 then 'theblock_' when 2 then 'fred_' else 'other_' end || replace(slug, '/', '_') as site_id from chart_feeds)""")
def f12_site_profile(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("coinglass_", "theblock_", "fred_", "other_")]), (F.col("chart_id") % 4 + 1).cast("int"))
    s = table(spark, d, "chart_feeds").select(F.concat(prefix, F.replace("slug", F.lit("/"), F.lit("_"))).alias("site_id")).distinct()
    return s.select("site_id", quality.profile_of(F.col("site_id")).alias("profile"))


@query("""select panel_id, field, arg_max(v, date) as latest, max(date) as latest_date, min(date) as first_date from (select panel_id, date, 'esi_eu' as field, esi_eu as v from dg_ecfin_surveys
union all select panel_id, date, 'eei_ea', eei_ea from dg_ecfin_surveys) where v is not null and not isnan(v) group by 1, 2""")
def a34_indicator_cards(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dg_ecfin_surveys").unpivot(["panel_id", "date"], ["esi_eu", "eei_ea"], "field", "v").where("v is not null and not isnan(v)")
    return t.groupBy("panel_id", "field").agg(F.max_by("v", "date").alias("latest"), F.max("date").alias("latest_date"), F.min("date").alias("first_date"))


@query("""select event_type, ts::date as day, count(*) as n, grouping(event_type, ts::date)::int as level from events group by grouping sets ((event_type), (ts::date))""")
def a25_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("fathom_events")
    return spark.sql("select event_type, day, count(*) as n, cast(grouping_id() as int) as level from (select event_type, to_date(ts) as day from fathom_events) group by grouping sets ((event_type), (day))")


@query("""select user_id, event_id, ts, value - lag(value) over w as diff, round((value - lag(value) over w) / nullif(lag(value) over w, 0), 6) as pct_change from events window w as (partition by user_id order by ts, event_id)""")
def w01_lag_diff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") - prev).alias("diff"), F.round(F.try_divide(F.col("value") - prev, prev), 6).alias("pct_change"))


# ---- logs as streams


@query("""select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 60000000 preceding and current row) as n_recent from events""")
def r02_requests_last_60s(spark: SparkSession, d: str) -> DataFrame:
    return incremental.requests_within(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "user_id", "n_recent")


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from y group by user_id, s""")
def r04_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = incremental.sessions(table(spark, d, "events"), "user_id", "ts")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("""with l as (select user_id, list(event_id order by epoch_us(ts), event_id) as ids, list(epoch_us(ts) order by epoch_us(ts), event_id) as us from events where ts is not null group by 1),
r as (select user_id, ids, list_reduce(us, lambda a, t: {'n': least(5.0, a.n + case when a.last is null then 0 else (t - a.last) / 1e6 * (1 / 3600) end) - case when least(5.0, a.n + case when a.last is null then 0 else (t - a.last) / 1e6 * (1 / 3600) end) >= 1 then 1 else 0 end,
'last': t, 'ok': a.ok || [least(5.0, a.n + case when a.last is null then 0 else (t - a.last) / 1e6 * (1 / 3600) end) >= 1]}, {'n': 5.0::double, 'last': null::bigint, 'ok': []::boolean[]}) as r from l)
select user_id, unnest(ids) as event_id, unnest(r.ok) as granted from r""")
def r03_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return incremental.token_bucket_trace(table(spark, d, "events"), "user_id", "ts", "event_id", rate=1 / 3600, capacity=5.0)


@query("""select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end, event_type, count(*) as n from events group by all""")
def r05_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    c = incremental.counts_per_window(table(spark, d, "events"), "ts", "1 day", None, ["event_type"])
    return c.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


# ---- numbers and dates as text

# A number written in a different way in each row, from the part's price and key.
WRITTEN = """select p_partkey, case p_partkey % 8 when 0 then '$' || c when 1 then '(' || c || ')' when 2 then '€ ' || c when 3 then c || '%' when 4 then c || 'K' when 5 then '-$' || c when 6 then 'abc' else '1,' || c || 'd' end as raw
from (select p_partkey, p_retailprice::decimal(12, 2)::varchar as c from part)"""


def _written(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    forms = [F.concat(F.lit("$"), c), F.concat(F.lit("("), c, F.lit(")")), F.concat(F.lit("€ "), c), F.concat(c, F.lit("%")), F.concat(c, F.lit("K")), F.concat(F.lit("-$"), c), F.lit("abc"), F.concat(F.lit("1,"), c, F.lit("d"))]
    return table(spark, d, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("raw"))


GUARD = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _guarded(e: str) -> str:
    return f"case when regexp_full_match({e}, '{GUARD}') then try_cast({e} as double) end"


def _paren(e: str) -> str:
    return rf"regexp_replace({e}, '^\((.*)\)$', '-\1')"


@query(f"with w as ({WRITTEN}), x as (select p_partkey, raw, {_paren("replace(trim(regexp_replace(raw, '[$€£¥₹₿¢]', '', 'g')), ',', '')")} as s from w) select p_partkey, raw, {_guarded('s')} as value from x")
def x01_price(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).withColumn("value", numbers.price(F.col("raw")))


@query(f"with w as ({WRITTEN}), x as (select p_partkey, raw, {_paren("trim(regexp_replace(raw, '[%,]', '', 'g'))")} as s from w) select p_partkey, raw, {_guarded('s')} as value from x")
def x02_percentage(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).withColumn("value", numbers.percentage(F.col("raw")))


NUMBER = f"""with w as ({WRITTEN}), x as (select p_partkey, raw, trim(replace(regexp_replace(raw, '[$€£¥₹₿¢]', '', 'g'), ',', '')) as s from w), y as (select *, trim(left(s, length(s) - 1)) as stem,
case upper(right(s, 1)) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 when 'T' then 1e12 end as f, {_paren('s')} as plain from x)
select p_partkey, raw, case when f is not null then ({_guarded('stem')}) * f else {_guarded('plain')} end as value from y"""


@query(NUMBER)
def x03_number(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).withColumn("value", numbers.number(F.col("raw")))


@query("""select c_custkey, nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '^[A-Z]+:', ''), '\\.[A-Z]+$', ''), '[^A-Z0-9]', '', 'g'), '') as ticker
from (select c_custkey, case c_custkey % 3 when 0 then 'nyse:' || c_mktsegment when 1 then c_mktsegment || '.US' else ' ' || lower(c_mktsegment) || '-usd ' end as raw from customer)""")
def x04_ticker(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("nyse:"), seg)).when(F.col("c_custkey") % 3 == 1, F.concat(seg, F.lit(".US"))).otherwise(F.concat(F.lit(" "), F.lower(seg), F.lit("-usd ")))
    return table(spark, d, "customer").select("c_custkey", numbers.ticker(raw).alias("ticker"))


@query(f"with w as ({WRITTEN}) select p_partkey, case when contains(raw, '$') then 'USD' when contains(raw, '€') then 'EUR' end as currency from w")
def x05_currency(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).select("p_partkey", numbers.currency(F.col("raw")).alias("currency"))


@query("""with c as (select o_orderkey, round(o_totalprice * 100)::bigint as v from orders) select o_orderkey, case when v >= 1000000 then ((v + 5000) // 1000000)::varchar || '.' || lpad((((v + 5000) // 10000) % 100)::varchar, 2, '0') || 'M' else v::varchar || '.00' end as shown from c""")
def x12_in_millions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.in_millions(F.round(F.col("o_totalprice") * 100).cast("decimal(18,2)")).alias("shown"))


@query(f"with w as ({NUMBER}) select p_partkey, case when value >= 0 then value end as value, value is null as is_text from w")
def x10_amount(spark: SparkSession, d: str) -> DataFrame:
    w = _written(spark, d).withColumn("n", numbers.number(F.col("raw")))
    return w.select("p_partkey", F.when(F.col("n") >= 0, F.col("n")).alias("value"), F.col("n").isNull().alias("is_text"))


@query("""select point_id, case when regexp_full_match(date, '\\d{10}') then make_timestamp(date::bigint * 1000000) when regexp_full_match(date, '\\d{13}') then make_timestamp(date::bigint * 1000) end as at
from theblock_points where regexp_full_match(date, '\\d{10}|\\d{13}')""")
def x13_epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "theblock_points").where(F.col("date").rlike(r"^(\d{10}|\d{13})$"))
    return p.select("point_id", dates.epoch(F.col("date")).cast("timestamp_ntz").alias("at"))


@query("""select distinct strftime(o_orderdate, '%B') as month, year(o_orderdate) as year, date_trunc('month', o_orderdate)::date as date from orders""")
def x14_month_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "MMMM").alias("month"), F.year("o_orderdate").alias("year")).distinct()
    return o.select("month", "year", dates.month_year(F.col("month"), F.col("year")).alias("date"))


# ---- requests and pages

DOMAIN = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
SLUG = lambda e: f"left(regexp_replace(regexp_replace({e}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 30)"


@query(f"select request_id, {DOMAIN} as domain, {PATH} as path, lower(concat_ws('_', {SLUG(DOMAIN)}, nullif({SLUG(PATH)}, ''), left(md5(url), 6))) as site_id from network_requests where url is not null")
def x18_site_id(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "network_requests").where("url is not null").select("request_id", web.domain(u).alias("domain"), web.path(u).alias("path"), web.site_id(u).alias("site_id"))


def _any(e: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({e}, '{p}')" for p in parts) + ")"


def _count(e: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"contains({e}, '{p}')::int" for p in parts) + ")"


IS_DATA = f"coalesce(status = 200 and (contains(lower(content_type), 'json') or contains(lower(content_type), 'csv') or contains(lower(content_type), 'html')), false) and not {_any('lower(url)', web.NO_DATA_PARTS)}"


@query(f"select request_id from network_requests where {IS_DATA}")
def f08_data_requests(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "network_requests")
    return r.where(web.is_data_request(F.col("url"), F.col("status"), F.col("content_type"))).select("request_id")


SCORE = f"""greatest(0, least(1, (2 * {_count('lower(url)', web.DATA_PARTS)} - 10 * {_count('lower(url)', web.TRACKING_PARTS)}
+ case when contains(lower(coalesce(content_type, '')), 'json') then 1.0 when contains(lower(coalesce(content_type, '')), 'csv') then 1.5 when contains(lower(coalesce(content_type, '')), 'xml') then 1.2 else 0 end
+ case when {DOMAIN} = 'charts.blockdesk.example' then 0.5 else 0 end + case when coalesce(content_length, 0) > 1000 then 0.5 else 0 end + case when coalesce(content_length, 0) > 10000 then 0.5 else 0 end) / 10))"""


@query(f"select request_id, round({SCORE}, 6) as score from network_requests where url is not null and round({SCORE}, 6) >= 0.2")
def f09_endpoint_score(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    s = web.endpoint_score(u, F.col("content_type"), F.col("content_length"), web.domain(u) == "charts.blockdesk.example", F.lit(False))
    return table(spark, d, "network_requests").where("url is not null").select("request_id", F.round(s, 6).alias("score")).where("score >= 0.2")


@query("""select request_id, list_min(list_transform(regexp_extract_all(url, '[?&](?:limit|page)=(\\d+)', 1), lambda x: x::int)) as lo from network_requests where regexp_matches(url, '[?&]limit=\\d+')""")
def s22_list_limits(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "network_requests").where(F.col("url").rlike(r"[?&]limit=\d+"))
    return r.select("request_id", web.page_numbers(F.regexp_replace("url", "([?&])limit=", "$1page="))[0].alias("lo"))


RULES = [("api.seriesvault.example", "disallow", "/v2/"), ("api.seriesvault.example", "allow", "/v2/series/sentiment"), ("charts.blockdesk.example", "disallow", "/static/*.js"), ("www.quotemill.example", "disallow", "/")]


@query(f"""with rules as (select * from (values {', '.join(str(r) for r in RULES)}) t(domain, kind, pattern)),
u as (select request_id, url, {DOMAIN} as d, {PATH} as p from network_requests where url is not null),
j as (select request_id, bool_or(coalesce(kind = 'allow' and regexp_matches(p, '^' || replace(replace(pattern, '.', '\\.'), '*', '.*')), false)) as a,
bool_or(coalesce(kind = 'disallow' and regexp_matches(p, '^' || replace(replace(pattern, '.', '\\.'), '*', '.*')), false)) as x from u left join rules on d = domain group by 1)
select request_id, a or not x as allowed from j""")
def s45_robots(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "domain string, kind string, pattern string")
    r = table(spark, d, "network_requests").where("url is not null").select("request_id", "url")
    return web.robots_verdicts(r, "url", rules).select("request_id", "allowed")


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events""")
def s12_json_path(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.structured import json_path

    return table(spark, d, "events").select("event_id", json_path(F.col("props"), "k").try_cast("int").alias("k"))


@query("""select event_id, key as name, value as value from (select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events)""")
def s13_json_fields(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.structured import rows_of_map

    return rows_of_map(table(spark, d, "events"), ["event_id"], F.col("props"))


@query("""with g as (select user_id, list(event_id order by event_id) as ids, list(value order by event_id) as vals from events group by 1) select user_id, generate_subscripts(ids, 1) - 1 as nr, unnest(ids) as id, unnest(vals) as value from g""")
def s13_parallel_arrays(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.structured import rows_of_parallel

    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    return rows_of_parallel(g, ["user_id"], {"id": F.col("l.event_id"), "value": F.col("l.value")})


@query("""select series_id, date, value from (select series_id, latest_date as date, latest_value as value, row_number() over (partition by series_id order by latest_date desc, run_at desc, snapshot_id desc) as r from umcsent_snapshots where latest_value is not null) where r = 1""")
def s26_latest_observation(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "umcsent_snapshots").where("latest_value is not null")
    at = F.struct("latest_date", "run_at", "snapshot_id")
    return u.groupBy("series_id").agg(F.max_by("latest_date", at).alias("date"), F.max_by("latest_value", at).alias("value"))


@query("""select s_suppkey, s_acctbal from supplier order by s_acctbal desc nulls last, s_suppkey limit 20""")
def s25_largest(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_k(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")], 20)


@query(r"""select case when regexp_matches(trim(response_body::varchar), '^[\[{]') then 'json' when regexp_matches(trim(response_body::varchar), '(?i)^<(!doctype|html|\?xml|table|div)') then 'html'
when regexp_matches(response_body::varchar, '\\x0[0-8]') then 'binary' else 'text' end as kind, count(*) as n from network_requests where response_body is not null group by 1""")
def s38_response_types(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources.files import response_type

    r = table(spark, d, "network_requests").where("response_body is not null")
    return r.groupBy(response_type(F.decode("response_body", "ISO-8859-1")).alias("kind")).agg(F.count("*").alias("n"))
