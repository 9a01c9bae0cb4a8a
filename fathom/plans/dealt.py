"""The queries p1 to p4 over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.drift import consistent_table, record_fields, schema_changes
from fathom.operators.grid import weekday_grid
from fathom.operators.instants import normalise_instants, query_moments
from fathom.operators.spikes import implausible_rows
from fathom.session import table

MOMENTS = ("from", "to", "start", "end", "since", "until", "ts", "asof")
INFLATION = ["10_year_breakeven_inflation", "5y5y_forward_inflation"]


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    dg = implausible_rows(table(spark, d, "dg_ecfin_surveys"), "obs_id", F.col("panel_id"), F.to_date("date"), ["esi_eu", "eei_ea"])
    um = implausible_rows(table(spark, d, "umcsent_snapshots"), "snapshot_id", F.col("series_id"), F.col("latest_date").try_cast("date"), ["latest_value"])
    return dg.select(F.lit("dg_ecfin_surveys").alias("src_table"), "*").unionByName(um.select(F.lit("umcsent_snapshots").alias("src_table"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("src_table", "row_key", "field")


RECORDS = ("record_id", "stream_id", "file_no", "payload")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "screener_records"), *RECORDS).select("stream_id", "file_no", "change", "old_path", "new_path")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    rec = table(spark, d, "screener_records")
    return consistent_table(rec, record_fields(rec, *RECORDS), schema_changes(rec, *RECORDS), "record_id").drop("payload")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    g = weekday_grid(table(spark, d, "breakeven_readings"), "feed_id", "date", INFLATION, "reading_id")
    return g.select(F.col("src").alias("feed_id"), "field", F.date_format("day", "yyyy-MM-dd").alias("grid_day"), F.round("value", 6).alias("value"), "status")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where("status <> 'observed'").select("feed_id", "field", "grid_day")


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "theblock_points").join(table(spark, d, "chart_feeds"), "chart_id", "left")
    a = normalise_instants(points, "point_id", F.col("date"), F.col("chart_id"), F.col("tz"), F.col("locale"), {"field": F.lit("date")})
    reqs = table(spark, d, "network_requests").select("request_id", "url", F.explode(query_moments(F.col("url"), MOMENTS)).alias("m"))
    b = normalise_instants(reqs, "request_id", F.col("m.value"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("UTC"), F.lit("en-GB"), {"field": F.col("m.field")})
    return a.select(F.lit("theblock_points").alias("src_table"), "*").unionByName(b.select(F.lit("network_requests").alias("src_table"), "*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The unambiguous instants; values for whose order of day and month others of their locale speak both ways are in p4_instants only, marked."""
    return p4_instants(spark, d).where("status <> 'ambiguous'").select("src_table", "row_key", "field", "utc_micros")


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p2_found": p2_found, "p2_table": p2_table, "p3_found": p3_found, "p3_grid": p3_grid, "p4_found": p4_found, "p4_instants": p4_instants}

_GRID = """with r as (select feed_id, date, reading_id, case when isnan("10_year_breakeven_inflation") then null else "10_year_breakeven_inflation" end as v0, case when isnan("5y5y_forward_inflation") then null else "5y5y_forward_inflation" end as v1 from breakeven_readings where date is not null),
d as (select feed_id, date::date as day, arg_max(v0, (date, reading_id)) filter (v0 is not null) as v0, arg_max(v1, (date, reading_id)) filter (v1 is not null) as v1 from r group by 1, 2),
s as (select feed_id, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by 1),
g as (select s.feed_id, s.day, v0, v1 from s left join d on s.day = d.day and s.feed_id is not distinct from d.feed_id where isodow(s.day) < 6),
l as (select feed_id, '10_year_breakeven_inflation' as field, day, v0 as v from g union all select feed_id, '5y5y_forward_inflation', day, v1 from g),
c as (select *, last_value(v ignore nulls) over (partition by feed_id, field order by day rows between 5 preceding and current row) as carried from l)
select feed_id, field, strftime(day, '%Y-%m-%d') as grid_day, round(carried, 6) as value, case when v is not null then 'observed' when carried is not null then 'filled' else 'missing' end as status from c"""
_DAYS = """with l as (select 'dg_ecfin_surveys' as src_table, obs_id as row_key, panel_id as src, 'esi_eu' as field, date::date as day, esi_eu as v from dg_ecfin_surveys union all
select 'dg_ecfin_surveys', obs_id, panel_id, 'eei_ea', date::date, eei_ea from dg_ecfin_surveys union all
select 'umcsent_snapshots', snapshot_id, series_id, 'latest_value', try_cast(latest_date as date), latest_value from umcsent_snapshots),
x as (select * from l where v is not null and not isnan(v)),
d as (select src_table, src, field, day, arg_min(v, row_key) as v from x where day is not null group by all),
o as (select *, row_number() over w as r, abs(v - lag(v) over w) as step, v is distinct from lag(v) over w as starts from d window w as (partition by src_table, src, field order by day)),
u as (select src_table, src, field, median(step) as usual from o group by all),
g as (select *, sum(starts::int) over (partition by src_table, src, field order by r) as run from o),
stuck as (select src_table, src, field, day from (select *, count(*) over (partition by src_table, src, field, run) as n from g) where n >= 6),
w as (select unnest([1, 2, 3]) as k),
-- one to three readings further than ten usual changes from those on both sides, to which the series returns
s as (select a.src_table, a.src, a.field, a.r as ra, k, a.v as va, b.v as vb, usual from o a join o b on b.src_table = a.src_table and b.src is not distinct from a.src and b.field = a.field join w on b.r = a.r + k + 1
join u on u.src_table = a.src_table and u.src is not distinct from a.src and u.field = a.field),
m as (select s.*, min(least(abs(c.v - va), abs(c.v - vb))) as near from s join o c on c.src_table = s.src_table and c.src is not distinct from s.src and c.field = s.field and c.r > ra and c.r <= ra + k group by all),
spike as (select o.src_table, o.src, o.field, o.day from m join o on o.src_table = m.src_table and o.src is not distinct from m.src and o.field = m.field and o.r > ra and o.r <= ra + k where near > 10 * usual and abs(va - vb) <= greatest(10 * usual, near / 2)),
faulty as (select * from stuck union select * from spike)
select distinct x.src_table, x.row_key, x.field from x left join faulty f on f.src_table = x.src_table and f.src is not distinct from x.src and f.field = x.field and f.day = x.day where x.v <= 0 or f.day is not null"""
SQL = {"p1_found": _DAYS, "p3_grid": _GRID, "p3_found": f"select feed_id, field, grid_day from ({_GRID}) where status <> 'observed'"}
