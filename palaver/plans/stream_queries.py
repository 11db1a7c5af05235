"""Batch forms of the streaming operators, for comparison with SQL (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.streaming.streams import sessions, windowed_counts
from palaver.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def stream_window_counts(spark, d):
    """Events of each type and hour."""
    return windowed_counts(_events(spark, d), "ts", "event_type")


def stream_sessions(spark, d):
    """Sessions of each user with gaps under half an hour."""
    return sessions(_events(spark, d), "ts", "user_id").select("user_id", "start", "n")


def A02_events_by_day(spark, d):
    """Event types by day with their share of the day."""
    from palaver.operators.labels import shares

    return shares(_events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "event_type")


def F30_props_sum(spark, d):
    """Sum of a number inside JSON text by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, d).groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("n"))


def A25_priority_lift(spark, d):
    """Order priorities by market segment against their overall share."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.select("o_custkey", "o_orderpriority").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    from pyspark.sql.window import Window as W

    g = x.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    t = F.sum("n").over(W.partitionBy(F.lit(1)))
    lift = (F.col("n") / F.sum("n").over(W.partitionBy("c_mktsegment"))) / (F.sum("n").over(W.partitionBy("o_orderpriority")) / t)
    return g.select("c_mktsegment", "o_orderpriority", "n", lift.alias("lift"))


for _f in (stream_window_counts, stream_sessions, A02_events_by_day, F30_props_sum, A25_priority_lift):
    QUERIES[_f.__name__] = _f
SQL["stream_window_counts"] = "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all"
SQL["stream_sessions"] = "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as s from events), y as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from x) select user_id, min(ts) as start, count(*) as n from y group by user_id, k"
SQL["A02_events_by_day"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by strftime(ts, '%Y-%m-%d')) as pct from events group by strftime(ts, '%Y-%m-%d'), event_type"
SQL["F30_props_sum"] = "select event_type, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as k_sum, count(try_cast(json_extract_string(props, '$.k') as bigint)) as n from events group by 1"
SQL["A25_priority_lift"] = "with g as (select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by all) select *, (n * 1.0 / sum(n) over (partition by c_mktsegment)) / (sum(n) over (partition by o_orderpriority) * 1.0 / sum(n) over ()) as lift from g"
