"""Streams drained over the event feed; complete and update modes give what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.plans.common import EV, HOUR, events
from weftline.plans.registry import CORE
from weftline.streaming.feeds import drained, feed
from weftline.streaming.operators import absence, distinct_within, sessions, sliding, tumbling

add = CORE.add


def _us(c: str):
    return F.unix_micros(c)


@add("q_stream_tumbling", f"with {EV} select us // {24 * HOUR} as day, event_type, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2")
def q_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows per type, in complete mode: the tail isn't held back by the watermark."""
    t = drained(tumbling(feed(spark, d, "events", "ts", "1 hour"), "ts", "1 day", ["event_type"], "value"), "complete")
    return t.select(F.floor(_us("start") / (24 * HOUR)).alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@add("q_stream_sliding", f"with {EV}, w as (select event_type, unnest([us // {HOUR}, us // {HOUR} - 1]) as h from ev) select h, event_type, count(*) as n from w group by 1, 2")
def q_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Two-hour windows each hour."""
    t = drained(sliding(feed(spark, d, "events", "ts", "1 hour"), "ts", "2 hours", "1 hour", ["event_type"]), "complete")
    return t.select(F.floor(_us("start") / HOUR).alias("h"), "event_type", "n")


@add("q_stream_session", f"with {EV}, b as (select *, case when us - lag(us) over (partition by user_id order by us) > {6 * HOUR} then 1 else 0 end as k from ev), g as (select *, sum(k) over (partition by user_id order by us rows unbounded preceding) as s from b) select user_id, min(us) as start_us, count(*) as n from g group by user_id, s")
def q_stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with pauses of six hours at most, in complete mode."""
    t = drained(sessions(feed(spark, d, "events", "ts", "1 hour"), "ts", "6 hours", ["user_id"]), "complete")
    return t.select("user_id", _us("start").alias("start_us"), "n")


@add("q_stream_dedup", f"with {EV} select event_id, user_id from ev")
def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, though every file is delivered twice."""
    once = feed(spark, d, "events", "ts", "2 hours")
    twice = once.unionByName(feed(spark, d, "events", "ts", "2 hours"))
    return drained(distinct_within(twice, ["event_id"]).select("event_id", "user_id"), "append")


@add("q_stream_absence", f"with {EV}, a as (select *, case when event_type = 'view' then 1 else 0 end as present, sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as g from ev), r as (select user_id, us, row_number() over (partition by user_id, g order by us, event_id) - (case when g > 0 then 1 else 0 end) as run, present from a) select user_id, us, 6 as n from r where present = 0 and run % 6 = 0")
def q_stream_absence(spark: SparkSession, d: str) -> DataFrame:
    """A user without a view for six events in a row."""
    s = feed(spark, d, "events", "ts", "1 hour").withColumn("here", F.col("event_type") == "view").select("user_id", "ts", "event_id", "here")
    return drained(absence(s, "user_id", "ts", "here", 6, "event_id"), "append").select(F.col("key").alias("user_id"), _us("at").alias("us"), "n")


@add("q_batch_sessions", f"with {EV}, b as (select *, case when us - lag(us) over (partition by user_id order by us) > {6 * HOUR} then 1 else 0 end as k from ev), g as (select *, sum(k) over (partition by user_id order by us rows unbounded preceding) as s from b) select user_id, count(distinct s) as n_sessions from g group by 1")
def q_batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin, by session_window."""
    ev = events(spark, d).withColumn("t", F.timestamp_micros("us"))
    return ev.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))
