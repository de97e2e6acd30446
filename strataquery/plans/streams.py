"""Batch forms of the event-time operators; tests hold the stream forms against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.plans.base import Tables, query
from strataquery.streaming import events


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column)).alias(column)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    found = events.tumbling(t.events, "1 day")
    return found.select(_micros("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT epoch_us(b) AS start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY b")
def stream_sliding(t: Tables) -> DataFrame:
    return events.sliding(t.events, "2 hours", "1 hour").select(_micros("start"), "events")


@query("""
WITH n AS (SELECT user_id, epoch_us(ts) AS t0, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, min(t0) AS start, max(t0) + 21600000000 AS "end", count(*) AS events FROM s GROUP BY user_id, session""")
def stream_session(t: Tables) -> DataFrame:
    return events.sessions(t.events, "6 hours").select("user_id", _micros("start"), _micros("end"), "events")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    return events.distinct(t.events, ["user_id", "event_type"]).select("user_id", "event_type")
