"""The work queue and running cells over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.sources.tables import table
from landloom.streaming.queue import claims, item_states, queue_state, running_cells

ACTIONS = {"signup": "populate", "click": "claim", "view": "heartbeat", "error": "release", "purchase": "complete"}
WORKERS = 3


def queue_log(events: DataFrame) -> DataFrame:
    """Events as a queue's log: an item is a user's day."""
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("event_type"))
    return events.select((F.col("user_id") % 25).alias("county_id"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("item"), (F.col("event_id") % 7).alias("worker"), action.alias("action"), "ts", F.col("event_id").alias("seq"))


def tax_changes(events: DataFrame) -> DataFrame:
    """Purchases as tax changes; users stand for places."""
    return events.where("event_type = 'purchase'").select(F.col("event_id").alias("record"), "ts", (F.col("user_id") % 11).alias("ix"), F.floor(F.col("user_id") / 11).alias("iy"), F.col("value").alias("amount"))


def st2_queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item at noon of the last day."""
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg((F.date_trunc("DAY", F.max("ts")) + F.expr("INTERVAL 12 HOURS")).alias("now")))  # one row
    return queue_state(item_states(queue_log(events)).join(now), F.col("now"))


def st4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each county's workers claim next."""
    return claims(st2_queue_states(spark, sf_dir), WORKERS)


def st7_running_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all changes, each fed twice."""
    changes = tax_changes(table(spark, sf_dir, "events"))
    return running_cells(changes.unionByName(changes))


QUERIES = {f.__name__: f for f in (st2_queue_states, st4_claims, st7_running_cells)}
_STATES = """WITH l AS (SELECT user_id % 25 AS county_id, user_id * 100 + day(ts) AS item, event_id % 7 AS worker, event_type AS e, ts, event_id FROM events),
  s AS (SELECT county_id, item, max(e = 'purchase') AS done, arg_max(e, (ts, event_id)) FILTER (e IN ('click', 'error')) AS d, arg_max(worker, (ts, event_id)) FILTER (e IN ('click', 'error')) AS w, max(ts) FILTER (e IN ('click', 'error')) AS dts, max(ts) FILTER (e = 'view') AS beat FROM l GROUP BY ALL),
  t AS (SELECT *, CASE WHEN d = 'click' THEN greatest(dts, beat) END AS alive, (SELECT date_trunc('day', max(ts)) + INTERVAL 12 HOUR FROM events) AS now FROM s),
  q AS (SELECT county_id, item, CASE WHEN done THEN 'done' WHEN alive < now - INTERVAL 10 MINUTE THEN 'stale' WHEN d = 'click' THEN 'claimed' ELSE 'pending' END AS status, w, alive FROM t)"""
ORACLES = {
    "st2_queue_states": f"{_STATES} SELECT county_id, item, status, CASE WHEN status IN ('claimed', 'stale') THEN w END AS worker, CASE WHEN status IN ('claimed', 'stale') THEN alive END AS claimed_at FROM q",
    "st4_claims": f"{_STATES} SELECT county_id, item, ((nth - 1) // 10)::INT AS worker, nth FROM (SELECT *, row_number() OVER (PARTITION BY county_id ORDER BY item) AS nth FROM q WHERE status IN ('pending', 'stale')) WHERE nth <= 30",
    "st7_running_cells": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id % 11 AS ix, user_id // 11 AS iy, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY ALL",
}
