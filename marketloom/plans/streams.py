"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.plans.views import query
from marketloom.streaming import states, stores


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    rows = stores.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    return stores.ledger(rows, "user_id").select("user_id")


@query("stream_upsert", "SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf_dir):
    rows = stores.stream_of(spark, f"{sf_dir}/events.parquet").select("event_type", "user_id", "event_id", "value")
    return stores.upserted(rows, ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id", F.col("value"))


@query("stream_prelim_final", "SELECT user_id, count(*) FILTER (event_type = 'purchase') = 0 AS preliminary, coalesce(arg_max(event_id, event_id) FILTER (event_type = 'purchase'), max(event_id)) AS event_id FROM events GROUP BY 1")
def stream_prelim_final(spark, sf_dir):
    """A user's purchases as final documents, other events as preliminary ones."""
    rows = stores.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", (F.col("event_type") != "purchase").alias("preliminary"), "event_id")
    return states.documents(rows, "user_id", "preliminary", "event_id", stores.shared_dir(spark))


@query("stream_bars", "SELECT sym, ts, o, h, l, c, v, ts + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS provisional FROM hbars", "hbars")
def stream_bars(spark, sf_dir):
    rows = stores.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("sym"), "ts", "value", F.col("event_id").alias("id"))
    return states.forming_bars(rows, stores.shared_dir(spark), "6 hours").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
