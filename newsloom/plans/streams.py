"""Queries that run a stream to its end over the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.registry import Registry
from newsloom.runtime import scratch, table
from newsloom.streaming import jobs

registry = Registry()
query = registry.add


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return jobs.file_stream(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts kept in complete mode: each batch overwrites the result with the state so far."""
    base = scratch(spark, "stream")
    counts = _events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"))
    flat = counts.select(F.unix_micros("w.start").alias("day_us"), "event_type", "events")
    jobs.run_available(flat, lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/checkpoint", "complete")
    return spark.read.schema("day_us bigint, event_type string, events bigint").parquet(f"{base}/out")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_first_events(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent ingest: one row per user and type, the least of the batch in which it first came."""
    base = scratch(spark, "stream")
    rows = _events(spark, d).select(F.concat_ws("/", "user_id", "event_type").alias("key"), "event_id", "user_id", "event_type")
    jobs.ingest_once(spark, rows, "key", f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("key string, event_id bigint, user_id bigint, event_type string").parquet(f"{base}/out").select("user_id", "event_type", "event_id")


@query("""WITH w AS (SELECT unnest(range(epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - 86400000000 + 900000000, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) + 1, 900000000)) AS s, event_type FROM events)
SELECT s AS start_us, event_type, CAST(count(*) AS BIGINT) AS events FROM w GROUP BY 1, 2""")
def sliding_24h_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in windows of 24 hours that start every 15 minutes; the stream keeps counts per 15 minutes."""
    base = scratch(spark, "stream")
    counts = jobs.tumbling_counts(_events(spark, d), ["event_type"])
    jobs.run_available(counts, lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/checkpoint", "complete")
    kept = spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, events bigint").parquet(f"{base}/out")
    return jobs.sliding_counts(kept, ["event_type"])


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
SELECT s.event_id AS signup_id, p.event_id AS purchase_id, p.t - s.t AS delay_us FROM s JOIN p ON s.user_id = p.user_id AND p.t BETWEEN s.t AND s.t + 86400000000""")
def stream_signups_to_purchases(spark: SparkSession, d: str) -> DataFrame:
    """A stream-stream join: purchases within a day of a signup of the same user; watermarks bound the state on both sides."""
    base = scratch(spark, "stream")
    e = _events(spark, d)
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("user_id").alias("u"), F.col("ts").alias("t0")).withWatermark("t0", "1 hour")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("t1")).withWatermark("t1", "1 hour")
    both = s.join(p, F.expr("u = user_id AND t1 >= t0 AND t1 <= t0 + INTERVAL 24 HOURS"))
    rows = both.select("signup_id", "purchase_id", (F.unix_micros("t1") - F.unix_micros("t0")).alias("delay_us"))
    jobs.run_available(rows, lambda batch, _: batch.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.schema("signup_id bigint, purchase_id bigint, delay_us bigint").parquet(f"{base}/out")
