"""Scheduled jobs as Structured Streaming: idempotent ingest, windowed counts, sessions, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.sources.sinks import insert_absent


def file_stream(spark: SparkSession, path: str, schema, file_format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder or pattern as a stream; the schema is given, never inferred."""
    r = spark.readStream.format(file_format).schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there in batches and end; progress is kept in ``checkpoint``, so a restart goes on where it stopped."""
    q = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest_once(spark: SparkSession, stream: DataFrame, key: str, table_path: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Appends rows whose key isn't stored yet; the batch's own repeats count once. Rerun batches add nothing.

    The table is partitioned by a hash of the key, so a batch reads the keys of its own buckets only, and no other column.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        stored = rows.limit(0)
        if _exists(spark, table_path):
            mine = [r[0] for r in rows.select("bucket").distinct().collect()]
            stored = spark.read.schema(rows.schema).parquet(table_path).where(F.col("bucket").isin(mine))
        insert_absent(stored, rows, [key]).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table_path)

    return run_available(stream, each, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/*.parquet"))) > 0


def tumbling_counts(stream: DataFrame, by: list[str], time: str = "ts", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per slide, the state from which windows of any length are made; rows later than ``late`` are dropped in append mode."""
    return stream.withWatermark(time, late).groupBy(F.window(time, slide).alias("w"), *by).agg(F.count("*").alias("events"))


def sliding_counts(buckets: DataFrame, by: list[str], length_s: int = 86_400, slide_s: int = 900) -> DataFrame:
    """(start_us, by..., events) per sliding window, from counts per slide (w, by..., events): a row a slide is expanded, not a row an event."""
    at = F.unix_micros("w.start")
    starts = F.sequence(at - (length_s - slide_s) * 1_000_000, at, F.lit(slide_s * 1_000_000).cast("long"))
    return buckets.select(F.explode(starts).alias("start_us"), *by, "events").groupBy("start_us", *by).agg(F.sum("events").alias("events"))


def sessions(stream: DataFrame, by: str, time: str = "ts", gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("events"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Repeats within the watermark go, with bounded state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def expired(topics: DataFrame, now: str, days: int = 30) -> DataFrame:
    """State to drop: topics quiet for ``days`` (or never active and created that long ago)."""
    from newsloom.operators.topics import old_topics

    return old_topics(topics, now, days)


def reopened(topics: DataFrame, late: DataFrame, pools: DataFrame, least: int = 3) -> DataFrame:
    """(topic_id, article_count, rebuild) of the topics a batch of ``late`` articles (topic_id, article_id) belongs to: their new counts, and whether the pool, built over ``pools.articles`` articles, is ``least`` or more behind. For foreachBatch."""
    new = late.groupBy("topic_id").agg(F.count_distinct("article_id").alias("new"))
    rows = topics.select(F.col("id").alias("topic_id"), F.col("article_count").alias("before")).join(new, "topic_id").join(pools.select("topic_id", F.col("articles").alias("built")), "topic_id", "left")
    count = F.coalesce("before", F.lit(0)) + F.col("new")
    return rows.select("topic_id", count.alias("article_count"), (F.col("built").isNotNull() & (count - F.col("built") >= least)).alias("rebuild"))


def backfill(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not processed yet, for periodic jobs."""
    return rows.join(done.select(key), key, "left_anti")
