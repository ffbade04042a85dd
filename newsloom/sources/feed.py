"""The event feed: events and their articles as stored JSON, read with explicit schemas and pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import localized, names_joined, parsed_time, slugify, source_name, word_count
from newsloom.operators.topics import suffixed_slugs

EVENT = "uri string, title map<string,string>, summary map<string,string>, eventDate string, concepts array<struct<label:map<string,string>,type:string>>, totalArticleCount int"
ARTICLE = (
    "event_uri string, uri string, url string, title string, body string, dateTime string, dateTimePub string, sentiment double, sim double,"
    " source struct<uri:string,title:string>, authors array<struct<name:string>>, image string"
)


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def recent_events(spark: SparkSession, path: str, now: str, hours: int = 24, min_articles: int = 2, max_items: int | None = 50) -> DataFrame:
    """Events dated within ``hours`` before ``now`` (whole days) with enough articles, newest first."""
    today = F.lit(now).cast("timestamp")
    since = (today - F.expr(f"INTERVAL {hours} HOURS")).cast("date")
    e = spark.read.schema(EVENT).json(path).where((F.coalesce("uri", F.lit("")) != "") & (F.col("totalArticleCount") >= min_articles))
    e = e.where(F.try_to_timestamp("eventDate").cast("date").between(since, today.cast("date"))).orderBy(F.desc("eventDate"), "uri")
    return e if max_items is None else e.limit(max_items)


def topics_of(events: DataFrame, known: DataFrame) -> DataFrame:
    """New topics: events whose uri isn't in ``known`` (event_registry_uri), titles cut to 300, ten keywords, slug bases of 180 characters."""
    keywords = F.filter(F.transform(F.slice("concepts", 1, 10), lambda c: localized(c["label"])), lambda k: k != "")
    rows = events.join(known.select(F.col("event_registry_uri").alias("uri")), "uri", "left_anti")
    title = F.substring(localized(F.col("title")), 1, 300)
    return rows.where(title != "").select(
        F.col("uri").alias("event_registry_uri"), title.alias("title"), localized(F.col("summary")).alias("description"), F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"), slugify(title, 180).alias("slug_base")
    )


def import_counts(events: DataFrame, known: DataFrame) -> DataFrame:
    """One row: events given, new ones and those skipped since their uri is in ``known`` (event_registry_uri)."""
    marked = events.select("uri").distinct().join(known.select(F.col("event_registry_uri").alias("uri"), F.lit(1).alias("_known")).distinct(), "uri", "left")
    return marked.agg(F.count("*").alias("events"), F.count_if(F.col("_known").isNull()).alias("new"), F.count("_known").alias("skipped"))


def topics_with_articles(events: DataFrame, articles: DataFrame, known: DataFrame, least: int = 1) -> DataFrame:
    """New topics of events that have ``least`` articles at least (event_uri), with slugs that neither each other nor ``known`` (event_registry_uri, slug) has."""
    counts = articles.groupBy(F.col("event_uri").alias("event_registry_uri")).agg(F.count_distinct("event_registry_uri").alias("articles"))
    fresh = topics_of(events, known).join(counts.where(F.col("articles") >= least), "event_registry_uri")
    return suffixed_slugs(fresh, "slug_base", [F.asc("event_registry_uri")], taken=known.select("slug").where("slug is not null"))


def event_articles(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Articles of events; rows without uri, url, source or title go; ``sources`` filters by source uri at the reader.

    Time is dateTime, else dateTimePub, UTC if no zone is named; authors are joined by commas and cut to 300 characters,
    titles to 500, the similarity is the confidence.
    """
    a = spark.read.schema(ARTICLE).json(path)
    needed = [F.col("uri"), F.col("url"), F.col("title"), F.col("source.uri")]
    for c in needed:
        a = a.where(F.coalesce(c, F.lit("")) != "")
    if sources is not None:
        a = a.where(F.col("source.uri").isin(sources))
    return a.select(
        "event_uri", F.col("uri").alias("event_registry_uri"), F.col("url"), F.substring("title", 1, 500).alias("title"), F.coalesce("body", F.lit("")).alias("content"),
        word_count(F.coalesce("body", F.lit(""))).alias("word_count"), F.col("source.uri").alias("source_uri"),
        F.coalesce(_given(F.col("source.title")), source_name(F.col("source.uri"))).alias("source_name"), F.concat(F.lit("https://"), F.col("source.uri")).alias("source_url"),
        names_joined(F.transform("authors", lambda x: x["name"])).alias("author"), parsed_time(F.coalesce(_given(F.col("dateTime")), F.col("dateTimePub"))).alias("published_at"),
        "sentiment", F.coalesce("sim", F.lit(1.0)).alias("confidence_score"), F.coalesce("image", F.lit("")).alias("image_url"),
    )


def new_sources(articles: DataFrame, known: DataFrame) -> DataFrame:
    """Sources of articles that aren't known yet, one row per uri, with a name and a slug base of 45 characters ('source' if empty)."""
    seen = articles.groupBy("source_uri").agg(F.min("source_name").alias("name"), F.min("source_url").alias("website_url"))
    base = slugify(F.col("name"), 45)
    return seen.join(known.select(F.col("event_registry_uri").alias("source_uri")), "source_uri", "left_anti").withColumn("slug_base", F.when(base == "", "source").otherwise(base))
