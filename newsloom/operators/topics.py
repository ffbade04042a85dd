"""Topic metrics, trending, readiness, coverage by sources, search and paging. All are DataFrame -> DataFrame.

Conventions: ``articles`` has one row per id, ``clusters`` one row per (topic_id, article_id). Null keys never join;
empty tables give empty results (metrics of topics: zeros and nulls).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import materialize


def topic_metrics(topics: DataFrame, clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(topic_id, article_count, source_count, first_at, last_at); topics without articles have 0, 0 and nulls."""
    facts = clusters.select("topic_id", "article_id").join(articles.select(F.col("id").alias("article_id"), "source_id", "published_at"), "article_id")
    counted = facts.groupBy("topic_id").agg(
        F.count("*").alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")
    )
    zero = F.lit(0).cast("long")
    return topics.select(F.col("id").alias("topic_id")).join(counted, "topic_id", "left").select(
        "topic_id", F.coalesce("article_count", zero).alias("article_count"), F.coalesce("source_count", zero).alias("source_count"), "first_at", "last_at"
    )


def trending(topics: DataFrame, clusters: DataFrame, articles: DataFrame, now: str, window_hours: int = 24, decay_hours: int = 72, floor: float = 0.1, cut: float = 2.0) -> DataFrame:
    """(topic_id, recent_count, trending_score, is_trending).

    recent articles x (1 + sources / articles, 0 where there are no articles) x decay; the decay falls from 1 to ``floor``
    over ``decay_hours`` since the last article and is 1 if there is none. Scores are rounded half to even, the cut is
    taken before rounding.
    """
    at = F.lit(now).cast("timestamp")
    recent = (
        articles.where(F.col("published_at") >= at - F.expr(f"INTERVAL {window_hours} HOURS"))
        .select(F.col("id").alias("article_id"))
        .join(clusters.select("topic_id", "article_id"), "article_id")
        .groupBy("topic_id")
        .agg(F.count("*").alias("recent_count"))
    )
    hours = (F.unix_micros(at) - F.unix_micros("last_article_at")) / 3.6e9
    diversity = F.when(F.col("article_count") > 0, F.col("source_count") / F.nullif(F.col("article_count"), F.lit(0))).otherwise(0.0)
    decay = F.when(F.col("last_article_at").isNull(), 1.0).otherwise(F.greatest(F.lit(floor), 1 - hours / decay_hours))
    count = F.coalesce("recent_count", F.lit(0).cast("long"))
    scored = topics.join(recent.withColumnRenamed("topic_id", "id"), "id", "left").select(F.col("id").alias("topic_id"), count.alias("recent_count"), (count * (1 + diversity) * decay).alias("score"))
    return scored.select("topic_id", "recent_count", F.bround("score", 2).alias("trending_score"), (F.col("score") > cut).alias("is_trending"))


def ready_topics(clusters: DataFrame, articles: DataFrame, done: DataFrame, min_sources: int = 3) -> DataFrame:
    """Topics with at least ``min_sources`` distinct sources that aren't in ``done`` (topic_id)."""
    counted = clusters.select("topic_id", "article_id").join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id")
    enough = counted.groupBy("topic_id").agg(F.count_distinct("source_id").alias("distinct_sources")).where(F.col("distinct_sources") >= min_sources)
    return enough.join(done.select("topic_id"), "topic_id", "left_anti")


def stale_topics(processed: DataFrame, clusters: DataFrame, articles: DataFrame, min_new: int = 3) -> DataFrame:
    """(topic_id, new_articles) where at least ``min_new`` usable articles came since ``processed`` (topic_id, articles_processed)."""
    usable = articles.where((F.col("status") == "complete") & ~F.col("is_wire_content") & (F.col("content") != "")).select(F.col("id").alias("article_id"))
    now = clusters.select("topic_id", "article_id").join(usable, "article_id").groupBy("topic_id").agg(F.count("*").alias("n"))
    return processed.join(now, "topic_id").select("topic_id", (F.col("n") - F.col("articles_processed")).alias("new_articles")).where(F.col("new_articles") >= min_new)


def old_topics(topics: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Topics whose last article - or creation, if there is none - is older than ``days``."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return topics.where((F.col("last_article_at") < cutoff) | (F.col("last_article_at").isNull() & (F.col("created_at") < cutoff)))


def covering(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct (topic_id, source_id)."""
    return clusters.select("topic_id", "article_id").join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").select("topic_id", "source_id").distinct()


def missing(topics: DataFrame, sources: DataFrame, covered: DataFrame, most_sources: int = 10_000) -> DataFrame:
    """(topic_id, source_id) of active sources without an article on the topic.

    The result is of the order topics x sources by nature. Sources are a small dimension: their ids (at most
    ``most_sources``, checked) become a constant, and each topic's covered set is taken from it; nothing is cross joined.
    """
    ids = [r[0] for r in sources.where("is_active").select("id").distinct().limit(most_sources + 1).collect()]
    if len(ids) > most_sources:
        raise ValueError(f"more than {most_sources} active sources")
    wanted = F.array(*[F.lit(i).cast("long") for i in sorted(ids)]).cast("array<bigint>")
    seen = covered.groupBy("topic_id").agg(F.collect_set("source_id").alias("seen"))
    none = F.array().cast("array<bigint>")
    return topics.select(F.col("id").alias("topic_id")).join(seen, "topic_id", "left").select("topic_id", F.explode(F.array_except(wanted, F.coalesce("seen", none))).alias("source_id"))


def search(df: DataFrame, terms: str, fields: list[Column]) -> DataFrame:
    """Rows in which every term (separated by blanks or commas) occurs in some field, case aside; no term gives all rows."""
    out = df
    for term in terms.replace(",", " ").split():
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(term.lower())), F.lit(False)) for f in fields]))
    return out


def phrase_search(df: DataFrame, phrase: str, fields: list[Column], min_length: int = 2) -> DataFrame:
    """Rows in some field of which the trimmed phrase occurs, case aside; too short a phrase gives none."""
    p = phrase.strip().lower()
    if len(p) < min_length:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(p)), F.lit(False)) for f in fields]))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page of the rows in ``order``; TakeOrderedAndProject, so only the first pages' rows are gathered."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers over the whole table without one task holding it: ranks within range partitions plus the rows before.

    Only the partitions' counts, one row each, meet in one task.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes each partition to k rows per group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def last_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group in ``order``: what a dictionary filled in that order keeps."""
    back = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(back)).withColumn("_m", F.count("*").over(Window.partitionBy(*by))).where("_n = _m").drop("_n", "_m")


def suffixed_slugs(df: DataFrame, base: str, order: list[Column], start: int = 1, taken: DataFrame | None = None) -> DataFrame:
    """``slug``: the base for its first row, base-<n> for the others, n the next free number from ``start`` on.

    Slugs in ``taken`` (column slug) aren't given again, nor is a numbered slug that is another row's base.
    """
    bases = df.select(F.col(base).alias("slug")).where("slug is not null")
    used = (bases if taken is None else bases.unionByName(taken.select("slug"))).distinct()
    numbers = used.select(F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1).alias(base), F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2).try_cast("long").alias("_n")).where("_n is not null")
    gone = numbers.groupBy(base).agg(F.array_sort(F.collect_set("_n")).alias("_gone"))
    own = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    rows = df.withColumn("_k", own).join(gone, base, "left")
    if taken is not None:
        rows = rows.join(taken.select(F.col("slug").alias(base), F.lit(1).alias("_stored")).distinct(), base, "left").withColumn("_k", F.col("_k") + F.coalesce("_stored", F.lit(0))).drop("_stored")
    first = (F.col("_k") - 2 + start).cast("long")
    free = F.aggregate(F.coalesce("_gone", F.array().cast("array<bigint>")), first, lambda n, used_n: F.when((used_n >= start) & (used_n <= n), n + 1).otherwise(n))
    return rows.withColumn("slug", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), free.cast("string")))).drop("_k", "_gone")


def round_robin(df: DataFrame, label: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows taken in turn from each label, labels in their order; a balanced sample."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", label).limit(limit)


def timeline(df: DataFrame) -> DataFrame:
    """First publication of each source on each topic, from (topic_id, source_id, id, published_at); null times are left out.

    offset_pct is the place in the topic's span (at least a second) in per cent, delta_minutes the whole minutes since
    its start, article_count the source's articles.
    """
    dated = df.where("published_at is not null").withColumn("us", F.unix_micros("published_at"))
    spans = dated.groupBy("topic_id").agg(F.min("us").alias("start"), F.max("us").alias("stop"))
    first = dated.groupBy("topic_id", "source_id").agg(F.min("us").alias("us"), F.count("*").alias("article_count"))
    since = F.col("us") - F.col("start")
    return first.join(spans, "topic_id").select(
        "topic_id",
        "source_id",
        "article_count",
        F.bround(since / 1e6 / F.greatest((F.col("stop") - F.col("start")) / 1e6, F.lit(1.0)) * 100, 1).alias("offset_pct"),
        F.floor(since / 6e7).cast("long").alias("delta_minutes"),
    )


def ordered_by(df: DataFrame, wanted: str, allowed: list[str], default: list[Column]) -> DataFrame:
    """Rows in the order a caller names ('-' for descending, commas between); names that aren't allowed are ignored.

    Descending keys put nulls first, ascending ones last; without an allowed name the default order holds.
    """
    order = []
    for name in wanted.split(","):
        key = name.strip().lstrip("-")
        if key in allowed:
            order.append(F.desc_nulls_first(key) if name.strip().startswith("-") else F.asc_nulls_last(key))
    return df.orderBy(*(order or default))


def numeric_first(text: Column) -> list[Column]:
    """Order of a table column of texts: numbers by value, then the rest by text."""
    number = F.regexp_replace(text, "[%, ]", "").try_cast("double")
    return [F.asc_nulls_last(number), F.lower(text).asc()]


def with_nested(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with an array of their children as structs, in order; empty where there are none."""
    fields = [c for c in children.columns if c != child_key]
    first = [*order, *[c for c in fields if c not in order]]
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))
