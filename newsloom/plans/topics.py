"""Queries on topics and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import topics as ops
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, NOW, articles, clusters
from newsloom.runtime import table

registry = Registry()
query = registry.add
_FACTS = "facts AS (SELECT topic_id, a.id, source_id, published_at FROM clu JOIN art a ON a.id = article_id)"
_DONE = "done AS (SELECT DISTINCT topic_id FROM clu JOIN article_analysis s USING (article_id) WHERE s.status = 'failed')"


def _done(spark: SparkSession, d: str) -> DataFrame:
    """Topics set aside: those with a failed analysis."""
    failed = table(spark, d, "article_analysis").where("status = 'failed'").select("article_id")
    return clusters(spark, d).join(failed, "article_id").select("topic_id").distinct()


@query(f"""WITH {ART}, {CLU}, {_FACTS}
SELECT t.id AS topic_id, count(f.id) AS article_count, count(DISTINCT source_id) AS source_count, epoch_us(min(f.published_at)) AS first_us, epoch_us(max(f.published_at)) AS last_us
FROM topics t LEFT JOIN facts f ON f.topic_id = t.id GROUP BY t.id""")
def topic_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = ops.topic_metrics(table(spark, d, "topics"), clusters(spark, d), articles(spark, d, "source_id", "published_at"))
    return m.select("topic_id", "article_count", "source_count", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query(f"""WITH {ART}, {CLU}, {_FACTS}, recent AS (SELECT topic_id, count(*) n FROM facts WHERE published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 24 HOUR GROUP BY 1),
s AS (SELECT t.id, coalesce(n, 0) n, coalesce(n, 0) * (1 + CASE WHEN article_count > 0 THEN source_count / article_count ELSE 0 END)
  * CASE WHEN last_article_at IS NULL THEN 1 ELSE greatest(0.1, 1 - (epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last_article_at)) / 3.6e9 / 72) END AS score
  FROM topics t LEFT JOIN recent r ON r.topic_id = t.id)
SELECT id AS topic_id, n AS recent_count, CAST(round_even(score, 2) AS DOUBLE) AS trending_score, score > 2 AS is_trending FROM s""")
def trending_topics(spark: SparkSession, d: str) -> DataFrame:
    return ops.trending(table(spark, d, "topics"), clusters(spark, d), articles(spark, d, "published_at"), NOW)


@query(f"""WITH {ART}, {CLU}, {_FACTS}, {_DONE}
SELECT topic_id, count(DISTINCT source_id) AS distinct_sources FROM facts WHERE topic_id NOT IN (SELECT topic_id FROM done) GROUP BY 1 HAVING count(DISTINCT source_id) >= 3""")
def ready_topics(spark: SparkSession, d: str) -> DataFrame:
    return ops.ready_topics(clusters(spark, d), articles(spark, d, "source_id"), _done(spark, d))


@query(f"""WITH {ART}, {CLU} SELECT topic_id, count(*) - article_count // 2 AS new_articles FROM clu JOIN art a ON a.id = article_id JOIN topics t ON t.id = topic_id
WHERE status = 'complete' AND NOT is_wire_content AND content <> '' GROUP BY topic_id, article_count HAVING count(*) - article_count // 2 >= 3""")
def stale_topics(spark: SparkSession, d: str) -> DataFrame:
    """Against half the stored count of each topic as what was processed."""
    processed = table(spark, d, "topics").select(F.col("id").alias("topic_id"), F.floor(F.col("article_count") / 2).alias("articles_processed"))
    return ops.stale_topics(processed, clusters(spark, d), articles(spark, d, "status", "is_wire_content", "content"))


@query(f"""SELECT id AS topic_id FROM topics WHERE last_article_at < TIMESTAMPTZ '{NOW}+00' - INTERVAL 30 DAY
OR (last_article_at IS NULL AND created_at < TIMESTAMPTZ '{NOW}+00' - INTERVAL 30 DAY)""")
def old_topics(spark: SparkSession, d: str) -> DataFrame:
    return ops.old_topics(table(spark, d, "topics"), NOW).select(F.col("id").alias("topic_id"))


@query(f"WITH {ART}, {CLU}, {_FACTS} SELECT DISTINCT topic_id, source_id, name FROM facts JOIN sources s ON s.id = source_id")
def covering_sources(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "sources").select(F.col("id").alias("source_id"), "name")
    return ops.covering(clusters(spark, d), articles(spark, d, "source_id")).join(names, "source_id")


@query(f"""WITH {ART}, {CLU}, {_FACTS} SELECT t.id AS topic_id, s.id AS source_id FROM topics t, sources s WHERE is_active
EXCEPT SELECT topic_id, source_id FROM facts""")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    covered = ops.covering(clusters(spark, d), articles(spark, d, "source_id"))
    return ops.missing(table(spark, d, "topics"), table(spark, d, "sources"), covered)


@query(f"""WITH {ART}, {CLU}, {_FACTS}, scored AS (SELECT DISTINCT source_id FROM art JOIN article_analysis s ON s.article_id = art.id WHERE leaning_left > 0.5)
SELECT t.id AS topic_id, s.id AS source_id FROM topics t, sources s WHERE is_active AND s.id IN (SELECT source_id FROM scored) EXCEPT SELECT topic_id, source_id FROM facts""")
def notable_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing sources that ever had an article scored (here: one that leans left)."""
    scored = table(spark, d, "article_analysis").where("leaning_left > 0.5").select(F.col("article_id").alias("id"))
    known = articles(spark, d, "source_id").join(scored, "id").select(F.col("source_id").alias("id")).distinct()
    covered = ops.covering(clusters(spark, d), articles(spark, d, "source_id"))
    return ops.missing(table(spark, d, "topics"), table(spark, d, "sources").join(known, "id", "left_semi"), covered)


@query(f"""WITH {CLU}, a AS (SELECT DISTINCT topic_id FROM clu JOIN article_analysis s USING (article_id) WHERE s.status = 'complete')
SELECT t.id AS topic_id, CASE WHEN a.topic_id IS NULL THEN 0 ELSE 1 END AS has_analysis, trending_score FROM topics t LEFT JOIN a ON a.topic_id = t.id
WHERE article_count >= 2 ORDER BY has_analysis DESC, trending_score DESC, t.id LIMIT 6""")
def home_analyzed_first(spark: SparkSession, d: str) -> DataFrame:
    """The top six topics of the front page, analysed ones first."""
    complete = table(spark, d, "article_analysis").where("status = 'complete'").select("article_id")
    analysed = clusters(spark, d).join(complete, "article_id").select(F.col("topic_id").alias("id"), F.lit(1).alias("a")).distinct()
    rows = table(spark, d, "topics").where("article_count >= 2").join(analysed, "id", "left").select(F.col("id").alias("topic_id"), F.coalesce("a", F.lit(0)).alias("has_analysis"), "trending_score")
    return rows.orderBy(F.desc("has_analysis"), F.desc_nulls_first("trending_score"), "topic_id").limit(6)


@query("SELECT id AS topic_id FROM topics WHERE contains(lower(title), 'tribunal') OR contains(lower(description), 'tribunal')")
def search_topics(spark: SparkSession, d: str) -> DataFrame:
    return ops.phrase_search(table(spark, d, "topics"), " Tribunal ", [F.col("title"), F.col("description")]).select(F.col("id").alias("topic_id"))


@query("""SELECT id AS topic_id FROM topics WHERE (contains(lower(title), 'court') OR contains(lower(array_to_string(keywords, ' ')), 'court'))
AND (contains(lower(title), 'e') OR contains(lower(array_to_string(keywords, ' ')), 'e'))""")
def search_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return ops.search(table(spark, d, "topics"), "court, e", [F.col("title"), F.array_join("keywords", " ")]).select(F.col("id").alias("topic_id"))


@query("""SELECT id AS topic_id, row_number() OVER (ORDER BY trending_score DESC NULLS FIRST, last_article_at DESC NULLS FIRST, id) AS place FROM topics""")
def topics_in_default_order(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's place in the default order, nulls first in descending keys.

    Places come from a range-partitioned sort; partition offsets are a count per partition, so no task sees all rows.
    """
    order = [F.desc_nulls_first("trending_score"), F.desc_nulls_first("last_article_at"), F.asc("id")]
    return ops.global_rank(table(spark, d, "topics").select("id", "trending_score", "last_article_at"), order, "place").select(F.col("id").alias("topic_id"), "place")


@query(f"""WITH {ART}, {CLU}, {_FACTS}, f AS (SELECT topic_id, source_id, epoch_us(published_at) us FROM facts WHERE published_at IS NOT NULL),
span AS (SELECT topic_id, min(us) s, max(us) e FROM f GROUP BY 1), g AS (SELECT topic_id, source_id, min(us) us, count(*) n FROM f GROUP BY 1, 2)
SELECT topic_id, source_id, n AS article_count, CAST(round_even((us - s) / 1e6 / greatest((e - s) / 1e6, 1.0) * 100, 1) AS DOUBLE) AS offset_pct, CAST(floor((us - s) / 6e7) AS BIGINT) AS delta_minutes
FROM g JOIN span USING (topic_id)""")
def publication_timeline(spark: SparkSession, d: str) -> DataFrame:
    facts = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(articles(spark, d, "source_id", "published_at"), "id")
    return ops.timeline(facts)


@query("""WITH b AS (SELECT id, left(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 12) AS base FROM topics),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) r FROM b) SELECT id AS topic_id, CASE WHEN r = 1 THEN base ELSE base || '-' || (r - 1) END AS slug FROM n""")
def slug_dedup(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "topics").select(F.col("id").alias("topic_id"), text.slugify(F.col("title"), 12).alias("base"))
    return ops.suffixed_slugs(base, "base", [F.asc("topic_id")]).select("topic_id", "slug")


@query("SELECT id AS topic_id, array_to_string(keywords[1:5], ', ') AS first_keywords, upper(left(title, 3)) AS short, left(title, 60) AS title60, coalesce(nullif(event_registry_uri, ''), 'none') AS event FROM topics")
def topic_cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics").select(
        F.col("id").alias("topic_id"),
        F.array_join(F.slice("keywords", 1, 5), ", ").alias("first_keywords"),
        F.upper(F.substring("title", 1, 3)).alias("short"),
        F.substring("title", 1, 60).alias("title60"),
        F.coalesce(F.nullif("event_registry_uri", F.lit("")), F.lit("none")).alias("event"),
    )
