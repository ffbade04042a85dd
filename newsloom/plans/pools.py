"""Queries on pools of facts and topic reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import cluster, pools, scores, topics
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, articles, clusters
from newsloom.runtime import materialize, table

registry = Registry()
query = registry.add
_NUG = """nug AS (SELECT p_brand AS pool_id, p_partkey AS id, p_size % 3 AS theme_order, nullif(p_size % 4, 0) AS tier, CAST(floor(p_retailprice) AS BIGINT) % 7 AS source_count, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_type END AS theme FROM part)"""
_POS = f"{_NUG}, pos AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY theme_order, tier NULLS LAST, source_count DESC, id) AS position FROM nug)"


def _nuggets(spark: SparkSession, d: str) -> DataFrame:
    """Parts as facts: the brand is the pool."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_brand").alias("pool_id"), F.col("p_partkey").alias("id"), (size % 3).alias("theme_order"), F.nullif(size % 4, F.lit(0)).alias("tier"), (F.floor("p_retailprice") % 7).alias("source_count"),
        F.when(size % 5 == 0, " ").otherwise(F.col("p_type")).alias("theme"), F.col("p_name").alias("fact"),
    )


@query(f"WITH {_POS} SELECT pool_id, id, position, (position - 1) // 30 AS chunk FROM pos")
def ordered_nuggets(spark: SparkSession, d: str) -> DataFrame:
    return pools.ordered(_nuggets(spark, d)).select("pool_id", "id", "position", "chunk")


@query(f"WITH {_NUG} SELECT pool_id, id, CASE WHEN tier = 1 AND row_number() OVER (PARTITION BY pool_id, tier ORDER BY source_count DESC, id) > 5 THEN 2 ELSE tier END AS tier FROM nug")
def retiered_nuggets(spark: SparkSession, d: str) -> DataFrame:
    return pools.retiered(_nuggets(spark, d)).select("pool_id", "id", "tier")


@query(f"WITH {_POS} SELECT pool_id, coalesce(nullif(trim(theme), ''), 'Uncategorized') AS theme, min(position) AS first_position, count(*) AS nuggets FROM pos GROUP BY 1, 2")
def theme_groups(spark: SparkSession, d: str) -> DataFrame:
    return pools.theme_groups(pools.ordered(_nuggets(spark, d)))


@query(f"WITH {_NUG} SELECT pool_id, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3, count(*) FILTER (tier IS NULL) AS untiered FROM nug GROUP BY 1")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    tier = F.col("tier")
    return _nuggets(spark, d).groupBy("pool_id").agg(*[F.count_if(tier == n).alias(f"tier{n}") for n in (1, 2, 3)], F.count_if(tier.isNull()).alias("untiered"))


@query("""WITH n AS (SELECT p_brand AS pool_id, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT pool_id, 'Facts:' || chr(10) || string_agg(i || '. ' || p_name, chr(10) ORDER BY i) AS prompt FROM n GROUP BY 1""")
def fact_prompts(spark: SparkSession, d: str) -> DataFrame:
    return pools.numbered_prompt(_nuggets(spark, d), ["id"], "fact", "Facts:")


_S = r"""string_split_regex(regexp_replace(regexp_replace(content, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '([.!?])[\s\x{00a0}]+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(rf"""WITH {ART}, p AS (SELECT id, unnest({_S}) AS s FROM art), q AS (SELECT id, s FROM p WHERE len(list_filter(regexp_split_to_array(s, '[\s\x{{00a0}}]+'), lambda w: w <> '')) >= 5)
SELECT id AS article_id, count(*) AS sentence_count, count(*) FILTER (contains(s, '"')) AS subjective_count, CAST(round_even(count(*) FILTER (contains(s, '"')) / count(*), 4) AS DOUBLE) AS subjectivity_ratio,
CAST(round_even(count(*) FILTER (len(s) > 100) / count(*), 4) AS DOUBLE) AS mean_confidence FROM q GROUP BY 1""")
def tone_scores(spark: SparkSession, d: str) -> DataFrame:
    """Tone by a stand-in classifier: quotations are subjective, long sentences sure."""
    a = articles(spark, d, "content")
    s = F.col("sentence")
    return pools.sentence_scores(a, s.contains('"'), F.when(F.length(s) > 100, 1.0).otherwise(0.0)).withColumnRenamed("id", "article_id")


@query()
def consensus_pools(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline with stand-ins: facts, clusters, importance, judgments, scores of each article. Order-dependent, so without SQL."""
    a = articles(spark, d, "source_id", "content", "status", "is_wire_content").where("status = 'complete' and not is_wire_content and content != ''")
    rows = a.join(clusters(spark, d).select(F.col("topic_id").alias("pool_id"), F.col("article_id").alias("id")), "id")
    rows = rows.select("pool_id", F.col("id").alias("article_id"), F.col("source_id").cast("string").alias("source"), "content")
    facts = pools.raw_facts(rows).withColumn("fact_id", pools.fact_id(F.col("article_id"), F.col("n")))
    vectors = facts.withColumn("vector", pools.hashed_vector(F.col("fact")))
    found = materialize(cluster.greedy_clusters(vectors, "pool_id", "fact_id", "vector", "source", 0.85), "pool-clusters")
    sizes = rows.groupBy("pool_id").agg(F.count("*").alias("articles"))
    nuggets = pools.consensus_facts(found, facts.select("pool_id", "fact_id", "source", "fact"), sizes).withColumn("id", F.col("cluster_id"))
    labels = pools.judged(rows.select("pool_id", "article_id", "content"), nuggets)
    return scores.with_scores(scores.judgment_counts(labels, ["pool_id", "article_id"]))


@query(f"""WITH {ART}, {CLU}, f AS (SELECT topic_id, s.name, a.id, published_at FROM clu JOIN art a ON a.id = article_id JOIN sources s ON s.id = source_id)
SELECT t.id AS topic_id, t.title, count(f.id) AS articles, (SELECT string_agg(n, ', ' ORDER BY n) FROM (SELECT DISTINCT name AS n FROM f WHERE topic_id = t.id)) AS covering,
(SELECT count(*) FROM sources WHERE is_active AND name NOT IN (SELECT name FROM f WHERE topic_id = t.id)) AS missing FROM topics t LEFT JOIN f ON f.topic_id = t.id GROUP BY t.id, t.title""")
def topic_reports(spark: SparkSession, d: str) -> DataFrame:
    """Of each topic: articles, the names of covering sources, how many active sources are missing."""
    t, s = table(spark, d, "topics"), table(spark, d, "sources")
    a, c = articles(spark, d, "source_id", "published_at"), clusters(spark, d)
    m = topics.topic_metrics(t, c, a).select("topic_id", F.col("article_count").alias("articles"))
    covered = topics.covering(c, a)
    names = covered.join(s.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("covering"))
    gone = topics.missing(t, s, covered).groupBy("topic_id").agg(F.count("*").alias("missing"))
    rows = t.select(F.col("id").alias("topic_id"), "title").join(m, "topic_id").join(names, "topic_id", "left").join(gone, "topic_id", "left")
    return rows.withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))


@query()
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's report with its timeline as one JSON text; text layout differs between engines, so without SQL."""
    facts = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(articles(spark, d, "source_id", "published_at"), "id")
    line = topics.timeline(facts).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("offset_pct", "source_id", "delta_minutes", "article_count"))).alias("timeline"))
    return pools.as_json(topic_reports(spark, d).join(line, "topic_id", "left"), "topic_id")


@query("""SELECT p_brand AS pool_id, CAST(round_even(avg(p_size % 5 + 1), 4) AS DOUBLE) AS average, count(*) FILTER (p_size % 5 + 1 >= 4.5) AS excellent, count(*) FILTER (p_size % 5 + 1 >= 3.5 AND p_size % 5 + 1 < 4.5) AS good,
CAST(round_even(100 * count(*) FILTER (p_size % 5 + 1 >= 3.5) / count(*), 2) AS DOUBLE) AS good_pct FROM part GROUP BY 1""")
def summary_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of judged summaries (here from part sizes): mean, histogram, share of good ones."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("pool_id"), (F.col("p_size") % 5 + 1).alias("score")).withColumn("rating", scoring.rating(F.col("score")))
    is_ = lambda x: F.count_if(F.col("rating") == x)
    return rows.groupBy("pool_id").agg(
        F.bround(F.avg("score"), 4).alias("average"), is_("Excellent").alias("excellent"), is_("Good").alias("good"), F.bround(100 * (is_("Excellent") + is_("Good")) / F.count("*"), 2).alias("good_pct")
    )
