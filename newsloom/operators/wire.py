"""Wire copy: by-line flags, components of republished articles, first-published-wins duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import is_wire_copy, wire_service
from newsloom.operators.components import connected_components
from newsloom.operators.similar import SimilarTexts, similar_texts
from newsloom.runtime import materialize

#: articles: id, source_host, author, content, published_at, is_wire_content, wire_original_id; topics: topic_id, article_id


def byline_flags(articles: DataFrame) -> DataFrame:
    """is_wire_content set anew from by-line and host alone: set and cleared."""
    return articles.withColumn("is_wire_content", is_wire_copy(F.col("author"), F.col("source_host")))


def _in_topics(articles: DataFrame, topics: DataFrame) -> DataFrame:
    own = topics.select("topic_id", F.col("article_id").alias("id"))
    return articles.join(own, "id").where("content is not null and content != ''")


def wire_edges(in_topics: DataFrame, similar: SimilarTexts) -> DataFrame:
    """(a, b) of articles: each to the least of its class, class heads to linked heads, and each to the least article of its topic with the same service."""
    m = similar.members
    heads = m.groupBy("grp", "class").agg(F.min("id").alias("head"))
    to_head = m.join(heads, ["grp", "class"]).where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    linked = similar.links.join(heads.withColumnsRenamed({"class": "a", "head": "x"}), ["grp", "a"]).join(heads.withColumnsRenamed({"class": "b", "head": "y"}), ["grp", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    named = in_topics.select(F.col("topic_id").alias("grp"), "id", wire_service(F.col("author")).alias("service")).where("service is not null").join(m.select("grp", "id"), ["grp", "id"], "left_semi")
    least = named.groupBy("grp", "service").agg(F.min("id").alias("head"))
    by_service = named.join(least, ["grp", "service"]).where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return to_head.unionByName(linked).unionByName(by_service)


def wire_components(articles: DataFrame, topics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, root) of articles that are republications of each other within a topic, the root the least id of the component."""
    inside = materialize(_in_topics(articles, topics), "wire-articles")
    return connected_components(wire_edges(inside, similar_texts(inside, "topic_id", "id", "content", threshold))).withColumnRenamed("node", "id")


def flag_wire(articles: DataFrame, topics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, is_wire_content, wire_original_id) of all articles after the full pass.

    1. By-lines flag articles that aren't flagged yet, hosts that are services aside.
    2. In each component the anchor is the first article, by time and id, that neither is flagged nor has a wire by-line
       (on any host), else the first of all; null times come last. All others are flagged and point to the anchor; the
       anchor points nowhere. Articles outside components keep what they have.
    """
    flagged = articles.withColumn("is_wire_content", F.coalesce("is_wire_content", F.lit(False)) | is_wire_copy(F.col("author"), F.col("source_host")))
    roots = materialize(wire_components(articles, topics, threshold), "wire-components")
    wire = F.col("is_wire_content") | is_wire_copy(F.col("author"), F.lit(""))
    place = F.struct(wire.alias("wire"), F.col("published_at").isNull().alias("undated"), "published_at", "id")
    anchors = flagged.join(roots, "id").groupBy("root").agg(F.min(place).alias("p")).select("root", F.col("p.id").alias("anchor"))
    out = flagged.join(roots.join(anchors, "root").select("id", "anchor"), "id", "left")
    return out.select(
        "id",
        (F.col("is_wire_content") | (F.col("anchor").isNotNull() & (F.col("anchor") != F.col("id")))).alias("is_wire_content"),
        F.when(F.col("anchor").isNull(), F.col("wire_original_id")).when(F.col("anchor") != F.col("id"), F.col("anchor")).alias("wire_original_id"),
    )


def later_duplicates(articles: DataFrame, topics: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id) of articles similar to one published earlier in their topic (by time, null last, then id); no transitivity."""
    inside = materialize(_in_topics(articles, topics), "dated-articles")
    similar = similar_texts(inside, "topic_id", "id", "content", threshold)
    place = F.struct(F.col("published_at").isNull().alias("undated"), "published_at", "id")
    placed = similar.members.join(inside.select(F.col("topic_id").alias("grp"), "id", "published_at"), ["grp", "id"]).withColumn("place", place)
    first = placed.groupBy("grp", "class").agg(F.min("place").alias("first"))
    both = similar.links.select("grp", "a", "b").unionByName(similar.links.select("grp", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(first.withColumnsRenamed({"class": "b"}), ["grp", "b"]).groupBy("grp", F.col("a").alias("class")).agg(F.min("first").alias("near"))
    least = first.join(near, ["grp", "class"], "left").withColumn("least", F.least("first", F.coalesce("near", "first")))
    return placed.join(least, ["grp", "class"]).where(F.col("place") > F.col("least")).select("id").distinct()
