"""Canonical views of the stored tables, in Spark and as SQL common table expressions.

Stored tables hold re-delivered rows; every view has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.runtime import latest_rows, table

#: "Now" of all queries that need one.
NOW = "2025-05-06 00:00:00"

ART = "art AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) rn FROM articles) WHERE rn = 1)"
CLU = (
    "clu AS (SELECT topic_id, article_id, confidence_score, cluster_rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY article_id ORDER BY confidence_score DESC, topic_id, cluster_rank) rn FROM article_clusters) WHERE rn = 1)"
)
DOC = "doc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) rn FROM dataset_documents) WHERE rn = 1)"
#: Labels of articles (l_orderkey) for facts (l_partkey) of pools (l_suppkey); a fact is vital by the size of its part.
JUD = (
    "jud AS (SELECT l_suppkey AS pool_id, l_orderkey AS article_id, l_partkey AS nugget_id, min(CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'N' THEN"
    " 'partial_support' ELSE 'not_support' END) AS label, bool_or(p_size >= 25) AS vital FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"
)
JUD = JUD.replace("GROUP BY ALL", "GROUP BY l_suppkey, l_orderkey, l_partkey")


def articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """id, updated_at and ``columns`` of each article as delivered last; only these columns are read and shuffled."""
    wanted = ["id", "updated_at", *[c for c in columns if c not in ("id", "updated_at")]]
    return latest_rows(table(spark, d, "articles").select(*wanted), "id", "updated_at")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """One topic per article: the most confident, then the lowest id."""
    best = F.min(F.struct((-F.col("confidence_score")).alias("c"), "topic_id", "cluster_rank"))
    rows = table(spark, d, "article_clusters").groupBy("article_id").agg(best.alias("b"))
    return rows.select("b.topic_id", "article_id", (-F.col("b.c")).alias("confidence_score"), F.col("b.cluster_rank").alias("cluster_rank"))


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    wanted = ["id", "created_at", *[c for c in columns if c not in ("id", "created_at")]]
    return latest_rows(table(spark, d, "dataset_documents").select(*wanted), "id", "created_at")


def judgments(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "N", "partial_support").otherwise("not_support")
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.groupBy(F.col("l_suppkey").alias("pool_id"), F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("nugget_id")).agg(
        F.min(label).alias("label"), F.bool_or(F.col("p_size") >= 25).alias("vital")
    )
