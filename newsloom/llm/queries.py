"""The queries of the problems tagged llm, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.encode import encode_corpus
from newsloom.llm.leaks import leaked_items
from newsloom.llm.names import variant_groups, variant_pairs
from newsloom.llm.neardup import group_report, grouped, linked_pairs, near_duplicates
from newsloom.llm.overlap import cross_split_overlap, overlap_report, overlapping_pairs, record_overlaps
from newsloom.llm.pieces import split_oversized
from newsloom.llm.repeated import prefix_span, repeated_lines, without_repeated_lines
from newsloom.llm.residue import residue
from newsloom.llm.truncated import truncation
from newsloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "articles")).select(F.col("id").alias("article_id"), "field_name")


def p1_clean_articles(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the articles no value of which is affected."""
    articles = table(spark, d, "articles")
    return articles.select(F.col("id").alias("article_id")).distinct().join(p1_found(spark, d), "article_id", "left_anti")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = cross_split_overlap(table(spark, d, "dataset_documents"))
    return overlapping_pairs(found).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each evaluation split and source: records, overlapping records and pairs."""
    docs = table(spark, d, "dataset_documents")
    return overlap_report(docs, cross_split_overlap(docs)).withColumnRenamed("source", "source_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record: its class, its number of partners across the splits and its coverage by shared spans."""
    return record_overlaps(cross_split_overlap(table(spark, d, "dataset_documents"))).withColumnRenamed("id", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "articles")).select(F.col("id").alias("article_id"), "line_no")


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The frequent line sequences of each source, by the hashes of their lines."""
    return prefix_span(table(spark, d, "articles")).select(F.col("source").alias("source_id"), "length", "keys", "support")


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(table(spark, d, "articles")).withColumnRenamed("id", "article_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(variant_groups(table(spark, d, "articles")))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each author string that names one person or organisation, its entity and the entity's number of strings."""
    groups = variant_groups(table(spark, d, "articles"))
    sizes = groups.groupBy("entity").agg(F.count("*").alias("strings"))
    return groups.join(sizes, "entity").select("author", "entity", "strings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation(table(spark, d, "articles")).found.select(F.col("id").alias("article_id"), "field_name")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of each source and field: values, cut values and their share."""
    articles = table(spark, d, "articles")
    t = truncation(articles)
    sources = articles.select("id", F.col("source_id").alias("source")).distinct()
    cut = t.found.join(sources, "id").groupBy("source", "field_name").agg(F.count("*").alias("cut"))
    both = t.values.join(cut, ["source", "field_name"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return both.select(F.col("source").alias("source_id"), "field_name", "values", "cut", F.bround(F.col("cut") / F.col("values"), 4).alias("rate"))


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation(table(spark, d, "articles")).limits.withColumnRenamed("source", "source_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(near_duplicates(table(spark, d, "articles"))).select(F.col("a").alias("article_a"), F.col("b").alias("article_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each article long enough: the class of its text, its group and its number of links."""
    return grouped(near_duplicates(table(spark, d, "articles"))).select(F.col("id").alias("article_id"), "class", F.col("group").alias("group_id"), "links")


def p7_group_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of reprints: articles, different texts and titles, and how many are marked as wire copy."""
    articles = table(spark, d, "articles")
    return group_report(grouped(near_duplicates(articles)), articles).withColumnRenamed("group", "group_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaks_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Of each item that leaked: in how many documents."""
    items = table(spark, d, "eval_items").select("item_id", "task", "held_split")
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clean_articles, p3_found, p3_report, p3_records, p4_found, p4_sequences, p4_texts, p5_found, p5_entities, p6_found, p6_rates, p6_limits, p7_found, p7_groups, p7_group_report, p8_ids, p9_found, p9_leaks_by_item, p10_pieces)}


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
_RUNS = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
_SQL = {
    "p3_found": f"""WITH doc AS (SELECT id, arg_max(split, created_at) AS split, arg_max(primary_text, created_at) AS t FROM dataset_documents GROUP BY id),
w AS (SELECT id, starts_with(lower(trim(split)), 'train') AS train, {_WORDS.format('t')} AS w FROM doc WHERE split IS NOT NULL),
s AS (SELECT id, train, {_RUNS} AS s FROM w WHERE len(w) >= 20), x AS (SELECT id, train, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.train AND NOT b.train GROUP BY a.id, b.id)
SELECT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM p WHERE c >= 0.8 * (na + nb - c)""",
    "p4_found": """WITH art AS (SELECT DISTINCT id, source_id, content FROM articles), s AS (SELECT id, source_id, string_split(content, chr(10)) AS s FROM art),
l AS (SELECT id, source_id, generate_subscripts(s, 1) - 1 AS n, regexp_replace(lower(unnest(s)), '[\\s\\p{Z}\\p{Nd}\\x{0085}]+', '', 'g') AS k FROM s),
f AS (SELECT source_id, k FROM l WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10)
SELECT DISTINCT id AS article_id, CAST(n AS INT) AS line_no FROM l JOIN f USING (source_id, k)""",
    "p7_found": f"""WITH art AS (SELECT id, any_value(content) AS t FROM articles GROUP BY id), w AS (SELECT id, {_WORDS.format('t')} AS w FROM art), s AS (SELECT id, {_RUNS} AS s FROM w WHERE len(w) >= 50),
x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT a AS article_a, b AS article_b FROM p WHERE c >= 0.7 * (na + nb - c)""",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' ')))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' ')))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    """Exhaustive statements of the problems that SQL can define; the others are tested by programs."""
    return dict(_SQL)
