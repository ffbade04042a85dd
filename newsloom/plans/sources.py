"""Queries on readers and writes: stored rows are put into the form a reader takes - event JSON, dataset files - and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import inference, scoring
from newsloom.operators import topics
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, DOC, NOW, articles, clusters, documents
from newsloom.runtime import scratch, table
from newsloom.sources import feed, loaders, sinks

registry = Registry()
query = registry.add


def _article_feed(spark: SparkSession, d: str) -> str:
    """The folder with all articles as a feed sends them: sources by host, half of them untitled, times without a zone or only a publication time."""
    a = articles(spark, d, "source_id", "title", "url", "author", "content", "published_at", "sentiment")
    host = F.concat(F.lit("the-src"), F.col("source_id").cast("string"), F.lit("x.example"))
    rows = a.select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("uri"), "url", "title", F.col("content").alias("body"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"),
        F.lit("2025-01-01T00:00:00Z").alias("dateTimePub"), "sentiment", F.when(F.col("id") % 2 == 0, 0.25).alias("sim"),
        F.struct(host.alias("uri"), F.when(F.col("source_id") % 2 == 0, F.concat(F.lit("Source "), F.col("source_id").cast("string"))).alias("title")).alias("source"),
        F.array(F.struct(F.col("author").alias("name")), F.struct(F.lit("Second Author").alias("name"))).alias("authors"),
    )
    path = scratch(spark, "feed")
    rows.write.json(path)
    return path


_FEED = f"""{ART}, f AS (SELECT 'a' || id AS uri, source_id, title, url, 'the-src' || source_id || 'x.example' AS host, CASE WHEN source_id % 2 = 0 THEN 'Source ' || source_id ELSE 'The-Src' || source_id || 'X' END AS name,
left(CASE WHEN coalesce(author, '') = '' THEN '' ELSE author || ', ' END || 'Second Author', 300) AS author, coalesce(epoch_us(date_trunc('second', published_at)), 1735689600000000) AS published_us,
len(list_filter(regexp_split_to_array(content, '[\\s\\x{{00a0}}]+'), lambda w: w <> '')) AS word_count, CASE WHEN id % 2 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence FROM art WHERE coalesce(url, '') <> '' AND coalesce(title, '') <> '')"""


@query(f"WITH {_FEED} SELECT uri, host, name, author, published_us, word_count, confidence FROM f WHERE source_id NOT IN (3, 5)")
def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the feed of wanted sources, the filter at the reader."""
    wanted = [f"the-src{i}x.example" for i in range(1, 200) if i not in (3, 5)]
    a = feed.event_articles(spark, _article_feed(spark, d), wanted)
    return a.select(F.col("event_registry_uri").alias("uri"), F.col("source_uri").alias("host"), F.col("source_name").alias("name"), "author", F.unix_micros("published_at").alias("published_us"), F.col("word_count").cast("long").alias("word_count"), F.col("confidence_score").alias("confidence"))


@query(f"WITH {_FEED} SELECT host, min(name) AS name, replace(lower(min(name)), ' ', '-') AS slug_base FROM f WHERE source_id % 4 <> 0 GROUP BY 1")
def feed_new_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the feed that aren't stored; every fourth is."""
    known = table(spark, d, "sources").where("id % 4 = 0").select(F.concat(F.lit("the-src"), F.col("id").cast("string"), F.lit("x.example")).alias("event_registry_uri"))
    rows = feed.new_sources(feed.event_articles(spark, _article_feed(spark, d)), known)
    return rows.select(F.col("source_uri").alias("host"), "name", "slug_base")


_EVENT = f"""e AS (SELECT 'e' || id AS uri, title, description, keywords, created_at::DATE AS day, article_count, id FROM topics WHERE id % 7 <> 0),
r AS (SELECT * FROM e WHERE article_count >= 2 AND day BETWEEN (TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR)::DATE AND DATE '{NOW[:10]}')"""


def _event_feed(spark: SparkSession, d: str) -> str:
    """Topics as events; every seventh has an unreadable date."""
    t = table(spark, d, "topics")
    rows = t.select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("uri"), F.create_map(F.lit("eng"), "title").alias("title"), F.create_map(F.lit("eng"), "description").alias("summary"),
        F.when(F.col("id") % 7 == 0, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd")).alias("eventDate"), F.col("article_count").alias("totalArticleCount"),
        F.transform("keywords", lambda k: F.struct(F.create_map(F.lit("eng"), k).alias("label"), F.lit("wiki").alias("type"))).alias("concepts"),
    )
    path = scratch(spark, "events")
    rows.write.json(path)
    return path


@query(f"WITH {_EVENT} SELECT uri, CAST(article_count AS INT) AS articles FROM r")
def feed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last hundred days with two articles or more; unreadable dates are none."""
    return feed.recent_events(spark, _event_feed(spark, d), NOW, 2400, 2, None).select("uri", F.col("totalArticleCount").alias("articles"))


@query(f"WITH {_EVENT} SELECT uri, left(title, 300) AS title, array_to_string(keywords[1:10], '|') AS keywords FROM r WHERE id % 3 <> 0 AND title <> ''")
def feed_new_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of events that aren't stored; every third is."""
    known = table(spark, d, "topics").where("id % 3 = 0").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_registry_uri"))
    rows = feed.topics_of(feed.recent_events(spark, _event_feed(spark, d), NOW, 2400, 2, None), known)
    return rows.select(F.col("event_registry_uri").alias("uri"), "title", F.array_join(F.filter("keywords", lambda k: k != ""), "|").alias("keywords"))


_FILE = f"{DOC}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM doc)"


def _dataset(spark: SparkSession, d: str, *columns) -> str:
    """Documents in the order of their ids as the files of a dataset."""
    path = scratch(spark, "dataset")
    documents(spark, d, "primary_text", "title", "source_id").repartitionByRange(4, "id").sortWithinPartitions("id").select(*columns).write.parquet(path)
    return path


@query(f"""WITH {_FILE} SELECT 'train_' || i AS external_id, title, len(primary_text) AS characters, '{{"summary":"' || source_id || '"}}' AS reference_content FROM r WHERE coalesce(primary_text, '') <> ''""")
def loaded_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A dataset of several files: external ids are positions over all of them."""
    path = _dataset(spark, d, F.col("primary_text").alias("text"), F.col("source_id").cast("string").alias("summary"), "title")
    return loaders.load(spark, "billsum", path).select("external_id", "title", F.length("primary_text").cast("long").alias("characters"), "reference_content")


@query(f"""WITH {_FILE}, k AS (SELECT * FROM r WHERE coalesce(primary_text, '') <> '' ORDER BY i LIMIT 50) SELECT 'test_' || i AS external_id, '{{"label":' || source_id % 2 || ',"label_text":"' || CASE WHEN source_id % 2 = 0 THEN 'objective' ELSE 'subjective' END || '"}}' AS reference_content FROM k""")
def loaded_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 rows of a labelled dataset."""
    path = _dataset(spark, d, F.col("primary_text").alias("text"), (F.col("source_id") % 2).cast("int").alias("label"), F.lit(None).cast("string").alias("label_text"))
    return loaders.load(spark, "subj", path, "test", 50).select("external_id", "reference_content")


@query(f"""WITH {DOC}, s AS (SELECT source_id, external_id FROM doc WHERE split <> 'test' OR split IS NULL), r AS (SELECT DISTINCT source_id, CASE WHEN id % 2 = 0 THEN external_id ELSE 'new' || id END AS external_id FROM doc)
SELECT count(*) AS given, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = r.source_id AND s.external_id = r.external_id)) AS created, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.source_id = r.source_id AND s.external_id = r.external_id)) AS skipped FROM r""")
def load_counts(spark: SparkSession, d: str) -> DataFrame:
    """A load that clears its split first: rows given, created and skipped."""
    stored = documents(spark, d, "source_id", "external_id", "split")
    rows = stored.select("source_id", F.when(F.col("id") % 2 == 0, F.col("external_id")).otherwise(F.concat(F.lit("new"), F.col("id").cast("string"))).alias("external_id")).distinct()
    return sinks.load_counts(rows, sinks.clear_and_load(stored, rows, "test", True)[1], ["source_id", "external_id"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders UNION ALL SELECT -o_orderkey, 'changed', NULL FROM orders WHERE o_orderkey % 50 = 10""")
def upserted_orders(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth order updated, some new ones inserted; columns that aren't given keep their values."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey").unionByName(o.where("o_orderkey % 50 = 10").select((-F.col("o_orderkey")).alias("o_orderkey")))
    return sinks.upsert(o, new.withColumn("o_orderstatus", F.lit("changed")), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_custkey % 7 <> 0")
def orders_after_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Customers deleted: orders of some go with them, those of others lose the reference."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey")
    return sinks.set_null(sinks.cascade(o, "o_custkey", c.where("c_custkey % 7 = 0"), "c_custkey"), "o_custkey", c.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT -c_custkey, c_custkey FROM customer WHERE c_custkey % 4 = 0")
def replaced_orders(spark: SparkSession, d: str) -> DataFrame:
    """The orders of every fourth customer replaced by one."""
    c = table(spark, d, "customer").where("c_custkey % 4 = 0")
    return sinks.replace_children(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c.select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(f"""WITH {ART}, {CLU}, f AS (SELECT topic_id, a.id, image_url, published_at FROM clu JOIN art a ON a.id = article_id WHERE coalesce(image_url, '') <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published_at NULLS LAST, id) AS n FROM f) SELECT topic_id, coalesce(arg_min(image_url, n) FILTER (id % 3 = 0), '') AS image_url FROM k WHERE n <= 5 GROUP BY 1""")
def first_images(spark: SparkSession, d: str) -> DataFrame:
    """Of the five earliest images of a topic the first that could be fetched; here those of every third article."""
    a = articles(spark, d, "image_url", "published_at").where("coalesce(image_url, '') != ''")
    rows = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(a, "id").withColumn("ok", F.col("id") % 3 == 0)
    return sinks.first_image(rows)


@query("SELECT id AS topic_id FROM topics ORDER BY trending_score DESC NULLS FIRST, title NULLS LAST, id LIMIT 20")
def caller_ordered_topics(spark: SparkSession, d: str) -> DataFrame:
    """The first page in an order a caller names; a name that isn't allowed is ignored."""
    t = table(spark, d, "topics").select("id", "trending_score", "title", "slug")
    return topics.ordered_by(t, "-trending_score, slug, title, id", ["trending_score", "title", "id"], [F.asc("id")]).limit(20).select(F.col("id").alias("topic_id"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || ',' || '000' WHEN 2 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS cell FROM part)
SELECT id, row_number() OVER (ORDER BY try_cast(regexp_replace(cell, '[%, ]', '', 'g') AS DOUBLE) NULLS LAST, lower(cell), id) AS place FROM t""")
def numeric_first_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a table column sorted by number where they are one."""
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    cell = F.when(kind == 0, F.concat(size, F.lit("%"))).when(kind == 1, F.concat(size, F.lit(",000"))).when(kind == 2, F.col("p_name")).otherwise(size)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), cell.alias("cell"))
    return topics.global_rank(rows, [*topics.numeric_first(F.col("cell")), F.asc("id")], "place").select("id", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 4 < 3 THEN 'n' || o_custkey % 4 ELSE 'Source 3' END || ' says so; ' || CASE o_orderkey % 3 WHEN 0 THEN 'n0 and n2' WHEN 1 THEN 'n0, n1, and n2' ELSE 'n1' END || ' deny it.' AS explanation,
CASE o_orderkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'PART' WHEN 2 THEN 'MISS' ELSE '?' END AS code FROM orders""")
def source_references(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sources in explanations replaced by their names; labels as short codes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    second = F.when(k % 3 == 0, "members 0 and 2").when(k % 3 == 1, "Sources 0, 1 and 2").otherwise("Member 1, 7")
    said = F.concat(F.lit("Source "), (c % 4).cast("string"), F.lit(" says so; "), second, F.lit(" deny it."))
    labels = F.element_at(F.array(*map(F.lit, ("support", "partial_support", "not_support", "other"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("order_id"), inference.named_sources(said, F.array(*map(F.lit, ("n0", "n1", "n2")))).alias("explanation"), scoring.label_code(labels).alias("code"))


@query(f"WITH {_EVENT} SELECT count(*) AS events, count(*) FILTER (id % 3 <> 0) AS new, count(*) FILTER (id % 3 = 0) AS skipped FROM r")
def feed_import_counts(spark: SparkSession, d: str) -> DataFrame:
    """A bulk import over a hundred days: events that are new and those stored already."""
    known = table(spark, d, "topics").where("id % 3 = 0").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_registry_uri"))
    return feed.import_counts(feed.recent_events(spark, _event_feed(spark, d), NOW, 2400, 2, None), known)


@query(f"""WITH {DOC}, p AS (SELECT coalesce(lower(trim(split)), 'none') AS split, source_id, primary_text FROM doc)
SELECT split, count(*) AS asked, count(*) FILTER (source_id <> 2) AS answered, count(*) FILTER (source_id = 2) AS failed FROM p GROUP BY 1""")
def extraction_runs(spark: SparkSession, d: str) -> DataFrame:
    """A model asked about all documents, with errors counted by split; here it fails on one source."""
    rows = documents(spark, d, "split", "source_id").select(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split"), "source_id")
    asked = rows.withColumns({"answer": F.when(F.col("source_id") != 2, "[]"), "error": F.when(F.col("source_id") == 2, "timed out")})
    return inference.run_report(asked, "split")
