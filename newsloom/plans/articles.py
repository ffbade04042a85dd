"""Queries on articles: listing, text, wire copy, analysis labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators import similar, topics, wire
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, NOW, articles, clusters
from newsloom.runtime import table

registry = Registry()
query = registry.add
_RE = "(?i)" + "|".join(rf"\b{n}\b" for n in text.WIRE_NAMES)
_HOSTS = ", ".join(f"'{h}'" for h in text.WIRE_HOSTS)
#: By-lines of the stored articles rarely name a service, so these queries put one on some of them, by id.
_AUTHOR = "CASE id % 11 WHEN 0 THEN 'Reuters' WHEN 3 THEN 'Staff, AP' WHEN 5 THEN 'by The Canadian Press' WHEN 7 THEN '' ELSE author END"
_HOST = "CASE id % 22 WHEN 11 THEN 'Reuters.com' ELSE regexp_extract(url, 'https?://([^/]+)', 1) END"


def wire_articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = articles(spark, d, "author", "url", *columns)
    n = F.col("id") % 11
    author = F.when(n == 0, "Reuters").when(n == 3, "Staff, AP").when(n == 5, "by The Canadian Press").when(n == 7, "").otherwise(F.col("author"))
    host = F.when(F.col("id") % 22 == 11, "Reuters.com").otherwise(F.regexp_extract("url", "https?://([^/]+)", 1))
    return rows.withColumns({"author": author, "source_host": host})


@query(f"""WITH {ART}, w AS (SELECT id, {_AUTHOR} AS author, {_HOST} AS host FROM art)
SELECT id AS article_id, regexp_matches(author, '{_RE}') AND lower(host) NOT IN ({_HOSTS}) AS wire_copy, lower(nullif(regexp_extract(author, '{_RE}'), '')) AS service FROM w""")
def wire_byline(spark: SparkSession, d: str) -> DataFrame:
    w = wire_articles(spark, d)
    return w.select(F.col("id").alias("article_id"), text.is_wire_copy(F.col("author"), F.col("source_host")).alias("wire_copy"), text.wire_service(F.col("author")).alias("service"))


@query(f"""WITH {ART}, w AS (SELECT id, author, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM art)
SELECT id AS article_id, coalesce(regexp_matches(author, '{_RE}'), false) AND lower(host) NOT IN ({_HOSTS}) AS wire_copy, lower(nullif(regexp_extract(author, '{_RE}'), '')) AS service FROM w""")
def stored_wire_bylines(spark: SparkSession, d: str) -> DataFrame:
    """By-lines as they are stored, none put on."""
    a = articles(spark, d, "author", "url")
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    return a.select(F.col("id").alias("article_id"), text.is_wire_copy(F.col("author"), host).alias("wire_copy"), text.wire_service(F.col("author")).alias("service"))


_SETS = f"""{ART}, {CLU}, w AS (SELECT art.*, {_AUTHOR.replace('author', 'art.author')} AS byline, {_HOST} AS host, topic_id FROM art JOIN clu ON article_id = id WHERE content <> ''),
t AS (SELECT topic_id, id, regexp_extract_all(lower(content), '[a-z0-9'']+') AS t FROM w),
s AS (SELECT topic_id, id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM t WHERE len(t) >= 5),
x AS (SELECT topic_id, id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.topic_id, a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.topic_id = b.topic_id AND a.g = b.g AND a.id < b.id GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY a.topic_id, a.id, b.id, a.n, b.n"
)


@query(f"""WITH {_SETS}, sym AS (SELECT topic_id, a, b, j FROM pairs UNION ALL SELECT topic_id, b, a, j FROM pairs)
SELECT s.topic_id, s.id AS article_id, least(s.id, coalesce(min(b) FILTER (j = 1), s.id)) AS class_id, count(b) FILTER (j >= 0.7) AS links FROM s LEFT JOIN sym ON a = s.id AND sym.topic_id = s.topic_id GROUP BY s.topic_id, s.id""")
def shingle_jaccard_links(spark: SparkSession, d: str) -> DataFrame:
    """Each article with shingles: the least article of its topic with the same shingles, and its similar articles there.

    Links are counted from class sizes; copies are never expanded into pairs.
    """
    inside = articles(spark, d, "content").where("content != ''").join(clusters(spark, d).select("topic_id", F.col("article_id").alias("id")), "id")
    found = similar.similar_texts(inside, "topic_id", "id", "content", 0.7)
    return similar.linked(found).select(F.col("grp").alias("topic_id"), F.col("id").alias("article_id"), "class_id", "links")


_EDGES = f"""{_SETS}, svc AS (SELECT topic_id, s.id, nullif(lower(regexp_extract(byline, '{_RE}')), '') AS service FROM w JOIN s USING (topic_id, id)),
e AS (SELECT a, b FROM pairs WHERE j >= 0.7 UNION SELECT a.id, b.id FROM svc a JOIN svc b ON a.topic_id = b.topic_id AND a.service = b.service AND a.id < b.id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id WHERE r.m < u.b),
comp AS (SELECT id, min(m) AS root FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT id AS article_id, root FROM comp")
def wire_components(spark: SparkSession, d: str) -> DataFrame:
    rows = wire_articles(spark, d, "content", "published_at", "is_wire_content", "wire_original_id")
    return wire.wire_components(rows, clusters(spark, d)).withColumnRenamed("id", "article_id")


@query(f"""WITH RECURSIVE {_EDGES}, f AS (SELECT id, published_at, wire_original_id, is_wire_content OR (regexp_matches(author2, '{_RE}') AND lower(host2) NOT IN ({_HOSTS})) AS flag,
  regexp_matches(author2, '{_RE}') AS named FROM (SELECT *, {_AUTHOR} AS author2, {_HOST} AS host2 FROM art)),
anchor AS (SELECT root, id AS anchor FROM (SELECT root, f.id, row_number() OVER (PARTITION BY root ORDER BY flag OR named, published_at NULLS LAST, f.id) n FROM f JOIN comp USING (id)) WHERE n = 1)
SELECT f.id AS article_id, flag OR (anchor IS NOT NULL AND anchor <> f.id) AS is_wire_content, CASE WHEN anchor IS NULL THEN wire_original_id WHEN anchor <> f.id THEN anchor END AS wire_original_id
FROM f LEFT JOIN comp USING (id) LEFT JOIN anchor USING (root)""")
def flag_wire(spark: SparkSession, d: str) -> DataFrame:
    rows = wire_articles(spark, d, "content", "published_at", "is_wire_content", "wire_original_id")
    return wire.flag_wire(rows, clusters(spark, d)).withColumnRenamed("id", "article_id")


@query(f"""WITH {_SETS}, o AS (SELECT id, row_number() OVER (ORDER BY published_at NULLS LAST, id) AS k FROM w)
SELECT DISTINCT CASE WHEN x.k > y.k THEN a ELSE b END AS article_id FROM pairs JOIN o x ON x.id = a JOIN o y ON y.id = b WHERE j >= 0.8""")
def first_wins_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = wire_articles(spark, d, "content", "published_at")
    return wire.later_duplicates(rows, clusters(spark, d)).withColumnRenamed("id", "article_id")


@query(f"WITH {ART} SELECT id AS article_id, len(list_filter(regexp_split_to_array(content, '[\\s\\x{{00a0}}]+'), lambda w: w <> '')) AS words, word_count FROM art")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "content", "word_count").select(F.col("id").alias("article_id"), text.word_count(F.col("content")).alias("words"), "word_count")


@query(f"""WITH {ART}, t AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9'']+')) x, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9'']+')) y FROM art)
SELECT id AS article_id, CAST(round_even(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS DOUBLE) AS similarity FROM t""")
def title_summary_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title", "summary").select(F.col("id").alias("article_id"), F.bround(text.token_jaccard(F.col("title"), F.col("summary")), 6).alias("similarity"))


@query(f"""WITH {ART}, p AS (SELECT id, string_split_regex(regexp_replace(regexp_replace(content, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g'), '([.!?])[\\s\\x{{00a0}}]+([A-Z"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM art),
q AS (SELECT id, list_filter(list_transform(s, lambda z: regexp_replace(z, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')), lambda z: len(list_filter(regexp_split_to_array(z, '[\\s\\x{{00a0}}]+'), lambda w: w <> '')) >= 5) AS s FROM p)
SELECT id AS article_id, len(s) AS sentences, coalesce(list_sum(list_transform(s, lambda z: len(z))), 0) AS characters FROM q""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = articles(spark, d, "content").select("id", text.sentences(F.col("content")).alias("s"))
    return s.select(F.col("id").alias("article_id"), F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


@query(f"""WITH {ART} SELECT id AS article_id FROM art WHERE source_id IN (1, 2, 3) AND status = 'complete' AND NOT is_wire_content AND author <> '' AND image_url > '' AND sentiment IS NOT NULL
AND regexp_matches(url, '^https?://')""")
def filtered_articles(spark: SparkSession, d: str) -> DataFrame:
    """Field filters: equality, membership, not empty, not null and the URL test."""
    a = articles(spark, d, "source_id", "status", "is_wire_content", "author", "image_url", "sentiment", "url")
    wanted = F.col("source_id").isin(1, 2, 3) & (F.col("status") == "complete") & ~F.col("is_wire_content") & (F.col("author") != "") & (F.col("image_url") > "") & F.col("sentiment").isNotNull()
    return a.where(wanted & F.col("url").rlike("^https?://")).select(F.col("id").alias("article_id"))


@query(f"WITH {ART} SELECT id AS article_id FROM art WHERE contains(lower(title), 'council') OR contains(lower(content), 'council')")
def search_articles(spark: SparkSession, d: str) -> DataFrame:
    return topics.search(articles(spark, d, "title", "content"), "Council", [F.col("title"), F.col("content")]).select(F.col("id").alias("article_id"))


@query(f"""WITH {ART} SELECT id AS article_id, s.name AS source, title, (SELECT count(*) FROM art) AS total FROM art JOIN sources s ON s.id = source_id
ORDER BY published_at DESC NULLS FIRST, art.id OFFSET 20 LIMIT 20""".replace("id AS article_id", "art.id AS article_id", 1))
def article_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the article list with the total count."""
    a = articles(spark, d, "source_id", "title", "published_at")
    names = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    total = a.count()
    rows = topics.page(a.join(names, "source_id"), [F.desc_nulls_first("published_at"), F.asc("id")], 2)
    return rows.select(F.col("id").alias("article_id"), "source", "title", F.lit(total).alias("total"))


@query(f"WITH {ART} SELECT id AS article_id FROM art WHERE content <> '' AND id NOT IN (SELECT article_id FROM article_analysis)")
def unanalysed_articles(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "article_analysis").select(F.col("article_id").alias("id"))
    return articles(spark, d, "content").where("content != ''").join(done, "id", "left_anti").select(F.col("id").alias("article_id"))


@query(f"""WITH {ART}, {CLU}, f AS (SELECT topic_id, a.id, published_at FROM clu JOIN art a ON a.id = article_id),
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY published_at DESC NULLS FIRST, id) r FROM f)
SELECT x.id AS article_id, y.id AS related_id, row_number() OVER (PARTITION BY x.id ORDER BY y.r) AS place FROM k x JOIN k y ON x.topic_id = y.topic_id AND x.id <> y.id AND y.r <= 6
QUALIFY place <= 5""")
def related_articles(spark: SparkSession, d: str) -> DataFrame:
    """Up to five other articles of the topic in default order: the first six of each topic serve all its articles."""
    f = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(articles(spark, d, "published_at"), "id").select("topic_id", "id", "published_at")
    first = topics.top_per_group(f, ["topic_id"], [F.desc_nulls_first("published_at"), F.asc("id")], 6)
    pairs = f.select("topic_id", F.col("id").alias("article_id")).join(first.select("topic_id", F.col("id").alias("related_id"), "rank"), "topic_id").where("article_id != related_id")
    return topics.top_per_group(pairs, ["article_id"], [F.asc("rank")], 5, "place").select("article_id", "related_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ART}, {CLU}, f AS (SELECT topic_id, a.id, wire_original_id FROM clu JOIN art a ON a.id = article_id)
SELECT x.topic_id, x.id AS anchor_id, count(y.id) AS copies, coalesce(sum(y.id), 0) AS id_sum FROM f x LEFT JOIN f y ON y.wire_original_id = x.id AND y.topic_id = x.topic_id
WHERE x.wire_original_id IS NULL GROUP BY x.topic_id, x.id""")
def wire_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Copies under their anchor within the topic; copies whose anchor lies elsewhere aren't listed."""
    f = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(articles(spark, d, "wire_original_id"), "id").select("topic_id", "id", "wire_original_id")
    copies = f.where("wire_original_id is not null").groupBy("topic_id", F.col("wire_original_id").alias("id")).agg(F.count("*").alias("copies"), F.sum("id").alias("id_sum"))
    zero = F.lit(0).cast("long")
    return f.where("wire_original_id is null").join(copies, ["topic_id", "id"], "left").select(
        "topic_id", F.col("id").alias("anchor_id"), F.coalesce("copies", zero).alias("copies"), F.coalesce("id_sum", zero).alias("id_sum")
    )


@query(f"""WITH {ART}, {CLU}, f AS (SELECT a.*, topic_id FROM art a LEFT JOIN clu ON article_id = a.id)
SELECT f.id AS article_id, s.name AS source, coalesce(an.status, 'none') AS analysis, CAST(round_even(100 * subjectivity_ratio, 0) AS BIGINT) AS subjectivity_pct, w.id AS anchor_id, ws.name AS anchor_source
FROM f JOIN sources s ON s.id = f.source_id LEFT JOIN article_analysis an ON an.article_id = f.id LEFT JOIN art w ON w.id = f.wire_original_id LEFT JOIN sources ws ON ws.id = w.source_id""")
def article_details(spark: SparkSession, d: str) -> DataFrame:
    """Each article with its source, analysis and the article it was copied from."""
    a = articles(spark, d, "source_id", "wire_original_id")
    s = table(spark, d, "sources")
    an = table(spark, d, "article_analysis").select(F.col("article_id").alias("id"), "status", "subjectivity_ratio")
    w = a.select(F.col("id").alias("wire_original_id"), F.col("source_id").alias("wire_source"), F.col("id").alias("anchor_id"))
    joined = a.join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(an, "id", "left").join(w, "wire_original_id", "left")
    joined = joined.join(s.select(F.col("id").alias("wire_source"), F.col("name").alias("anchor_source")), "wire_source", "left")
    return joined.select(F.col("id").alias("article_id"), "source", F.coalesce("status", F.lit("none")).alias("analysis"), scoring.pct(F.col("subjectivity_ratio")).alias("subjectivity_pct"), "anchor_id", "anchor_source")


@query("""SELECT article_id, CASE WHEN subjectivity_ratio IS NULL THEN NULL WHEN subjectivity_ratio < 0.10 THEN 'Highly Objective' WHEN subjectivity_ratio < 0.15 THEN 'Mostly Objective'
WHEN subjectivity_ratio < 0.22 THEN 'Mixed' WHEN subjectivity_ratio < 0.30 THEN 'Mostly Subjective' ELSE 'Highly Subjective' END AS tone,
CASE WHEN leaning_left IS NULL OR leaning_center IS NULL OR leaning_right IS NULL THEN NULL
 WHEN list_reverse_sort([leaning_left, leaning_center, leaning_right])[1] - list_reverse_sort([leaning_left, leaning_center, leaning_right])[2] < 0.1 THEN 'center'
 WHEN leaning_left = greatest(leaning_left, leaning_center, leaning_right) THEN 'left' WHEN leaning_center = greatest(leaning_left, leaning_center, leaning_right) THEN 'center' ELSE 'right' END AS leaning
FROM article_analysis""")
def analysis_labels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_analysis")
    return a.select("article_id", scoring.tone(F.col("subjectivity_ratio")).alias("tone"), scoring.leaning(F.col("leaning_left"), F.col("leaning_center"), F.col("leaning_right")).alias("leaning"))


@query(f"""WITH {ART} SELECT source_id, count(*) FILTER (published_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 30 DAY) AS recent, count(*) AS articles, count(DISTINCT nullif(author, '')) AS authors,
CAST(round_even(sum(CAST(round_even(sentiment * 10000, 0) AS BIGINT)) / count(sentiment) / 10000, 6) AS DOUBLE) AS mean_sentiment, count(*) FILTER (is_wire_content) AS wire FROM art GROUP BY 1""")
def source_activity(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    return (
        articles(spark, d, "source_id", "published_at", "author", "sentiment", "is_wire_content")
        .groupBy("source_id")
        .agg(
            F.count_if(F.col("published_at") >= since).alias("recent"),
            F.count("*").alias("articles"),
            F.count_distinct(F.nullif("author", F.lit(""))).alias("authors"),
            F.bround(F.sum(F.bround(F.col("sentiment") * 10000, 0).cast("long")) / F.count("sentiment") / 10000, 6).alias("mean_sentiment"),
            F.count_if("is_wire_content").alias("wire"),
        )
    )


@query(f"""WITH {ART}, u AS (SELECT DISTINCT ON (url) id, source_id, url, published_at FROM art WHERE url <> '' AND title <> '' ORDER BY url, id)
SELECT id AS article_id, row_number() OVER (PARTITION BY source_id ORDER BY published_at NULLS LAST, id) - 1 AS cluster_rank FROM u""")
def ingest_ranks(spark: SparkSession, d: str) -> DataFrame:
    """First row of each URL, and its rank among those of its source that were kept."""
    from pyspark.sql import Window

    rows = articles(spark, d, "source_id", "url", "title", "published_at").where("url != '' and title != ''")
    first = rows.groupBy("url").agg(F.min(F.struct("id", "source_id", "published_at")).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last("published_at"), "id")) - 1
    return first.select(F.col("id").alias("article_id"), rank.cast("long").alias("cluster_rank"))


@query()
def wire_components_banded(spark: SparkSession, d: str) -> DataFrame:
    """Components by MinHash bands: approximate, so without SQL; a test holds its recall against the exact pairs."""
    from newsloom.operators import components, minhash

    inside = articles(spark, d, "content").where("content != ''").join(clusters(spark, d).select("topic_id", F.col("article_id").alias("id")), "id")
    signed = minhash.signatures(inside, "id", "content").join(inside.select("id", "topic_id"), "id")
    return components.connected_components(minhash.banded_edges(signed, ["topic_id"], "id", 0.7)).withColumnRenamed("node", "article_id")


@query(f"""WITH {ART}, {CLU} SELECT t.id AS topic_id, count(a.id) AS articles, coalesce(string_agg(a.id, ',' ORDER BY confidence_score DESC, a.id), '') AS ids FROM topics t LEFT JOIN clu c ON c.topic_id = t.id LEFT JOIN art a ON a.id = c.article_id GROUP BY 1""")
def topic_details(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their articles nested, most confident first."""
    rows = clusters(spark, d).join(articles(spark, d, "title").select(F.col("id").alias("article_id"), "title"), "article_id")
    children = rows.select("topic_id", (-F.col("confidence_score")).alias("order"), "article_id", "title")
    nested = topics.with_nested(table(spark, d, "topics").select("id", "title"), "id", children, "topic_id", "articles", ["order", "article_id"])
    return nested.select(F.col("id").alias("topic_id"), F.size("articles").cast("long").alias("articles"), F.array_join(F.transform("articles", lambda x: x["article_id"].cast("string")), ",").alias("ids"))
