"""Queries on what follows the clustering of a pool: merging, tiers, themes, assignment, prompts, status, reports.

The stand-ins for models read the prompt and answer in the forms models answer in, so every query goes through a prompt
and a parser on varied data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import postprocess, scores
from newsloom.operators.inference_standins import answers_with
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, articles, clusters
from newsloom.runtime import table

registry = Registry()
query = registry.add

_N = "n AS (SELECT p_partkey % 4 AS pool_id, p_partkey AS id, p_name AS fact, CAST(p_size AS INT) AS source_count FROM part)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as facts in four pools by their keys, the size the number of sources."""
    return table(spark, d, "part").select((F.col("p_partkey") % 4).alias("pool_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("fact"), F.col("p_size").cast("int").alias("source_count"))


def _counts(prompt: Column) -> Column:
    return F.transform(F.regexp_extract_all(prompt, F.lit(r"\((\d+) sources\)"), 1), lambda x: x.cast("int"))


def _as_list(items: Column, quoted: bool = False) -> Column:
    """A JSON list behind some thinking, as a model writes it."""
    mark = '"' if quoted else ""
    return F.concat(F.lit(f"<think>[9]</think>Here it is:\n[{mark}"), F.array_join(items, f"{mark}, {mark}"), F.lit(f"{mark}]\ndone"))


#: Tier 1 for counts divisible by 4, 2 for odd ones, else a number that is no tier.
_tier_model = answers_with(lambda prompt: _as_list(F.transform(_counts(prompt), lambda n: F.when(n % 4 == 0, 1).when(n % 2 == 1, 2).otherwise(7).cast("string"))))
#: Keeps every third candidate, named in a sentence.
_retier_model = lambda prompt: F.concat(F.lit("I keep "), F.array_join(F.filter(F.transform(F.sequence(F.lit(1), F.size(_counts(prompt))), lambda i: F.when(i % 3 == 0, i)), lambda i: i.isNotNull()).cast("array<string>"), ", "))


def _tier_or_select(df: DataFrame) -> DataFrame:
    """One model for both calls: candidates all are in tier 1, so their counts all are divisible by 4."""
    every = F.forall(_counts(F.col("prompt")), lambda n: n % 4 == 0)
    tiers = _tier_model(df).select(*df.columns, F.col("answer").alias("t"))
    return tiers.withColumn("answer", F.when(every, _retier_model(F.col("prompt"))).otherwise(F.col("t"))).drop("t")


_TIERED = f"""{_N}, p AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY source_count DESC, id) AS pos, count(*) OVER (PARTITION BY pool_id) AS size FROM n),
t AS (SELECT *, CASE WHEN source_count % 4 = 0 THEN 1 WHEN source_count % 2 = 1 THEN 2 ELSE 3 END AS t0 FROM p), k AS (SELECT *, count(*) FILTER (t0 = 1) OVER (PARTITION BY pool_id) AS n1,
CASE WHEN t0 = 1 THEN row_number() OVER (PARTITION BY pool_id, t0 ORDER BY source_count DESC, id) END AS c FROM t),
tiered AS (SELECT pool_id, id, fact, source_count, CASE WHEN t0 = 1 AND size > 200 AND n1 > 22 AND c % 3 <> 0 THEN 2 ELSE t0 END AS tier FROM k)"""


@query(f"WITH {_TIERED} SELECT pool_id, id, tier FROM tiered")
def tiered_nuggets(spark: SparkSession, d: str) -> DataFrame:
    """Tiers in chunks of 200 facts, with the second call for pools where too many facts came out first."""
    return postprocess.tiered(_facts(spark, d), _tier_or_select).select("pool_id", "id", "tier")


@query(f"""WITH {_N}, p AS (SELECT *, (row_number() OVER (PARTITION BY pool_id ORDER BY source_count DESC, id) - 1) // 200 AS chunk FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY pool_id, chunk ORDER BY source_count DESC, id) AS i FROM p)
SELECT pool_id, CAST(chunk AS INT) AS chunk, string_agg('[' || i || '] ' || fact || ' (' || source_count || ' sources)', chr(10) ORDER BY i) AS block, CAST(count(*) AS INT) AS n FROM q GROUP BY 1, 2""")
def tier_prompts(spark: SparkSession, d: str) -> DataFrame:
    placed = postprocess.in_chunks(_facts(spark, d), "pool_id", [F.desc("source_count"), F.asc("id")], 200)
    return postprocess.block(placed, ["pool_id", "chunk"], postprocess.fact_line())


_C = """m AS (SELECT p_brand AS pool_id, CAST(p_size AS INT) AS cluster_id, p_partkey AS member, p_name AS text, p_type AS source FROM part),
c AS (SELECT pool_id, cluster_id, CAST(count(DISTINCT source) AS INT) AS source_count, arg_max(text, member) AS fact, count(*) AS members, arg_min(text, member) AS first FROM m GROUP BY 1, 2)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Parts as raw facts: brand and size are the cluster, the type is the source."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("pool_id"), F.col("p_size").cast("int").alias("cluster_id"), F.col("p_partkey").alias("member"), F.col("p_name").alias("text"), F.col("p_type").alias("source"))


def _clusters(members: DataFrame) -> DataFrame:
    return members.groupBy("pool_id", "cluster_id").agg(F.count_distinct("source").cast("int").alias("source_count"), F.max_by("text", "member").alias("fact"))


#: The first member of each cluster in capitals, but nothing for clusters of three sources.
_merge_model = answers_with(
    lambda prompt: _as_list(
        F.transform(F.regexp_extract_all(prompt, F.lit(r'(Cluster \d+ \(\d+ sources\):\n  a\) "[^"]*")'), 1), lambda x: F.when(x.contains("(3 sources)"), "").otherwise(F.upper(F.regexp_extract(x, 'a\\) "([^"]*)"', 1)))), True
    )
)


@query(f"WITH {_C} SELECT pool_id, cluster_id, CASE WHEN members > 1 AND source_count <> 3 THEN upper(first) ELSE fact END AS fact, members > 1 AND source_count <> 3 AS was_merged FROM c")
def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of several members rewritten, 30 clusters to a call; blank answers keep the fact."""
    m = _members(spark, d)
    return postprocess.merged(_clusters(m), m, _merge_model).select("pool_id", "cluster_id", "fact", "was_merged")


@query(f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY pool_id, cluster_id ORDER BY member) - 1 AS j FROM m)
SELECT pool_id, cluster_id, string_agg('  ' || chr(CAST(97 + j AS INT)) || ') "' || text || '"', chr(10) ORDER BY j) FILTER (j < 26) AS merge_block, string_agg('  ' || j || ') [' || source || '] "' || text || '"', chr(10) ORDER BY j) AS conflict_block,
'  A) "' || arg_min(text, member) || '"' || chr(10) || '  B) "' || arg_max(text, member) || '"' AS pair_block FROM r GROUP BY 1, 2""")
def member_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The members of a cluster as merge, contradiction and verification prompts show them."""
    g = _members(spark, d).groupBy("pool_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("member", "text", "source"))).alias("m"))
    merge, conflict = postprocess.merge_lines(F.transform("m", lambda x: x["text"])), postprocess.conflict_lines(F.col("m"))
    pair = postprocess.pair_lines(F.element_at("m", 1)["text"], F.element_at("m", -1)["text"])
    return g.select("pool_id", "cluster_id", merge.alias("merge_block"), conflict.alias("conflict_block"), pair.alias("pair_block"))


def _places(prompt: Column, odd: int) -> Column:
    return F.filter(F.sequence(F.lit(1), F.size(_counts(prompt))), lambda i: i % 2 == odd)


#: Facts in odd places are of one theme, those in even places of another.
_theme_model = answers_with(
    lambda prompt: F.to_json(F.struct(F.array(*[F.struct(F.lit(name).alias("name"), _places(prompt, odd).alias("facts")) for name, odd in (("Odd", 1), ("Even", 0))]).alias("themes")))
)


@query(f"""WITH {_C}, t AS (SELECT *, CASE WHEN source_count % 4 = 0 THEN 1 WHEN source_count % 2 = 1 THEN 2 ELSE 3 END AS tier FROM c)
SELECT pool_id, count(*) FILTER (members > 1 AND source_count <> 3) AS merged, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3, least(count(*), 2) AS themes FROM t GROUP BY 1""")
def post_processing_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain - merge, tiers, themes - with its counters."""
    m = _members(spark, d)
    nuggets = _clusters(m).withColumn("id", F.col("cluster_id"))
    return postprocess.post_processed(nuggets, m, _merge_model, _tier_model, _theme_model)[1]


@query("""WITH p AS (SELECT p_brand AS pool_id, p_partkey AS id, p_name AS fact, p_size, CASE WHEN p_brand LIKE '%5' THEN NULL ELSE nullif(p_size % 4, 0) END AS tier FROM part), t AS (SELECT *, bool_or(tier IS NOT NULL) OVER (PARTITION BY pool_id) AS tiered FROM p),
l AS (SELECT *, CASE WHEN tiered THEN coalesce(tier, 2) ELSE 0 END AS rank, '- ' || CASE WHEN tiered THEN '' WHEN p_size >= 25 THEN '[VITAL] ' ELSE '[OKAY] ' END || fact || ' (Sources: ' || array_to_string(list_transform(range(1, least(p_size, 5) + 1), lambda i: 's' || i), ', ') || ')' AS line FROM t),
b AS (SELECT pool_id, rank, CASE rank WHEN 1 THEN chr(10) || '--- HEADLINE FACTS ---' || chr(10) WHEN 2 THEN chr(10) || '--- CONTEXT FACTS ---' || chr(10) WHEN 3 THEN chr(10) || '--- DETAIL FACTS ---' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY tier IS NULL, id) AS block FROM l GROUP BY 1, 2)
SELECT pool_id, string_agg(block, chr(10) ORDER BY rank) AS block FROM b GROUP BY 1""")
def summary_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Facts under their tiers with their first five sources; pools without tiers show importance."""
    size, brand = F.col("p_size"), F.col("p_brand")
    tier = F.when(brand.endswith("5"), None).otherwise(F.nullif(size % 4, F.lit(0)))
    sources = F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string")))
    rows = table(spark, d, "part").select(brand.alias("pool_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("fact"), sources.alias("sources"), tier.cast("int").alias("tier"), F.when(size >= 25, "vital").otherwise("okay").alias("importance"))
    return postprocess.summary_blocks(rows)


#: Support for facts the answer lists, partial support for those it lists among others' words, in a list or by lines.
_assign_model = answers_with(
    lambda prompt: F.array_join(
        F.transform(
            F.regexp_extract_all(prompt, F.lit(r"(?m)^\[\d+\] ([^\n]*)$"), 1),
            lambda f: F.when(F.contains(prompt, F.concat(F.lit("- "), f, F.lit("\n"))), "supported").when(F.contains(prompt, F.concat(F.lit("- "), F.split_part(f, F.lit(" "), F.lit(1)))), "Partially supported").otherwise("not supported"),
        ),
        "\n",
    )
)
_A = """f AS (SELECT p_brand AS document_id, p_partkey AS n, p_name AS fact FROM part), e AS (SELECT DISTINCT p_brand AS document_id, p_name AS nugget FROM part WHERE p_size > 30),
w AS (SELECT DISTINCT document_id, nugget FROM e), g AS (SELECT f.*, EXISTS (SELECT 1 FROM w WHERE w.document_id = f.document_id AND w.nugget = f.fact) AS whole,
EXISTS (SELECT 1 FROM w WHERE w.document_id = f.document_id AND starts_with(w.nugget, split_part(f.fact, ' ', 1))) AS begins FROM f)"""


@query(f"""WITH {_A} SELECT document_id, n, CASE WHEN whole THEN 'support' WHEN begins THEN 'partial_support' ELSE 'not_support' END AS label, CASE WHEN whole THEN 1.0 WHEN begins THEN 0.5 END::DOUBLE AS similarity FROM g""")
def assigned_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts labelled ten to a call against a list of extracted ones, and what counts as a match."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("n"), F.col("p_name").alias("fact"), "p_size")
    extracted = p.where("p_size > 30").groupBy("document_id", F.col("fact").alias("nugget")).agg(F.min("n").alias("n"))
    return postprocess.matches(postprocess.assigned(p.select("document_id", "n", "fact"), extracted, _assign_model), True).select("document_id", "n", "label", "similarity")


@query(f"""WITH {ART}, {CLU}, r AS (SELECT topic_id AS pool_id, a.id FROM clu JOIN art a ON a.id = article_id WHERE a.status = 'complete' AND NOT is_wire_content)
SELECT pool_id, count(*) AS articles, CASE WHEN count(*) < 2 OR pool_id % 9 = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN count(*) < 2 THEN 'Need at least 2 articles, got ' || count(*) WHEN pool_id % 9 = 0 THEN 'model is down' ELSE '' END AS error_message FROM r GROUP BY 1""")
def pool_status(spark: SparkSession, d: str) -> DataFrame:
    """How each pool ended: too few articles, an error of a step, or complete."""
    a = articles(spark, d, "status", "is_wire_content").where("status = 'complete' and not is_wire_content")
    rows = clusters(spark, d).select(F.col("topic_id").alias("pool_id"), "article_id").join(a.select(F.col("id").alias("article_id")), "article_id")
    errors = rows.where("pool_id % 9 = 0").select("pool_id", F.lit("model is down").alias("message")).distinct()
    return postprocess.pool_status(rows, errors)


@query("SELECT p_brand AS pool_id, p_partkey AS id, wanted FROM part, (VALUES ('any'), ('vital')) w(wanted) WHERE wanted = 'any' OR p_size >= 25")
def facts_by_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("pool_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 25, "vital").otherwise("okay").alias("importance"))
    both = [postprocess.by_importance(rows, x).select("pool_id", "id", F.lit(x or "any").alias("wanted")) for x in (None, "vital")]
    return both[0].unionByName(both[1])


_SPLIT = r"""string_split_regex(regexp_replace(regexp_replace(content, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '([.!?])[\s\x{00a0}]+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(rf"""WITH {ART}, p AS (SELECT id, unnest({_SPLIT}) AS s FROM art), q AS (SELECT id, len(s) % 8 AS l, len(s) % 4 AS r FROM p WHERE len(list_filter(regexp_split_to_array(s, '[\s\x{{00a0}}]+'), lambda w: w <> '')) >= 5),
f AS (SELECT id, CAST(round_even(avg(l / 16), 4) AS DOUBLE) AS l, CAST(round_even(avg(1 - l / 16 - r / 16), 4) AS DOUBLE) AS c, CAST(round_even(avg(r / 16), 4) AS DOUBLE) AS r, count(*) AS chunks FROM q GROUP BY 1)
SELECT a.id AS article_id, CASE WHEN a.id % 11 = 0 OR chunks IS NULL THEN 'failed' ELSE 'complete' END AS status,
concat_ws('; ', CASE WHEN a.id % 11 = 0 THEN 'Tone: timed out' END, CASE WHEN chunks IS NULL THEN 'Framing: no result' END) AS error_message, l AS leaning_left, c AS leaning_center, r AS leaning_right, chunks FROM art a LEFT JOIN f USING (id)""")
def article_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Tone and framing of each article with partial failure: the class probabilities are stand-ins from lengths, every eleventh tone call fails."""
    a = articles(spark, d, "content")
    s = a.select("id", F.explode(text.sentences(F.col("content"))).alias("sentence"))
    n = F.length("sentence")
    left, right = (n % 8) / 16, (n % 4) / 16
    framing = postprocess.framing_means(s, left, 1 - left - right, right).withColumn("error", F.lit(None).cast("string"))
    tone = a.select("id", F.when(F.col("id") % 11 == 0, "timed out").alias("error"))
    return postprocess.analysed(a, tone, framing).withColumnRenamed("id", "article_id")


_REPORT = f"""{ART}, {CLU}, f AS (SELECT topic_id AS pool_id, a.id, s.name AS source, published_at, is_wire_content FROM clu JOIN art a ON a.id = article_id JOIN sources s ON s.id = source_id),
sc AS (SELECT pool_id, source, arg_min((id % 101) / 100, ((id % 101) / 100, -id)) AS coverage, arg_min((id % 97) / 96, ((id % 101) / 100, -id)) AS weighted FROM f WHERE NOT is_wire_content GROUP BY 1, 2),
an AS (SELECT pool_id, source, f.id, published_at, subjectivity_ratio, leaning_left, leaning_center, leaning_right FROM f JOIN (SELECT DISTINCT * FROM article_analysis) n ON n.article_id = f.id WHERE n.status = 'complete' AND NOT is_wire_content),
tn AS (SELECT pool_id, source, max(subjectivity_ratio) AS ratio FROM an GROUP BY 1, 2), fr AS (SELECT * FROM an WHERE leaning_left IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pool_id, source ORDER BY published_at NULLS LAST, id) = 1)"""


@query(f"""WITH {_REPORT} SELECT sc.pool_id, sc.source, CAST(round_even(100 * coverage, 0) AS BIGINT) AS coverage_pct, CAST(round_even(100 * weighted, 0) AS BIGINT) AS weighted_pct, CAST(round_even(100 * ratio, 0) AS BIGINT) AS subjectivity_pct,
CAST(round_even(100 * leaning_left, 0) AS BIGINT) AS left_pct, CAST(round_even(100 * leaning_center, 0) AS BIGINT) AS center_pct, CAST(round_even(100 * leaning_right, 0) AS BIGINT) AS right_pct
FROM sc LEFT JOIN tn USING (pool_id, source) LEFT JOIN fr USING (pool_id, source)""")
def topic_source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each topic and covering source: coverage, tone and framing put together."""
    return _summary(spark, d).drop("tone_label", "dominant_leaning")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "source_id", "published_at", "is_wire_content").where("not is_wire_content")
    names = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    rows = clusters(spark, d).select(F.col("topic_id").alias("pool_id"), F.col("article_id").alias("id")).join(a, "id").join(names, "source_id").withColumnRenamed("id", "article_id")
    scored = rows.select("pool_id", "source", "article_id", ((F.col("article_id") % 101) / 100).alias("coverage"), ((F.col("article_id") % 97) / 96).alias("weighted"))
    done = table(spark, d, "article_analysis").where("status = 'complete'").select("article_id", "subjectivity_ratio", "leaning_left", "leaning_center", "leaning_right").distinct()
    return postprocess.source_summary(scored, rows.join(done, "article_id"))


@query()
def full_reports(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of each pool as JSON, whose layout differs between engines: source rows, facts by theme, matrix, conflicts with their consensus."""
    topics = F.col("pool_id")
    ids = table(spark, d, "topics").select(F.col("id").alias("pool_id"), "title")
    nuggets = ids.select(topics, F.explode(F.sequence(F.lit(1), F.lit(4))).alias("id"), "title").select(
        topics, "id", F.concat_ws(" ", "title", F.col("id").cast("string")).alias("fact"), F.when(F.col("id") < 3, "vital").otherwise("okay").alias("importance"), (F.col("id") % 3 + 1).alias("tier"), (5 - F.col("id")).alias("source_count"),
        F.when(F.col("id") % 2 == 0, "Even").otherwise("Odd").alias("theme"), (F.col("id") % 2).alias("theme_order"),
    )
    summary = _summary(spark, d)
    judged = summary.select(topics, "source", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("nugget_id"), F.when(F.col("coverage_pct") > 50, "support").otherwise("not_support").alias("label"))
    matrix = judged.groupBy(topics, "nugget_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "label")))).alias("labels"))
    claims = judged.where("nugget_id < 3").groupBy(F.concat(topics.cast("string"), F.lit(":1/2")).alias("group"), F.col("nugget_id").alias("claim")).agg(F.count_if(F.col("label") == "support").alias("supporters"))
    conflicts = scores.contradiction_consensus(claims).select(F.split_part("group", F.lit(":"), F.lit(1)).cast("long").alias("pool_id"), F.col("group").alias("explanation"), "claims", "consensus_index")
    return postprocess.full_report(summary, nuggets, matrix, conflicts)
