"""Consensus pools: facts of several articles clustered, ordered, split, tiered, themed, judged; and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import parsing, scoring
from newsloom.functions.text import sentences, token_jaccard, tokens


def raw_facts(articles: DataFrame, cached: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(pool_id, article_id, source, n, fact) for each article of (pool_id, article_id, source, content).

    The stand-in for extraction takes an article's sentences. Articles with facts in ``cached`` (same columns) keep these.
    """
    todo = articles if cached is None else articles.join(cached.select("pool_id", "article_id").distinct(), ["pool_id", "article_id"], "left_anti")
    found = sentences(F.col("content"))
    fresh = todo.select("pool_id", "article_id", "source", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("n", "fact"))
    return fresh if cached is None else cached.select(*fresh.columns).unionByName(fresh)


def fact_id(article_id: Column, n: Column) -> Column:
    """One number for (article_id, n), in their order: no article's facts reach the next one's, as n is below 10^10."""
    return article_id.cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + n


def hashed_vector(fact: Column, size: int = 64) -> Column:
    """A bag of words hashed into ``size`` counts: a deterministic stand-in for an encoder."""
    t = tokens(fact)
    slots = F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def consensus_facts(clustered: DataFrame, facts: DataFrame, articles_per_pool: DataFrame) -> DataFrame:
    """One row per cluster: representative text, sorted distinct sources, importance by the share of articles.

    ``clustered`` is (pool_id, fact_id, cluster_id, is_representative), ``facts`` (pool_id, fact_id, source, fact),
    ``articles_per_pool`` (pool_id, articles).
    """
    rows = clustered.join(facts, ["pool_id", "fact_id"])
    g = rows.groupBy("pool_id", "cluster_id").agg(F.max(F.when(F.col("is_representative"), F.col("fact"))).alias("fact"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("members"))
    n = F.size("sources").cast("long")
    return g.join(articles_per_pool, "pool_id").select(
        "pool_id", "cluster_id", "fact", "sources", n.alias("source_count"), "members", F.when(n >= scoring.vital_threshold(F.col("articles")), "vital").otherwise("okay").alias("importance")
    )


def ordered(nuggets: DataFrame, chunk: int = 30) -> DataFrame:
    """Nuggets with their ``position`` in the pool - theme, tier (null last), most sources, id - and the ``chunk`` of a batch call."""
    w = Window.partitionBy("pool_id").orderBy("theme_order", F.asc_nulls_last("tier"), F.desc("source_count"), "id")
    return nuggets.withColumn("position", F.row_number().over(w).cast("long")).withColumn("chunk", F.floor((F.col("position") - 1) / chunk).cast("long"))


def retiered(nuggets: DataFrame, target: int = 5) -> DataFrame:
    """At most ``target`` nuggets of a pool stay in tier 1, those with most sources (then least id); the others fall to tier 2."""
    w = Window.partitionBy("pool_id", "tier").orderBy(F.desc("source_count"), "id")
    return nuggets.withColumn("_n", F.row_number().over(w)).withColumn("tier", F.when((F.col("tier") == 1) & (F.col("_n") > target), 2).otherwise(F.col("tier"))).drop("_n")


def theme_groups(positions: DataFrame) -> DataFrame:
    """(pool_id, theme, first_position, nuggets): blank themes are 'Uncategorized', groups in order of first appearance."""
    theme = F.coalesce(F.nullif(F.trim("theme"), F.lit("")), F.lit("Uncategorized"))
    return positions.groupBy("pool_id", theme.alias("theme")).agg(F.min("position").alias("first_position"), F.count("*").alias("nuggets"))


def themed(nuggets: DataFrame, answers: DataFrame) -> DataFrame:
    """Theme and theme_order of nuggets by a model's answer per pool: (pool_id, answer) names facts by position from 1.

    The last theme that names a fact wins; facts without one are 'Other Details' after all themes; a pool without a
    readable answer keeps empty themes of order 0.
    """
    numbered = nuggets.withColumn("_i", F.row_number().over(Window.partitionBy("pool_id").orderBy("position")) - 1)
    sizes = nuggets.groupBy("pool_id").agg(F.count("*").cast("int").alias("_n"))
    parsed = answers.join(sizes, "pool_id").select("pool_id", parsing.themes(F.col("answer"), F.col("_n")).alias("t")).where("t is not null")
    named = parsed.select("pool_id", F.posexplode("t").alias("k", "x")).select("pool_id", "k", "x.name", F.explode("x.facts").alias("_i"))
    last = named.groupBy("pool_id", "_i").agg(F.max(F.struct("k", "name")).alias("b"))
    counts = parsed.select("pool_id", F.size("t").alias("_themes"))
    rows = numbered.join(last, ["pool_id", "_i"], "left").join(counts, "pool_id", "left")
    return rows.withColumn("theme", F.when(F.col("_themes").isNull(), "").otherwise(F.coalesce("b.name", F.lit("Other Details")))).withColumn(
        "theme_order", F.when(F.col("_themes").isNull(), 0).otherwise(F.coalesce(F.col("b.k") + 1, F.col("_themes") + 1))
    ).drop("_i", "b", "_themes")


def split_clusters(members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Members (pool_id, cluster_id, member, source) with their ``part`` after conflicts (pool_id, cluster_id, groups).

    groups lists member positions; part 0 is the first group and all members no group names, part n the n-th. Positions
    out of range are ignored; clusters without a conflict are part 0.
    """
    placed = members.withColumn("_at", F.row_number().over(Window.partitionBy("pool_id", "cluster_id").orderBy("member")) - 1)
    named = conflicts.select("pool_id", "cluster_id", F.posexplode("groups").alias("part", "g")).select("pool_id", "cluster_id", "part", F.explode("g").alias("_at"))
    first = named.groupBy("pool_id", "cluster_id", "_at").agg(F.min("part").alias("part"))
    return placed.join(first, ["pool_id", "cluster_id", "_at"], "left").withColumn("part", F.coalesce("part", F.lit(0))).drop("_at")


def conflict_pairs(parts: DataFrame) -> DataFrame:
    """(pool_id, cluster_id, a, b) of the parts of split clusters, the one with more sources first; parts are a handful."""
    n = parts.groupBy("pool_id", "cluster_id", "part").agg(F.count_distinct("source").alias("n"))
    x, y = n.select("pool_id", "cluster_id", F.col("part").alias("p"), F.col("n").alias("np")), n.select("pool_id", "cluster_id", F.col("part").alias("q"), F.col("n").alias("nq"))
    pairs = x.join(y, ["pool_id", "cluster_id"]).where("p < q")
    swap = F.col("nq") > F.col("np")
    return pairs.select("pool_id", "cluster_id", F.when(swap, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("b"))


def verified(pairs: DataFrame, verdict: str = "verdict", a: str = "fact_a", b: str = "fact_b", most: float = 0.85) -> DataFrame:
    """Confirmed contradictions whose texts aren't nearly the same."""
    return pairs.where((F.col(verdict) == "confirm") & (token_jaccard(F.col(a), F.col(b)) <= most))


def judged(articles: DataFrame, nuggets: DataFrame, full: float = 0.9, part: float = 0.5) -> DataFrame:
    """(pool_id, article_id, nugget_id, label, vital): the stand-in judge goes by the share of a fact's words in the article.

    A pool's facts are gathered once, each article is read once; words are compared as hashes.
    """
    words = lambda c: F.array_distinct(F.transform(tokens(F.col(c)), lambda w: F.xxhash64(w)))  # noqa: E731 - hashes, so that sets of numbers are compared
    lists = nuggets.groupBy("pool_id").agg(F.collect_list(F.struct("id", (F.col("importance") == "vital").alias("vital"), words("fact").alias("words"))).alias("facts"))
    rows = articles.select("pool_id", "article_id", words("content").alias("own")).join(lists, "pool_id")
    share = F.transform("facts", lambda f: F.struct(f["id"].alias("id"), f["vital"].alias("vital"), scoring.ratio(F.size(F.array_intersect(f["words"], F.col("own"))), F.size(f["words"])).alias("share")))
    each = rows.select("pool_id", "article_id", F.explode(share).alias("f"))
    label = F.when(F.col("f.share") >= full, "support").when(F.col("f.share") >= part, "partial_support").otherwise("not_support")
    return each.select("pool_id", "article_id", F.col("f.id").alias("nugget_id"), label.alias("label"), F.col("f.vital").alias("vital"))


def numbered_prompt(facts: DataFrame, order: list[str], text: str, head: str) -> DataFrame:
    """(pool_id, prompt): the pool's facts numbered from 1 under a heading."""
    g = facts.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("f"))
    lines = F.transform("f", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[text]))
    return g.select("pool_id", F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")).alias("prompt"))


def sentence_scores(articles: DataFrame, subjective: Column, confidence: Column) -> DataFrame:
    """(id, sentence_count, subjective_count, subjectivity_ratio, mean_confidence) from a classifier on ``sentence`` columns.

    Sentences without a verdict (null) count as asked, not as subjective; articles without sentences have none.
    """
    s = articles.select("id", F.explode(sentences(F.col("content"))).alias("sentence")).withColumns({"_s": subjective, "_c": confidence})
    g = s.groupBy("id").agg(F.count("*").alias("sentence_count"), F.count_if("_s").alias("subjective_count"), F.avg("_c").alias("c"))
    return g.select("id", "sentence_count", "subjective_count", F.bround(F.col("subjective_count") / F.col("sentence_count"), 4).alias("subjectivity_ratio"), F.bround("c", 4).alias("mean_confidence"))


def as_json(df: DataFrame, key: str, name: str = "report") -> DataFrame:
    """(key, JSON text of the other columns); null fields are left out."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(name))
