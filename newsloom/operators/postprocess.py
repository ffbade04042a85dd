"""What follows the clustering of a pool's facts: merging, tiers, themes, assignment, prompts, status and reports.

A model is a function on DataFrames, ``ask``: it gets rows with a ``prompt`` and returns them with an ``answer`` (null where
the call failed); ``functions.inference.ask`` makes one of a batch model. Rows of one pool are numbered by windows, which
hold the facts of one story.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import parsing, scoring
from newsloom.operators import pools
from newsloom.runtime import materialize

Ask = Callable[[DataFrame], DataFrame]


def in_chunks(df: DataFrame, by: str, order: list[Column], size: int) -> DataFrame:
    """Rows with ``chunk`` from 0 and ``at``, the place in the chunk from 1, in ``order`` within ``by``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("_p", place).withColumns({"chunk": F.floor(F.col("_p") / size).cast("int"), "at": (F.col("_p") % size + 1).cast("int")}).drop("_p")


def block(df: DataFrame, by: list[str], line: Column, between: str = "\n", order: str = "at") -> DataFrame:
    """(by..., block, n): the lines of each group in order as one text."""
    lines = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("l"))
    return lines.select(*by, F.array_join(F.transform("l", lambda s: s["x"]), between).alias("block"), F.size("l").alias("n"))


# ---- lines of prompts --------------------------------------------------------------------------------------------------


def fact_line() -> Column:
    return F.format_string("[%d] %s (%d sources)", "at", "fact", "source_count")


def merge_lines(members: Column) -> Column:
    """Members of a cluster (an array of texts) lettered a) to z); further ones aren't shown."""
    shown = F.slice(members, 1, 26)
    return F.array_join(F.transform(shown, lambda t, j: F.concat(F.lit("  "), F.char(j + 97), F.lit(') "'), t, F.lit('"'))), "\n")


def conflict_lines(members: Column) -> Column:
    """Members of a cluster (an array of structs text, source) numbered from 0 with their source."""
    return F.array_join(F.transform(members, lambda m, j: F.concat(F.lit("  "), j.cast("string"), F.lit(") ["), m["source"], F.lit('] "'), m["text"], F.lit('"'))), "\n")


def pair_lines(a: Column, b: Column) -> Column:
    return F.concat(F.lit('  A) "'), a, F.lit('"\n  B) "'), b, F.lit('"'))


def sourced_line(fact: Column, sources: Column, tag: Column | None = None) -> Column:
    """A bullet with the first five sources, after a tag if there is one."""
    return F.concat(F.lit("- "), F.concat(tag, F.lit(" ")) if tag is not None else F.lit(""), fact, F.lit(" (Sources: "), F.array_join(F.slice(sources, 1, 5), ", "), F.lit(")"))


# Headings of the tiers in a summary's prompt.
TIER_HEADINGS = {1: "HEADLINE FACTS", 2: "CONTEXT FACTS", 3: "DETAIL FACTS"}


def summary_blocks(nuggets: DataFrame) -> DataFrame:
    """(pool_id, block) from (pool_id, id, fact, sources, tier, importance): facts under their tiers, those without a tier at the end of the second; pools without any tier get importance tags instead."""
    tiered = nuggets.groupBy("pool_id").agg(F.bool_or(F.col("tier").isNotNull()).alias("tiered"))
    rows = nuggets.join(tiered, "pool_id")
    tag = F.when(F.col("importance") == "vital", "[VITAL]").otherwise("[OKAY]")
    line = F.when(F.col("tiered"), sourced_line(F.col("fact"), F.col("sources"))).otherwise(sourced_line(F.col("fact"), F.col("sources"), tag))
    rank = F.when(F.col("tiered"), F.coalesce("tier", F.lit(2))).otherwise(0)
    parts = block(rows.withColumns({"rank": rank, "o": F.struct(F.col("tier").isNull().alias("late"), "id")}), ["pool_id", "rank"], line, order="o")
    heading = F.lit("")
    for n, text in TIER_HEADINGS.items():
        heading = F.when(F.col("rank") == n, f"\n--- {text} ---\n").otherwise(heading)
    return block(parts.withColumn("block", F.concat(heading, "block")), ["pool_id"], F.col("block"), order="rank").select("pool_id", "block")


# Domains with a prompt of their own; any other takes the generic one.
DOMAINS = ("sports", "legislative", "generic")


def domain_prompt(domain: Column, prompts: dict[str, str]) -> Column:
    """The prompt of a domain, else that of 'generic'."""
    out = F.lit(prompts["generic"])
    for name in DOMAINS[:-1]:
        out = F.when(F.lower(F.trim(domain)) == name, prompts.get(name, prompts["generic"])).otherwise(out)
    return out


# ---- steps -------------------------------------------------------------------------------------------------------------


def merged(nuggets: DataFrame, members: DataFrame, ask: Ask, batch: int = 30) -> DataFrame:
    """``nuggets`` (pool_id, cluster_id, fact, source_count, ...) with the fact of clusters of several members rewritten, and ``was_merged``.

    ``members`` is (pool_id, cluster_id, member, text). Clusters go to the model ``batch`` at a time; an answer that is
    missing, blank or unreadable keeps the fact.
    """
    texts = members.groupBy("pool_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("member", "text"))).alias("m")).where(F.size("m") > 1)
    several = in_chunks(texts.join(nuggets.select("pool_id", "cluster_id", "source_count"), ["pool_id", "cluster_id"]), "pool_id", [F.asc("cluster_id")], batch)
    line = F.concat(F.format_string("Cluster %d (%d sources):\n", "at", "source_count"), merge_lines(F.transform("m", lambda x: x["text"])))
    asked = ask(block(several, ["pool_id", "chunk"], line, "\n\n").withColumnRenamed("block", "prompt"))
    answers = asked.select("pool_id", "chunk", F.posexplode(parsing.strings(F.col("answer"), F.col("n"))).alias("i", "new")).withColumn("at", F.col("i") + 1)
    new = several.join(answers, ["pool_id", "chunk", "at"]).where("trim(new) != ''").select("pool_id", "cluster_id", "new")
    rows = nuggets.join(new, ["pool_id", "cluster_id"], "left")
    return rows.withColumns({"fact": F.coalesce("new", "fact"), "was_merged": F.col("new").isNotNull()}).drop("new")


def tiered(nuggets: DataFrame, ask: Ask, target: int = 15, chunk: int = 200) -> DataFrame:
    """``nuggets`` (pool_id, id, fact, source_count, ...) with ``tier``: 1, 2 or 3, what isn't answered 3.

    A pool of at most ``chunk`` facts is one call and stays as answered. Of larger ones each chunk is a call, and if more
    than 1.5 times ``target`` facts come out in tier 1, a further call selects those that stay there; the others fall to
    tier 2. If that call fails the ``target`` facts with most sources stay.
    """
    by_sources = [F.desc("source_count"), F.asc("id")]
    placed = in_chunks(nuggets.drop("tier"), "pool_id", by_sources, chunk)
    asked = ask(block(placed, ["pool_id", "chunk"], fact_line()).withColumnRenamed("block", "prompt"))
    answers = asked.select("pool_id", "chunk", F.posexplode(parsing.tiers(F.col("answer"), F.col("n"))).alias("i", "tier")).withColumn("at", F.col("i") + 1).drop("i")
    first = materialize(placed.join(answers, ["pool_id", "chunk", "at"]), "tiers")  # a model is asked once
    crowded = first.groupBy("pool_id").agg(F.max("chunk").alias("last"), F.count_if(F.col("tier") == 1).alias("n1")).where((F.col("last") > 0) & (F.col("n1") > int(1.5 * target))).select("pool_id")
    candidates = in_chunks(first.where("tier = 1").join(crowded, "pool_id").select("pool_id", "id", "fact", "source_count"), "pool_id", by_sources, 2**31 - 1)
    chosen = materialize(ask(block(candidates, ["pool_id", "chunk"], fact_line()).withColumnRenamed("block", "prompt")), "selections")
    picks = chosen.select("pool_id", "answer", F.when(F.col("answer").isNotNull(), parsing.selected(F.col("answer"), F.col("n"))).alias("picked"))
    stays = F.when(F.col("answer").isNull(), F.col("at") <= target).otherwise(F.array_contains("picked", F.col("at")))
    fallen = candidates.join(picks, "pool_id").where(~stays).select("pool_id", "id", F.lit(True).alias("fallen"))
    rows = first.join(fallen, ["pool_id", "id"], "left")
    return rows.withColumn("tier", F.when(F.col("fallen"), 2).otherwise(F.col("tier"))).drop("fallen", "chunk", "at")


def themed(nuggets: DataFrame, ask: Ask) -> DataFrame:
    """Nuggets with theme and theme_order, from one call a pool over its facts by tier, sources and id."""
    order = [F.asc_nulls_last("tier"), F.desc("source_count"), F.asc("id")]
    placed = in_chunks(nuggets, "pool_id", order, 2**31 - 1)
    answers = materialize(ask(block(placed, ["pool_id", "chunk"], fact_line()).withColumnRenamed("block", "prompt")).select("pool_id", "answer"), "themes")
    return pools.themed(placed.withColumn("position", F.col("at").cast("long")).drop("chunk", "at"), answers)


def post_processed(nuggets: DataFrame, members: DataFrame, merge: Ask, tier: Ask, theme: Ask, target: int = 15) -> tuple[DataFrame, DataFrame]:
    """(nuggets, counters): merge, then tiers, then themes; counters are (pool_id, merged, tier1, tier2, tier3, themes)."""
    done = materialize(themed(tiered(materialize(merged(nuggets, members, merge), "merged"), tier, target), theme), "post-processed")
    of = lambda n: F.count_if(F.col("tier") == n).alias(f"tier{n}")
    named = F.count_distinct(F.when(F.col("theme") != "", F.col("theme")))
    return done, done.groupBy("pool_id").agg(F.count_if("was_merged").alias("merged"), of(1), of(2), of(3), named.alias("themes"))


def assigned(facts: DataFrame, extracted: DataFrame, ask: Ask, batch: int = 10) -> DataFrame:
    """(document_id, n, fact, label) of ``facts`` (document_id, n, fact): does the answer, the list of ``extracted`` (document_id, n, nugget), state them?

    Facts go ``batch`` at a time; a failed call gives not_support.
    """
    placed = in_chunks(facts, "document_id", [F.asc("n")], batch)
    answer = block(extracted, ["document_id"], F.concat(F.lit("- "), "nugget"), order="n").select("document_id", F.col("block").alias("answer_text"))
    lists = block(placed, ["document_id", "chunk"], F.format_string("[%d] %s", "at", "fact")).withColumnRenamed("n", "facts")
    prompt = F.concat(F.coalesce("answer_text", F.lit("(No facts were extracted)")), F.lit("\n\n"), "block")
    asked = ask(lists.join(answer, "document_id", "left").select("document_id", "chunk", "facts", prompt.alias("prompt")))
    labels = asked.select("document_id", "chunk", F.posexplode(parsing.labels(F.col("answer"), F.col("facts"))).alias("i", "label")).withColumn("at", F.col("i") + 1)
    return placed.join(labels, ["document_id", "chunk", "at"]).select("document_id", "n", "fact", "label")


def matches(labelled: DataFrame, partial: bool = False) -> DataFrame:
    """``labelled`` with ``similarity``: 1 for support, 0.5 for partial support if that counts as a match, null for what is unmatched."""
    return labelled.withColumn("similarity", F.when(F.col("label") == "support", 1.0).when((F.col("label") == "partial_support") & F.lit(partial), 0.5))


def pool_status(articles: DataFrame, errors: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(pool_id, articles, status, error_message): failed with fewer than ``least`` articles or an error of any step (pool_id, message), else complete."""
    n = articles.groupBy("pool_id").agg(F.count_distinct("article_id").alias("articles"))
    few = F.format_string(f"Need at least {least} articles, got %d", "articles")
    rows = n if errors is None else n.join(errors.groupBy("pool_id").agg(F.min(F.substring("message", 1, 1000)).alias("message")), "pool_id", "left")
    message = F.when(F.col("articles") < least, few).otherwise(F.coalesce(F.col("message"), F.lit("")) if errors is not None else F.lit(""))
    return rows.select("pool_id", "articles", F.when(message == "", "complete").otherwise("failed").alias("status"), message.alias("error_message"))


def by_importance(nuggets: DataFrame, importance: str | None = None) -> DataFrame:
    """All nuggets, or those of one importance if a caller names one."""
    return nuggets.where(F.col("importance") == importance) if importance else nuggets


def framing_means(sentences: DataFrame, left: Column, center: Column, right: Column) -> DataFrame:
    """(id, leaning_left, leaning_center, leaning_right, chunks) from class probabilities of each (id, sentence): means over the sentences with a verdict, to four places."""
    rows = sentences.select("id", left.alias("l"), center.alias("c"), right.alias("r")).where("l is not null or c is not null or r is not null")
    mean = lambda c, name: F.bround(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(name)
    return rows.groupBy("id").agg(mean("l", "leaning_left"), mean("c", "leaning_center"), mean("r", "leaning_right"), F.count("*").alias("chunks"))


def analysed(articles: DataFrame, tone: DataFrame, framing: DataFrame) -> DataFrame:
    """(id, status, error_message, parts...) of articles: complete if both analyses gave a result, else failed with what there is.

    ``tone`` and ``framing`` are (id, error, parts...); an article without a row of one failed there, too.
    """
    t, f = tone.withColumnRenamed("error", "_t"), framing.withColumnRenamed("error", "_f")
    rows = articles.select("id").join(t.withColumn("_ht", F.lit(1)), "id", "left").join(f.withColumn("_hf", F.lit(1)), "id", "left")
    wrong = lambda name, error, has: F.when(F.col(has).isNull(), f"{name}: no result").when(F.col(error).isNotNull(), F.concat(F.lit(f"{name}: "), error))
    message = F.concat_ws("; ", wrong("Tone", "_t", "_ht"), wrong("Framing", "_f", "_hf"))
    return rows.withColumns({"error_message": message, "status": F.when(message == "", "complete").otherwise("failed")}).drop("_t", "_f", "_ht", "_hf")


# ---- the report --------------------------------------------------------------------------------------------------------


def source_summary(scores: DataFrame, analysis: DataFrame) -> DataFrame:
    """(pool_id, source, coverage_pct, weighted_pct, subjectivity_pct, tone_label, dominant_leaning, left_pct, center_pct, right_pct): one row per scored source.

    ``scores`` is (pool_id, source, article_id, coverage, weighted), ``analysis`` (pool_id, source, article_id,
    published_at, subjectivity_ratio, leaning_left, leaning_center, leaning_right) of complete analyses. Where a source
    has several articles the last in order counts: the least coverage, the greatest subjectivity, the earliest framing;
    sources without an analysis keep nulls.
    """
    s = scores.where("coverage is not null").groupBy("pool_id", "source").agg(F.min(F.struct("coverage", (-F.col("article_id")).alias("o"), "weighted")).alias("b"))
    tone = analysis.where("subjectivity_ratio is not null").groupBy("pool_id", "source").agg(F.max("subjectivity_ratio").alias("ratio"))
    placed = F.struct(F.col("published_at").isNull().alias("undated"), "published_at", "article_id", "leaning_left", "leaning_center", "leaning_right")
    framing = analysis.where("leaning_left is not null").groupBy("pool_id", "source").agg(F.min(placed).alias("f"))
    rows = s.join(tone, ["pool_id", "source"], "left").join(framing, ["pool_id", "source"], "left")
    side = lambda x: scoring.pct(F.col(f"f.leaning_{x}")).alias(f"{x}_pct")
    return rows.select(
        "pool_id", "source", scoring.pct(F.col("b.coverage")).alias("coverage_pct"), scoring.pct(F.col("b.weighted")).alias("weighted_pct"), scoring.pct(F.col("ratio")).alias("subjectivity_pct"),
        scoring.tone(F.col("ratio")).alias("tone_label"), scoring.leaning(F.col("f.leaning_left"), F.col("f.leaning_center"), F.col("f.leaning_right")).alias("dominant_leaning"), side("left"), side("center"), side("right"),
    )


def full_report(summary: DataFrame, nuggets: DataFrame, matrix: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(pool_id, report): the parts of a pool's report as one JSON text.

    Source rows by weighted coverage, facts by theme, tier, sources and id, the matrix of labels by fact, conflicts with
    their consensus. ``summary`` is source_summary, ``nuggets`` has pool_id, id, fact, importance, tier, source_count,
    theme, theme_order, ``matrix`` (pool_id, nugget_id, labels), ``conflicts`` (pool_id, explanation, claims, consensus_index).
    """
    def listed(df: DataFrame, name: str, order: Column) -> DataFrame:
        fields = [c for c in df.columns if c != "pool_id"]
        g = df.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("_x")))).alias("_l"))
        return g.select("pool_id", F.transform("_l", lambda x: x["_x"]).alias(name))

    by_weight = F.struct(-F.coalesce("weighted_pct", F.lit(0)), "source")
    by_theme = F.struct("theme_order", F.col("tier").isNull(), "tier", -F.col("source_count"), "id")
    cells = matrix.groupBy("pool_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("nugget_id").cast("string"), "labels"))).alias("matrix"))
    whole = listed(nuggets, "nuggets", by_theme)
    for part in (listed(summary, "sources", by_weight), cells, listed(conflicts, "conflicts", F.col("explanation"))):
        whole = whole.join(part, "pool_id", "left")
    return pools.as_json(whole, "pool_id")
