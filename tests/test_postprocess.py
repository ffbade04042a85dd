"""Post-processing with models that fail, empty tables, and the feed's lazy topics."""

import json

from pyspark.sql import functions as F

from newsloom.functions import inference
from newsloom.operators import postprocess
from newsloom.operators.inference_standins import answers_with
from newsloom.sources import feed
from newsloom.streaming import jobs

NOTHING = answers_with(lambda p: F.lit(None).cast("string"))


def facts(spark, n, pool=1):
    return spark.createDataFrame([(pool, i, f"fact {i}", i % 7) for i in range(n)], "pool_id long, id long, fact string, source_count int")


def test_failing_models_leave_defaults(spark):
    rows = postprocess.tiered(facts(spark, 30), NOTHING).collect()
    assert len(rows) == 30 and {r["tier"] for r in rows} == {3}
    n = facts(spark, 3).withColumn("cluster_id", F.col("id"))
    m = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 3, "c")], "pool_id long, cluster_id long, member long, text string")
    assert {(r["fact"], r["was_merged"]) for r in postprocess.merged(n, m, NOTHING).collect()} == {(f"fact {i}", False) for i in range(3)}
    f = spark.createDataFrame([(1, i, f"f{i}") for i in range(25)], "document_id long, n long, fact string")
    labelled = postprocess.assigned(f, spark.createDataFrame([], "document_id long, n long, nugget string"), NOTHING)
    assert labelled.count() == 25 and labelled.where("label = 'not_support'").count() == 25 and postprocess.matches(labelled).where("similarity is not null").count() == 0


def test_second_call_only_for_large_pools(spark):
    ones = answers_with(lambda p: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), 200), ","), F.lit("]")))
    assert postprocess.tiered(facts(spark, 200), ones, 5).where("tier = 1").count() == 200
    first_then_none = answers_with(lambda p: F.when(F.size(F.split(p, "\n")) > 200, None).otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), 200), ","), F.lit("]"))))
    kept = postprocess.tiered(facts(spark, 250), first_then_none, 5).where("tier = 1").collect()
    assert len(kept) == 5 and {r["source_count"] for r in kept} == {6} and sorted(r["id"] for r in kept) == [6, 13, 20, 27, 34]


def test_chain_on_an_empty_table(spark):
    n = facts(spark, 3).withColumn("cluster_id", F.col("id")).limit(0)
    m = spark.createDataFrame([], "pool_id long, cluster_id long, member long, text string")
    done, counters = postprocess.post_processed(n, m, NOTHING, NOTHING, NOTHING)
    assert done.count() == 0 and counters.count() == 0 and postprocess.tiered(n, NOTHING).count() == 0


def test_pool_status_and_domains(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (3, 5)], "pool_id long, article_id long")
    got = {r["pool_id"]: (r["status"], r["error_message"]) for r in postprocess.pool_status(a, spark.createDataFrame([(3, "down")], "pool_id long, message string")).collect()}
    assert got == {1: ("complete", ""), 2: ("failed", "Need at least 2 articles, got 1"), 3: ("failed", "down")}
    prompts = {"generic": "G", "sports": "S"}
    rows = spark.createDataFrame([(" Sports",), ("legislative",), (None,)], "d string").select(postprocess.domain_prompt(F.col("d"), prompts).alias("p")).collect()
    assert [r["p"] for r in rows] == ["S", "G", "G"]


def test_models_by_name(spark):
    inference.register("echo", lambda: lambda prompts: prompts)
    assert inference.available(inference.model("echo")) and not inference.available(lambda: 1 / 0)
    chat = spark.createDataFrame([([("system", "Be brief."), ("user", "Hi"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert chat.select(inference.flattened(F.col("m")).alias("p")).first()["p"] == "Be brief.\n\nUser: Hi\n\nAssistant:"


def test_topics_only_with_articles_and_free_slugs(spark, tmp_path):
    events = [{"uri": f"e{i}", "title": {"eng": "Same"}, "eventDate": "2024-01-02" if i else "??", "totalArticleCount": 3} for i in range(4)]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, events)))
    e = feed.recent_events(spark, str(tmp_path / "e.json"), "2024-01-02 12:00:00")
    assert sorted(r["uri"] for r in e.collect()) == ["e1", "e2", "e3"]
    articles = spark.createDataFrame([("e1", "a"), ("e2", "b")], "event_uri string, event_registry_uri string")
    known = spark.createDataFrame([("x", "same"), (None, "same-1")], "event_registry_uri string, slug string")
    got = {r["event_registry_uri"]: r["slug"] for r in feed.topics_with_articles(e, articles, known).collect()}
    assert got == {"e1": "same-2", "e2": "same-3"}


def test_late_articles_reopen_topics(spark):
    topics = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, article_count long")
    late = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 12)], "topic_id long, article_id long")
    pools = spark.createDataFrame([(1, 4), (3, 1)], "topic_id long, articles long")
    got = {r["topic_id"]: (r["article_count"], r["rebuild"]) for r in jobs.reopened(topics, late, pools).collect()}
    assert got == {1: (7, True), 2: (1, False)}
