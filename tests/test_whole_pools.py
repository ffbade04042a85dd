"""Pools take every sentence of an article, however long it is."""

import datetime

from pyspark.sql import functions as F

from newsloom.operators import pools
from newsloom.plans import pools as plans


def test_fact_ids_of_long_articles(spark):
    rows = spark.createDataFrame([(1, 1000), (2, 0), (1, 999), (-1, 5), (2**62, 2**31 - 1)], "a long, n int")
    got = [(r["a"], r["n"]) for r in rows.withColumn("id", pools.fact_id(F.col("a"), F.col("n"))).orderBy("id").collect()]
    assert got == [(-1, 5), (1, 999), (1, 1000), (2, 0), (2**62, 2**31 - 1)]
    assert rows.select(pools.fact_id(F.col("a"), F.col("n")).alias("id")).distinct().count() == 5


def test_late_sentences_reach_the_scores(spark, monkeypatch):
    own = [" ".join(f"{w}{a}{i}" for w in ("Alpha", "beta", "gamma", "delta", "epsilon")) + "." for a in "xy" for i in range(4)]
    shared = "The council approved the harbour budget on Monday evening."
    content = [" ".join([*own[:4], shared]), " ".join([*own[4:], shared])]
    when = datetime.datetime(2024, 1, 1)
    arts = spark.createDataFrame([(i + 1, i + 1, c, "complete", False, when) for i, c in enumerate(content)], "id long, source_id long, content string, status string, is_wire_content boolean, published_at timestamp")
    monkeypatch.setattr(plans, "articles", lambda s, d, *c: arts.select("id", *c))
    monkeypatch.setattr(plans, "clusters", lambda s, d: spark.createDataFrame([(7, 1), (7, 2)], "topic_id long, article_id long"))
    rows = plans.consensus_pools(spark, "").collect()
    # eight facts of one source each and the fifth sentence of both, the one vital fact; facts of one source count, too
    assert sorted(r["article_id"] for r in rows) == [1, 2]
    assert all((r["total"], r["support"], r["not_support"], r["vital_total"], r["vital_support"]) == (9, 5, 4, 1, 1) for r in rows), rows
