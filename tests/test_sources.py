"""Loaders, feed and streams on small files."""

import io
import json
import zipfile

from newsloom.plans import queries
from newsloom.sources import feed, loaders
from newsloom.streaming import jobs


def test_box_scores(spark, tmp_path):
    games = [{"box_score": {"PTS": {"0": "1"}}, "summary": ["A", "game"], "home_name": "H", "vis_name": "V", "home_city": "X", "vis_city": "Y", "day": "1"}, {}]
    (tmp_path / "train.json").write_text(json.dumps(games))
    got = loaders.load(spark, "rotowire", str(tmp_path)).orderBy("external_id").collect()
    assert [r["external_id"] for r in got] == ["train_0", "train_1"] and got[0]["primary_text"] == "A game" and got[0]["title"] == "Y V @ X H"
    assert loaders.box_scores(spark, str(tmp_path), limit=1).count() == 1
    (tmp_path / "valid-a.json").write_text(json.dumps(games))
    (tmp_path / "valid-b.json").write_text(json.dumps(games[:1]))
    two = loaders.box_scores(spark, str(tmp_path), "valid-*").collect()
    assert sorted(r["external_id"] for r in two) == [f"valid-*_{i}" for i in range(3)] and loaders.box_scores(spark, str(tmp_path), "valid-*", limit=2).count() == 2


def test_positions_over_several_files(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"t{n}{i}", "s", "x") for i in range(4)], "text string, summary string, title string").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    got = [r["external_id"] for r in loaders.summaries(spark, str(tmp_path / "b")).collect()]
    assert sorted(got, key=lambda x: int(x.split("_")[1])) == [f"train_{i}" for i in range(12)]
    assert loaders.summaries(spark, str(tmp_path / "b"), limit=5).count() == 5


def test_zipped_texts(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, n in (("Left Data", 3), ("Right Data", 2), ("Center Data", 1), ("Else", 1)):
            for i in range(n):
                z.writestr(f"{folder}/{i}.txt", "word " * 25)
        z.writestr("Left Data/short.txt", "too short")
        z.writestr("Left Data/bad.txt", b"\xff " * 25)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    assert loaders.zipped_texts(spark, str(tmp_path / "a.zip")).count() == 7
    labels = [json.loads(r["reference_content"])["label"] for r in loaders.zipped_texts(spark, str(tmp_path / "a.zip"), limit=4).collect()]
    assert labels == ["left", "center", "right", "left"]


def test_tables(spark, tmp_path):
    spark.createDataFrame([("t", "s", "x"), ("", "s", "x"), ("t2", None, "x")], "text string, summary string, title string").coalesce(1).write.parquet(str(tmp_path / "b"))
    assert [r["external_id"] for r in loaders.summaries(spark, str(tmp_path / "b")).collect()] == ["train_0"]
    spark.createDataFrame([("t", 0, None), ("u", 1, "SUBJ")], "text string, label int, label_text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    assert [json.loads(r["reference_content"])["label_text"] for r in loaders.labelled_sentences(spark, str(tmp_path / "c")).collect()] == ["objective", "SUBJ"]


def test_feed(spark, tmp_path):
    events = [
        {"uri": "e1", "title": {"eng": "A title"}, "summary": {"deu": "s"}, "eventDate": "2024-01-02", "concepts": [{"label": {"eng": "k"}, "type": "x"}], "totalArticleCount": 3},
        {"uri": "e2", "title": {"eng": "Old"}, "eventDate": "2023-01-02", "totalArticleCount": 3},
        {"uri": "", "title": {"eng": "None"}, "eventDate": "2024-01-02", "totalArticleCount": 3},
    ]
    (tmp_path / "events.json").write_text("\n".join(map(json.dumps, events)))
    e = feed.recent_events(spark, str(tmp_path / "events.json"), "2024-01-02 12:00:00")
    known = spark.createDataFrame([("e9",)], "event_registry_uri string")
    assert [(r["event_registry_uri"], r["slug_base"], r["keywords"]) for r in feed.topics_of(e, known).collect()] == [("e1", "a-title", ["k"])]
    articles = [
        {"event_uri": "e1", "uri": "a1", "url": "http://x/1", "title": "T", "body": "one two", "dateTime": "", "dateTimePub": "2024-01-02T03:04:05Z", "source": {"uri": "daily.example.com"}, "authors": [{"name": "A"}, {"name": ""}]},
        {"event_uri": "e1", "uri": "a2", "url": "", "title": "T", "source": {"uri": "x"}},
    ]
    (tmp_path / "articles.json").write_text("\n".join(map(json.dumps, articles)))
    rows = feed.event_articles(spark, str(tmp_path / "articles.json"))
    r = rows.first()
    assert rows.count() == 1 and r["source_name"] == "Daily" and r["author"] == "A" and r["word_count"] == 2 and r["published_at"] is not None
    assert [x["slug_base"] for x in feed.new_sources(rows, known).collect()] == ["daily"]


def test_ingest_once_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v long").write.parquet(str(src / "1"))
    stream = lambda: jobs.file_stream(spark, str(src / "*"), "key string, v long")
    jobs.ingest_once(spark, stream(), "key", out, str(tmp_path / "ck1"))
    spark.createDataFrame([("b", 9), ("c", 4)], "key string, v long").write.parquet(str(src / "2"))
    jobs.ingest_once(spark, stream(), "key", out, str(tmp_path / "ck2"))
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("key", "v").collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_windowed_streams_build(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, n long").selectExpr("k", "timestamp_seconds(n) AS ts").write.parquet(str(tmp_path / "s"))
    s = jobs.file_stream(spark, str(tmp_path / "s"), "k string, ts timestamp")
    seen = []
    jobs.run_available(jobs.tumbling_counts(s, ["k"]), lambda b, _: seen.append(b.count()), str(tmp_path / "c1"), "update")
    assert sum(seen) == 1
    buckets = spark.createDataFrame([("a", 0, 5), ("a", 900, 1), ("b", 900, 2)], "k string, n long, events long").selectExpr("k", "named_struct('start', timestamp_seconds(n)) AS w", "events")
    got = {(r["start_us"], r["k"]): r["events"] for r in jobs.sliding_counts(buckets, ["k"]).collect()}
    assert len(got) == 97 + 96 and got[(0, "a")] == 6 and got[(900_000_000, "a")] == 1 and got[(-85_500_000_000, "a")] == 5
    for df in (jobs.sessions(s, "k"), jobs.deduplicated(s, ["k"])):
        assert df.isStreaming


def test_queries_and_sql_have_the_same_names():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "trending_topics" in queries.queries()


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
