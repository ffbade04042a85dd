"""Cut values that many articles of a source carry are found, on tables of any size."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import truncated

SCHEMA = "id long, source_id long, content string, summary string"
WHOLE = "The council measured the bridge on Monday and everybody cheered."
WORDS = [a + b for a in "ash elm oak fir yew bay box".split() for b in "ham ton by dale wick ford".split()]


def found(spark, data):
    return {r["id"] for r in truncated.truncation(spark.createDataFrame(data, SCHEMA)).found.collect()}


@pytest.mark.parametrize("copies", [3, 12])
def test_copies_of_a_cut_text(spark, copies):
    cut = [f"{WHOLE} The council opened…", f"{WHOLE} The council"]
    assert found(spark, [(100 * k + i, 1, t, None) for k, t in enumerate(cut) for i in range(copies)]) == {100 * k + i for k in range(2) for i in range(copies)}


@pytest.mark.parametrize("mark", ["[+{} chars]", "[...]", "…"])
def test_mark_on_its_own_line(spark, mark):
    data = [(i, 1, f"The {w} road was closed on Monday.\n" + mark.format(1000 + i), None) for i, w in enumerate(WORDS[:20])]
    assert found(spark, data) == set(range(20))


def test_copies_at_a_limit(spark):
    text = "The council opened the park on Monday and the mayor closed the pool on Friday. "
    data = [(i, 1, f"{w.ljust(7, 'x')} road. {text * 2}"[:120], None) for i, w in enumerate(WORDS[:20])]
    copy = "\nour readers said that"
    data += [(100 + i, 1, f"Ashford path. {text * 2}"[: 119 - len(copy)] + "." + copy, None) for i in range(12)]
    assert found(spark, data) == set(range(20)) | set(range(100, 112))


def test_copies_make_no_limit(spark):
    data = [(i, 1, f"{WHOLE} The council opened…", None) for i in range(30)]
    assert truncated.truncation(spark.createDataFrame(data, SCHEMA)).limits.count() == 0


def test_notices_below_distinct_texts_are_complete(spark):
    data = [(i, 1, f"The {w} road was closed on Monday.\nAll rights reserved. Written for the Kent News", None) for i, w in enumerate(WORDS[:12])]
    assert found(spark, data) == set()


def test_a_limit_whose_cuts_end_in_a_full_stop(spark):
    """Lengths come first: texts cut at 120 that happen to end a sentence there show the limit, and are no cases."""
    data = [(i, 1, f"The {w.ljust(7, 'x')} road was closed on Monday and the mayor opened the pool on Friday, when all of the people came along to see it."[:119] + ".", None) for i, w in enumerate(WORDS[:20])]
    data += [(100 + i, 1, f"{w} is a place{' of note' * i}.", None) for i, w in enumerate(WORDS[:20])]
    t = truncated.truncation(spark.createDataFrame(data, SCHEMA))
    assert {(r["size"], r["values"], r["cut"]) for r in t.limits.where("measure = 'characters'").collect()} == {(120, 20, 0)}
    assert t.found.count() == 0


@pytest.mark.parametrize("times", [1, 4])
def test_texts_of_all_lengths_make_no_limit(spark, times):
    rows = [(i * 1000 + j, 1, f"{WORDS[j % 40]} {j} {'a' * (40 + i)}.", None) for i in range(40) for j in range(6 * times)]
    assert truncated.truncation(spark.createDataFrame(rows, SCHEMA)).limits.count() == 0


def test_nothing_that_grows_with_lengths_or_sources_is_broadcast(spark):
    data = [(i, 1, f"The {w.ljust(7, 'x')} road was closed on Monday and the mayor opened the pool on Friday, when all of the people came along"[:80], None) for i, w in enumerate(WORDS[:20])]
    df = spark.createDataFrame(data, SCHEMA)
    texts = df.select(F.col("source_id").alias("source"), F.lit("content").alias("field_name"), truncated.measures(F.col("content")).alias("sizes"))
    assert "Join" not in truncated.hidden_limits(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in truncated.truncation(df).found._jdf.queryExecution().executedPlan().toString()


def test_limits_against_counting(spark):
    counts = {100: 12, 101: 3, 102: 3, 110: 4, 111: 50, 200: 5, 201: 40, 203: 9, 300: 4, 400: 5}
    sizes = [(1, "content", [("characters", n)]) for n, times in counts.items() for _ in range(times)]
    got = truncated.hidden_limits(spark.createDataFrame(sizes, "source long, field_name string, sizes array<struct<measure: string, size: int>>"))
    want = set()
    for n, times in counts.items():
        usual = sum(counts.get(n + i, 0) for i in range(-10, 11) if abs(i) > 1) / 18
        if times >= 5 and times >= 2 * usual and times >= usual + 5 * (usual + 1) ** 0.5 - 5:
            want.add((n, times))
    assert {(r["size"], r["values"]) for r in got.collect()} == want
