"""Sequences of repeated lines are whole: gaps over other frequent lines, lines repeated at will, growth against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from newsloom.llm import repeated

SCHEMA = "id long, source_id long, content string"


def mined(spark, texts, min_support):
    df = spark.createDataFrame([(i, 1, "\n".join(t)) for i, t in enumerate(texts)], SCHEMA)
    names = {spark.range(1).select(F.xxhash64(F.lit(x))).first()[0]: x for x in {x for t in texts for x in t}}
    found = [("".join(names[k] for k in r["keys"]), r["support"]) for r in repeated.prefix_span(df, min_support=min_support).collect()]
    lines = {(r["id"], r["line_no"]) for r in repeated.repeated_lines(df, min_support=min_support).collect()}
    return found, lines


def holds(text, pattern):
    rest = iter(text)
    return all(x in rest for x in pattern)


def test_frequent_lines_between_two_elements(spark):
    found, lines = mined(spark, ["abc" if i < 6 else "adc" for i in range(12)] + ["b"] * 5 + ["d"] * 5, 10)
    assert sorted(found) == [("a", 12), ("ac", 12), ("b", 11), ("c", 12), ("d", 11)]
    assert len(lines) == 46


def test_a_line_repeated_a_different_number_of_times(spark):
    found, lines = mined(spark, ["a" * (i + 2) for i in range(5)], 3)
    assert sorted(found) == [("a", 5), ("aa", 5), ("aaa", 4), ("aaaa", 3)]
    assert len(lines) == 20


def test_against_all_subsequences(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcde", [6, 4, 3, 2, 2], k=rng.randint(1, 6))) for _ in range(14)]
    texts += [t.replace("b", "xyb") for t in texts[:6]]
    support = {}
    for t in texts:
        for s in {"".join(c) for n in range(1, len(t) + 1) for c in combinations(t, n)}:
            support[s] = support.get(s, 0) + 1
    frequent = {s: n for s, n in support.items() if n >= 4}
    found, lines = mined(spark, texts, 4)
    assert len({p for p, _ in found}) == len(found)
    assert all(frequent.get(p) == n for p, n in found)
    assert [s for s, n in frequent.items() if not any(m == n and holds(p, s) for p, m in found)] == []
    assert lines == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(t) if x in frequent}
