"""Closed cases of the score formulas."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


COUNTS = "pool long, support long, partial long, not_support long, total long, vital_support long, vital_partial long, vital_total long"


@pytest.mark.parametrize(
    ("counts", "weight", "expected"),
    [
        ((7, 0, 3, 10, 3, 0, 4), None, {"coverage": 0.7, "omission": 0.3}),
        ((5, 4, 1, 10, 0, 0, 0), None, {"coverage": 0.7}),
        ((5, 4, 1, 10, 0, 0, 0), 1.0, {"coverage": 0.9}),
        ((3, 0, 2, 5, 3, 0, 3), None, {"coverage": 0.6, "weighted_coverage": 0.75}),
        ((0, 0, 0, 0, 0, 0, 0), None, {"coverage": 1.0, "omission": 0.0, "vital_omission": 0.0, "weighted_coverage": 1.0}),
        ((0, 10, 0, 10, 0, 3, 3), None, {"coverage": 0.5, "vital_omission": 0.5}),
        ((4, 1, 5, 10, 0, 0, 0), None, {"coverage": 0.45, "weighted_coverage": 0.45}),
    ],
)
def test_scores(spark, counts, weight, expected):
    row = scores.with_scores(spark.createDataFrame([(1, *counts)], COUNTS), weight).first()
    assert {k: row[k] for k in expected} == pytest.approx(expected)


def test_weight_zero_means_default(spark):
    df = spark.createDataFrame([(1, 5, 4, 1, 10, 0, 0, 0)], COUNTS)
    assert scores.with_scores(df, 0, 0).first()["coverage"] == 0.7


@pytest.mark.parametrize(("x", "label"), [(0.08, "Highly Objective"), (0.12, "Mostly Objective"), (0.18, "Mixed"), (0.25, "Mostly Subjective"), (0.35, "Highly Subjective"), (None, None)])
def test_tone(spark, x, label):
    assert one(spark, scoring.tone(F.lit(x).cast("double"))) == label


@pytest.mark.parametrize(
    ("p", "label"), [((0.15, 0.70, 0.15), "center"), ((0.80, 0.10, 0.10), "left"), ((0.1, 0.1, 0.8), "right"), ((0.45, 0.15, 0.4), "center"), ((None, None, None), None), ((0.5, 0.0, 0.5), "center")]
)
def test_leaning(spark, p, label):
    assert one(spark, scoring.leaning(*[F.lit(x).cast("double") for x in p])) == label


@pytest.mark.parametrize(("n", "expected"), [(2, 2), (8, 2), (9, 3), (20, 5)])
def test_vital_threshold(spark, n, expected):
    assert one(spark, scoring.vital_threshold(F.lit(n))) == expected


def test_ratings_and_clamp(spark):
    assert [one(spark, scoring.rating(F.lit(x))) for x in (4.5, 3.5, 2.5, 2.4)] == ["Excellent", "Good", "Fair", "Poor"]
    assert [one(spark, scoring.clamped(F.lit(x))) for x in ("7", "-1", "x", None, "4")] == [5, 1, 3, 3, 4]


def test_half_even_percent(spark):
    assert [one(spark, scoring.pct(F.lit(x))) for x in (0.025, 0.035, 0.5)] == [2, 4, 50]


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, scoring.cosine(a, F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, scoring.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_judgment_counts_and_empty(spark):
    schema = "pool long, label string, vital boolean"
    rows = [(1, "support", True), (1, "partial_support", None), (1, None, True), (2, "not_support", False)]
    got = {r["pool"]: r.asDict() for r in scores.judgment_counts(spark.createDataFrame(rows, schema), ["pool"]).collect()}
    assert (got[1]["support"], got[1]["partial"], got[1]["total"], got[1]["vital_total"]) == (1, 1, 3, 2)
    assert got[2]["not_support"] == 1
    assert scores.judgment_counts(spark.createDataFrame([], schema), ["pool"]).count() == 0


def test_micro_f1(spark):
    row = scores.micro_f1(spark.createDataFrame([(2, 0, 2), (0, 1, 1), (3, 1, 0)], "tp long, fp long, fn long")).first()
    assert (row["tp"], row["fp"], row["fn"], row["documents"]) == (5, 2, 3, 3)
    assert row["precision"] == pytest.approx(5 / 7, abs=1e-6) and row["recall"] == 0.625
    empty = scores.micro_f1(spark.createDataFrame([], "tp long, fp long, fn long")).first()
    assert empty["f1"] == 0.0 and empty["documents"] == 0


def test_classification_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None)]
    got = {r["class"]: r.asDict() for r in scores.classification_report(spark.createDataFrame(rows, "t string, p string"), "t", "p", ["a", "b", "c"]).collect()}
    assert got["a"]["support"] == 2 and got["a"]["recall"] == 0.5 and got["a"]["precision"] == 1.0
    assert got["b"]["support"] == 2 and got["b"]["precision"] == 0.5
    assert got["c"]["support"] == 0 and got["c"]["f1"] == 0.0


def test_best_setting_takes_earliest_of_equals(spark):
    rows = [(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)]
    assert scores.best_setting(spark.createDataFrame(rows, "margin double, f1 double"), "margin").first()["margin"] == 0.2


def test_contradiction_consensus(spark):
    rows = [("g", 1, 7), ("g", 2, 3), ("h", 1, 0), ("h", 2, 5), ("i", 1, 1), ("i", 2, 1)]
    got = {r["group"]: r["consensus_index"] for r in scores.contradiction_consensus(spark.createDataFrame(rows, "group string, claim long, supporters long")).collect()}
    assert got == {"g": 0, "i": -1}


def test_fact_matrix(spark):
    j = spark.createDataFrame([(1, 10, 5, "support"), (1, 11, 5, "not_support"), (1, 12, 6, "support")], "pool_id long, article_id long, nugget_id long, label string")
    s = spark.createDataFrame([(10, "A"), (11, "A"), (12, "B")], "article_id long, source string")
    got = {r["nugget_id"]: r["labels"] for r in scores.fact_matrix(j, s, F.col("article_id")).collect()}
    assert got == {5: {"A": "not_support", "B": "no_data"}, 6: {"A": "no_data", "B": "support"}}
