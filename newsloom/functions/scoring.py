"""Coverage, recall and classification scores as Spark columns. Divisions by zero have the stated values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(otherwise)


def coverage(support: Column, partial: Column, total: Column, partial_weight: float = 0.5) -> Column:
    """Share of facts an article covers; 1 if there are none."""
    return F.bround(ratio(support + partial_weight * partial, total, 1.0), 6)


def omission(support: Column, partial: Column, total: Column, partial_weight: float = 0.5) -> Column:
    """Share of facts it omits; 0 if there are none. Serves the vital facts alike."""
    return F.bround(F.when(total != 0, 1 - ratio(support + partial_weight * partial, total)).otherwise(0.0), 6)


def weighted_coverage(support, partial, total, vital_support, vital_partial, vital_total, partial_weight: float = 0.5, vital_weight: float = 2.0) -> Column:
    """Coverage in which vital facts count ``vital_weight`` times; 1 if there are none."""
    vital = vital_support + partial_weight * vital_partial
    other = (support - vital_support) + partial_weight * (partial - vital_partial)
    return F.bround(ratio(vital * vital_weight + other, vital_total * vital_weight + (total - vital_total), 1.0), 6)


def vital_threshold(articles: Column, share: float = 0.25, least: int = 2) -> Column:
    return F.greatest(F.lit(least), F.ceil(articles * share)).cast("long")


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def leaning(left: Column, center: Column, right: Column, margin: Column | float = 0.1) -> Column:
    """The class of the highest probability, 'center' if the second is within the margin; ties go left, center, right."""
    top = F.greatest(left, center, right)
    second = F.element_at(F.sort_array(F.array(left, center, right), asc=False), 2)
    return (
        F.when(left.isNull() | center.isNull() | right.isNull(), None)
        .when(top - second < margin, "center")
        .when(left == top, "left")
        .when(center == top, "center")
        .otherwise("right")
    )


def tone(subjectivity: Column) -> Column:
    return (
        F.when(subjectivity.isNull(), None)
        .when(subjectivity < 0.10, "Highly Objective")
        .when(subjectivity < 0.15, "Mostly Objective")
        .when(subjectivity < 0.22, "Mixed")
        .when(subjectivity < 0.30, "Mostly Subjective")
        .otherwise("Highly Subjective")
    )


def rating(average: Column) -> Column:
    return F.when(average >= 4.5, "Excellent").when(average >= 3.5, "Good").when(average >= 2.5, "Fair").otherwise("Poor")


def clamped(value: Column, low: int = 1, high: int = 5, otherwise: int = 3) -> Column:
    """An integer text within bounds, ``otherwise`` if it is none."""
    number = value.try_cast("int")
    return F.when(number.isNull(), otherwise).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))


def pct(x: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(x * 100, 0).cast("long")


def color_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "mid").otherwise("low")


def theme_bounds(n: Column) -> tuple[Column, Column]:
    """Least and most themes to ask for ``n`` facts."""
    low = F.greatest(F.lit(3), F.least(F.lit(5), F.floor(n / 3)))
    return low.cast("long"), F.least(F.lit(8), F.greatest(low, F.floor(n / 2))).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 where a norm is 0; sums run over doubles in order."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return ratio(dot, norms)


# Labels as models write them.
SUPPORT_WORDS = ["support", "supported", "yes", "full", "full_support"]
PARTIAL_WORDS = ["partial_support", "partial", "partially", "partially_supported"]


def label(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(SUPPORT_WORDS), "support").when(low.isin(PARTIAL_WORDS), "partial_support").otherwise("not_support")


def label_code(raw: Column) -> Column:
    return F.when(raw == "support", "OK").when(raw == "partial_support", "PART").when(raw == "not_support", "MISS").otherwise("?")
