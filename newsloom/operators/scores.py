"""Counters and scores of judged facts, matrices, contradictions, classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import scoring


def judgment_counts(judgments: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the labels, also among vital facts, from (by..., label, vital)."""
    is_ = lambda x: F.col("label") == x
    vital = F.coalesce("vital", F.lit(False))
    return judgments.groupBy(*by).agg(
        F.count_if(is_("support")).alias("support"),
        F.count_if(is_("partial_support")).alias("partial"),
        F.count_if(is_("not_support")).alias("not_support"),
        F.count("*").alias("total"),
        F.count_if(is_("support") & vital).alias("vital_support"),
        F.count_if(is_("partial_support") & vital).alias("vital_partial"),
        F.count_if(vital).alias("vital_total"),
    )


def with_scores(counts: DataFrame, partial_weight: float | None = None, vital_weight: float | None = None) -> DataFrame:
    """coverage, omission, vital_omission and weighted_coverage beside the counts; weights of 0 or None mean 0.5 and 2."""
    pw, vw = partial_weight or 0.5, vital_weight or 2.0
    c = F.col
    return counts.withColumns(
        {
            "coverage": scoring.coverage(c("support"), c("partial"), c("total"), pw),
            "omission": scoring.omission(c("support"), c("partial"), c("total"), pw),
            "vital_omission": scoring.omission(c("vital_support"), c("vital_partial"), c("vital_total"), pw),
            "weighted_coverage": scoring.weighted_coverage(c("support"), c("partial"), c("total"), c("vital_support"), c("vital_partial"), c("vital_total"), pw, vw),
        }
    )


def fact_matrix(judgments: DataFrame, sources: DataFrame, order: Column) -> DataFrame:
    """(pool_id, nugget_id, labels): a map from each source of the pool to the label of its last article, 'no_data' if none.

    ``judgments`` is (pool_id, article_id, nugget_id, label), ``sources`` (article_id, source). Each pool's sources form
    a set first, so nothing is cross joined beyond the pool's own matrix.
    """
    named = judgments.join(sources, "article_id")
    last = named.groupBy("pool_id", "nugget_id", "source").agg(F.max_by("label", order).alias("label"))
    rows = last.groupBy("pool_id", "nugget_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "label"))).alias("known"))
    columns = named.groupBy("pool_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return rows.join(columns, "pool_id").select(
        "pool_id", "nugget_id", F.map_from_arrays("sources", F.transform("sources", lambda s: F.coalesce(F.try_element_at("known", s), F.lit("no_data")))).alias("labels")
    )


def contradiction_consensus(claims: DataFrame, share: float = 0.65) -> DataFrame:
    """(group, claims, top, consensus_index) from (group, claim, supporters); groups with a claim nobody supports are left out.

    consensus_index is 0 if there are two claims or more and the largest has at least ``share`` of all supporters, else -1.
    """
    g = claims.groupBy("group").agg(F.count("*").alias("claims"), F.min("supporters").alias("least"), F.max("supporters").alias("top"), F.sum("supporters").alias("all"))
    index = F.when((F.col("claims") >= 2) & (scoring.ratio(F.col("top"), F.col("all")) >= share), 0).otherwise(-1)
    return g.where("least > 0").select("group", "claims", "top", index.alias("consensus_index"))


def micro_f1(counts: DataFrame) -> DataFrame:
    """One row: micro-averaged precision, recall and F1 over (tp, fp, fn) per document, mean and population deviation of the documents' F1."""
    p, r = scoring.precision(F.col("tp"), F.col("fp")), scoring.recall(F.col("tp"), F.col("fn"))
    one = counts.withColumn("f", scoring.f1(p, r)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("documents"), F.avg("f").alias("m"), F.stddev_pop("f").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    tp, fp, fn = zero("tp"), zero("fp"), zero("fn")
    mp, mr = scoring.precision(tp, fp), scoring.recall(tp, fn)
    return one.select(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), "documents", F.bround(mp, 6).alias("precision"), F.bround(mr, 6).alias("recall"), F.bround(scoring.f1(mp, mr), 6).alias("f1"),
        F.bround(F.coalesce("m", F.lit(0.0)), 4).alias("f1_mean"), F.bround(F.coalesce("s", F.lit(0.0)), 4).alias("f1_std"),
    )


def classification_report(df: DataFrame, truth: str, predicted: str, classes: list[str], by: list[str] = ()) -> DataFrame:
    """Per class of the fixed list: support, true positives, precision, recall, F1 (6 digits), for each ``by`` group.

    One aggregation gives the confusion counts of all classes; classes without rows have zeros.
    """
    long = F.lit(0).cast("long")
    counts = df.groupBy(*by).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.count_if((F.col(truth) == c) & (F.col(predicted) == c)).alias("tp"),
                    F.count_if((F.col(truth) != c) & (F.col(predicted) == c)).alias("fp"),
                    F.count_if((F.col(truth) == c) & ~F.col(predicted).eqNullSafe(c)).alias("fn"),
                )
                for c in classes
            ]
        ).alias("rows")
    )
    rows = counts.select(*by, F.inline("rows"))
    p, r = scoring.precision(F.col("tp"), F.col("fp")), scoring.recall(F.col("tp"), F.col("fn"))
    return rows.select(*by, "class", (F.col("tp") + F.col("fn") + long).alias("support"), "tp", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(scoring.f1(p, r), 6).alias("f1"))


def best_setting(report: DataFrame, setting: str, score: str = "f1") -> DataFrame:
    """One row: the setting of highest mean score over classes; the least setting of equals, as the earliest of an ascending grid."""
    means = report.groupBy(setting).agg(F.bround(F.avg(score), 6).alias("macro"))
    return means.agg(F.max(F.struct("macro", (-F.col(setting)).alias("s"))).alias("b")).select((-F.col("b.s")).alias(setting), F.col("b.macro").alias("macro"))


def match_counts(matches: DataFrame, by: str) -> DataFrame:
    """(by, tp, fp, fn, mean_similarity) per document from the rows of an optimal matching; documents without truth rows are left out."""
    g = matches.groupBy(by).agg(
        F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"), F.count_if(F.col("kind") == "fn").alias("fn"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity")
    )
    return g.where("tp + fn > 0")
