"""Writes with the semantics of keyed tables, as transformations: the caller stores what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: the first of each key (least by all columns) that isn't stored; null keys are never stored twice nor merged."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    return one.join(stored.select(*keys), keys, "left_anti").select(*rows.columns)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The whole table after an update of existing and insert of new keys; ``rows`` has unique keys and stored's columns or fewer."""
    kept = stored.join(rows.select(*keys), keys, "left_anti")
    given = [c for c in rows.columns if c not in keys]
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in stored.columns if c not in keys and c not in given])
    new = rows.join(old, keys, "left").select(*[F.col(c) if c in rows.columns else F.col(f"_old_{c}").alias(c) for c in stored.columns])
    return kept.unionByName(new)


def replace_children(stored: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The whole table after the children of every parent in ``rows`` were replaced."""
    return stored.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def cascade(children: DataFrame, reference: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent isn't deleted."""
    return children.join(deleted.select(F.col(key).alias(reference)), reference, "left_anti").select(*children.columns)


def set_null(children: DataFrame, reference: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children with the reference to deleted parents nulled."""
    gone = deleted.select(F.col(key).alias(reference), F.lit(True).alias("_gone")).distinct()
    return children.join(gone, reference, "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*children.columns)


def clear_and_load(stored: DataFrame, rows: DataFrame, split: str, clear: bool = False, keys: tuple[str, ...] = ("source_id", "external_id")) -> tuple[DataFrame, DataFrame]:
    """(table afterwards, rows created): optionally drop the split first, then insert absent documents."""
    base = stored.where(~F.col("split").eqNullSafe(split)) if clear else stored
    created = insert_absent(base, rows, list(keys))
    return base.unionByName(created, allowMissingColumns=True), created


def first_image(candidates: DataFrame, ok: str = "ok") -> DataFrame:
    """(topic_id, image_url): of the five earliest candidates the first whose fetch succeeded, '' if none."""
    from newsloom.operators.topics import top_per_group

    five = top_per_group(candidates, ["topic_id"], [F.asc_nulls_last("published_at"), F.asc("id")], 5)
    return five.groupBy("topic_id").agg(F.coalesce(F.min_by(F.when(F.col(ok), F.col("image_url")), F.when(F.col(ok), F.col("rank"))), F.lit("")).alias("image_url"))


def load_counts(rows: DataFrame, created: DataFrame, keys: list[str], facts: DataFrame | None = None) -> DataFrame:
    """One row: documents given (by ``keys``), created and skipped, and the facts extracted of created ones if ``facts`` (with the keys) are there."""
    given = rows.select(*keys).distinct().join(created.select(*keys, F.lit(1).alias("_new")), keys, "left")
    counts = given.agg(F.count("*").alias("given"), F.count("_new").alias("created"), F.count_if(F.col("_new").isNull()).alias("skipped"))
    if facts is None:
        return counts
    return counts.withColumn("facts", F.lit(facts.join(created.select(*keys), keys, "left_semi").count()))
