"""Queries on nested records (problem 2). SQL can't express the merged schema; tests hold them against a recursive walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators import nested
from newsloom.plans.registry import Registry
from newsloom.runtime import table

registry = Registry()


@registry.add()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(nested.flatten(table(spark, d, "dataset_documents"), columnar=("box_score",)))


@registry.add()
def p2_players(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "dataset_documents"), columnar=("box_score",))["box_score"]


@registry.add()
def p2_provisions(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "dataset_documents"), columnar=("box_score",))["sections/provisions"]
