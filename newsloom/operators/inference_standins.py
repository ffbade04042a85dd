"""Models made of column expressions, for queries and tests: the answer follows from the prompt alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answers_with(answer: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """An ``ask`` that adds ``answer`` to rows with a ``prompt``."""
    return lambda prompts: prompts.withColumn("answer", answer(F.col("prompt")))
