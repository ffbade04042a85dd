"""Lines of multi-line texts and the key under which two lines are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_key(line: Column) -> Column:
    """The line without letter case, digits and white space of any kind (no-break space too)."""
    return F.regexp_replace(F.lower(line), r"(?U)[\s\d]+", "")


def exploded(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., line_no, line), one row per line of the column ``text``; null texts give none."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def distinct_support(df: DataFrame, by: list[str], of: str, name: str = "support") -> DataFrame:
    """How many distinct values of ``of`` each group has; pre-aggregated before both shuffles, so hot groups stay small."""
    return df.select(*by, of).distinct().groupBy(*by).agg(F.count("*").alias(name))
