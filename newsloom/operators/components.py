"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges form stars, a number of rounds
    logarithmic in practice. Each step takes minima by map-side combined aggregation and joins them back, so a node with
    very many neighbours is never collected in one place and AQE may split its join. Every round is written to the shared
    folder, which cuts the lineage and survives lost executors, and the one before is deleted; only two numbers a round reach the driver.
    Self-loops and repeated edges don't matter, null ends are left out, an empty table gives no rows.
    """
    named = edges.select(edges[a].alias("u"), edges[b].alias("v")).where("u is not null and v is not null and u != v").distinct()
    current, mark = materialize(named, "edges"), None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, materialize(small, "small-star")
        discard(before, large)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
