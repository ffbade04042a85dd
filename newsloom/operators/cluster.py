"""Order-dependent clustering and optimal matching of vectors: grouped numpy, one group (a pool) per call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def greedy_assign(vectors, threshold: float) -> tuple[list[int], list[int]]:
    """Cluster of each vector in order, and each cluster's representative.

    A vector joins the cluster whose renormalised mean is most similar (the first of equals) if the similarity reaches
    the threshold, else it opens one; sums are kept running. The representative is the member closest to the final mean.
    """
    x = _unit(vectors)
    sums = np.zeros_like(x)
    means = np.zeros_like(x)
    out, n = [], 0
    for v in x:
        best = -1
        if n:
            sims = means[:n] @ v
            k = int(np.argmax(sims))
            best = k if sims[k] >= threshold else -1
        if best < 0:
            best, n = n, n + 1
        sums[best] += v
        norm = np.linalg.norm(sums[best])
        means[best] = sums[best] / norm if norm > 0 else sums[best]
        out.append(best)
    assigned = np.array(out)
    heads = []
    for c in range(n):
        members = np.flatnonzero(assigned == c)
        heads.append(int(members[np.argmax(x[members] @ means[c])]))
    return out, heads


def greedy_clusters(df: DataFrame, pool: str, item: str, vector: str, source: str, threshold: float = 0.85) -> DataFrame:
    """(pool, item, cluster_id, source_count, is_representative) of items taken in order of ``item`` within each pool.

    The order makes it sequential within a pool, so a pool is one task's work: it must fit there, as the items of one
    story do. Null pools, items and vectors are left out; a threshold of 0 or None means 0.85.
    """
    limit = threshold or 0.85
    named = df.select(df[pool].alias("pool"), df[item].alias("item"), df[vector].alias("vector"), df[source].cast("string").alias("source")).where("pool is not null and item is not null and vector is not null")
    types = {f.name: f.dataType.simpleString() for f in named.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        assigned, heads = greedy_assign(pdf["vector"], limit)
        pdf["cluster_id"] = assigned
        pdf["source_count"] = pdf.groupby("cluster_id")["source"].transform("nunique")
        pdf["is_representative"] = False
        pdf.loc[heads, "is_representative"] = True
        return pdf[["pool", "item", "cluster_id", "source_count", "is_representative"]]

    out = named.groupBy("pool").applyInPandas(run, f"pool {types['pool']}, item {types['item']}, cluster_id bigint, source_count bigint, is_representative boolean")
    return out.withColumnsRenamed({"pool": pool, "item": item})


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a square assignment of least total cost (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        least = np.full(n + 1, np.inf)
        way = np.zeros(n + 1, int)
        used = np.zeros(n + 1, bool)
        j = 0
        while True:
            used[j] = True
            r = row_of[j]
            free = ~used
            free[0] = False
            reduced = np.where(free[1:], cost[r - 1] - u[r] - v[1:], np.inf)
            better = free[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            nxt = int(np.argmin(np.where(free[1:], least[1:], np.inf))) + 1
            delta = least[nxt]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free[1:]] -= delta
            j = nxt
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    columns = np.zeros(n, int)
    columns[row_of[1:] - 1] = np.arange(n)
    return columns


def match(similarity: np.ndarray, threshold: float = 0.8) -> list[tuple[int, int, float]]:
    """Pairs (row, column, similarity) of the best one-to-one matching that reach the threshold; missing partners cost 1."""
    rows, columns = similarity.shape
    if not rows or not columns:
        return []
    n = max(rows, columns)
    cost = np.ones((n, n))
    cost[:rows, :columns] = -similarity
    chosen = assignment(cost)
    return [(i, int(j), float(similarity[i, j])) for i, j in enumerate(chosen[:rows]) if j < columns and similarity[i, j] >= threshold]


def optimal_match(extracted: DataFrame, truth: DataFrame, by: str, item: str, vector: str, threshold: float = 0.8) -> DataFrame:
    """(by, extracted, truth, similarity, kind) per group: kind is tp for pairs, fp for extracted and fn for true items left.

    Both tables have the columns ``by``, ``item`` and ``vector``; groups are cogrouped, an absent side counts as empty.
    """
    limit = threshold or 0.8
    kind = extracted.schema[item].dataType.simpleString()
    key = extracted.schema[by].dataType.simpleString()

    def run(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (side.set_axis(["g", "item", "vector"], axis=1).sort_values("item").reset_index(drop=True) for side in (a, b))
        pairs = match(_unit(a["vector"]) @ _unit(b["vector"]).T, limit) if len(a) and len(b) else []
        left, right = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
        rows = [(group[0], a["item"][i], b["item"][j], s, "tp") for i, j, s in pairs]
        rows += [(group[0], a["item"][i], None, None, "fp") for i in range(len(a)) if i not in left]
        rows += [(group[0], None, b["item"][j], None, "fn") for j in range(len(b)) if j not in right]
        out = pd.DataFrame(rows, columns=["g", "extracted", "truth", "similarity", "kind"])
        return out.astype({"extracted": "Int64", "truth": "Int64"}) if kind in ("bigint", "int") else out

    def side(df: DataFrame) -> DataFrame:
        named = df.select(df[by].alias("g"), df[item].alias("item"), df[vector].alias("vector"))
        return named.where("item is not null and vector is not null")

    grouped = side(extracted).groupBy("g").cogroup(side(truth).groupBy("g"))
    return grouped.applyInPandas(run, f"g {key}, extracted {kind}, truth {kind}, similarity double, kind string").withColumnRenamed("g", by)
