"""MinHash signatures and banded candidates: the approximate way to similar texts, for scales where exactness isn't needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.similar import shingle_set

_rng = np.random.default_rng(128)
_MOST = 512
_A = (_rng.integers(0, 1 << 32, _MOST, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, _MOST, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, num_perm: int = 128) -> np.ndarray:
    """The least value of each of ``num_perm`` hash functions over a set of 64-bit shingles."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    return (low[None, :] * _A[:num_perm] + _B[:num_perm]).min(axis=1)


def signatures(df: DataFrame, id_col: str, text_col: str, num_perm: int = 128, k: int = 5) -> DataFrame:
    """(id_col, signature ARRAY<INT>) of texts with at least ``k`` words; null ids and texts are left out. Map-only."""
    named = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    id_type = named.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            keep, out = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                s = shingle_set(t, k)
                if s is not None:
                    keep.append(r)
                    out.append(signature(s, num_perm).view(np.int32))
            flat = np.concatenate(out) if out else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * num_perm), pa.array(flat))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), lists], ["id", "signature"])

    return named.mapInArrow(run, f"id {id_type}, signature array<int>").withColumnRenamed("id", id_col)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures; the standard error is about 1 / sqrt(positions)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def banding(threshold: float, num_perm: int = 128) -> tuple[int, int]:
    """(bands, rows) with bands * rows <= num_perm of least false positive plus false negative mass around the threshold."""
    grid = np.linspace(0, 1, 1001)
    best = (np.inf, 1, num_perm)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1 - (1 - grid**rows) ** bands
            error = 0.5 * np.trapezoid(hit[grid <= threshold], grid[grid <= threshold]) + 0.5 * np.trapezoid(1 - hit[grid >= threshold], grid[grid >= threshold])
            best = min(best, (error, bands, rows))
    return best[1], best[2]


def banded_edges(signed: DataFrame, by: list[str], id_col: str, threshold: float = 0.7, num_perm: int = 128) -> DataFrame:
    """(a, b): each text to the least text of every bucket it shares, from (by..., id_col, signature).

    The edges connect what falls into one bucket, without pairs of it; they are candidates, not verified.
    """
    bands, rows = banding(threshold, num_perm)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, F.lit(rows))).alias("bucket")))
    buckets = signed.select(*by, F.col(id_col).alias("id"), F.inline(keys))
    least = buckets.groupBy(*by, "band", "bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return buckets.join(least, [*by, "band", "bucket"]).where("id != a").select("a", F.col("id").alias("b")).distinct()
