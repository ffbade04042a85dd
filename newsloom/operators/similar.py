"""Exact similarity join of texts within groups: prefix filtering over word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.shingling import WordHash, hashed, shingles, words
from newsloom.runtime import materialize

_memo = WordHash()


def shingle_set(text: str | None, k: int, min_words: int = 0) -> np.ndarray | None:
    """The sorted distinct shingles of a text; None if it has fewer than ``min_words`` or ``k`` words."""
    ws = words(text or "")
    if len(ws) < max(min_words, k):
        return None
    return np.unique(shingles(hashed(ws, _memo), k))


def class_of(s: np.ndarray) -> int:
    """64-bit identity of a shingle set: texts with the same set are one class."""
    return xxhash.xxh3_64_intdigest(s.tobytes())


def longs(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The values of a list column without nulls, row by row."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offsets, offsets[1:])]


class SimilarTexts:
    """members: (grp, id, class); links: (grp, a, b, similarity) between classes of a group, a < b."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def similar_texts(df: DataFrame, group_col: str, id_col: str, text_col: str, threshold: float = 0.7, k: int = 5) -> SimilarTexts:
    """Pairs of texts of one group whose shingle sets have a Jaccard similarity of at least ``threshold``; exact.

    Texts of a group with one set are a class. Shingles are counted by group over all classes, on the map side first;
    those of one class only can't be shared and go. A set of n shingles shares at least ceil(threshold * n) with a partner,
    so of those it has left all but ceil(threshold * n) - 1, the rarest of the group first, are joined (prefix filter).
    Pairs are verified on the shared shingles. The counts stay a table that is joined; nothing is
    collected or broadcast but by Spark's own size-checked choice. Null groups, ids and texts and texts of fewer than
    ``k`` words aren't members.
    """
    named = df.select(df[group_col].alias("grp"), df[id_col].alias("id"), df[text_col].alias("text")).where("grp is not null and id is not null and text is not null")
    types = {f.name: f.dataType.simpleString() for f in named.schema}

    def enter(batches):
        for b in batches:
            keep, classes, sets = [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                s = shingle_set(t, k)
                if s is not None:
                    keep.append(r)
                    classes.append(class_of(s))
                    sets.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), longs(classes), lists(sets)], ["grp", "id", "class", "items"])

    entered = materialize(named.mapInArrow(enter, f"grp {types['grp']}, id {types['id']}, class bigint, items array<bigint>"), "similar")
    members = entered.select("grp", "id", "class").distinct()
    first = entered.groupBy("grp", "class").agg(F.first("items").alias("items"))
    tokens = first.select("grp", "class", F.size("items").alias("n"), F.explode("items").alias("token"))
    counts = tokens.groupBy("grp", "token").agg(F.count("*").alias("texts")).where("texts > 1")
    ranked = tokens.join(counts, ["grp", "token"]).groupBy("grp", "class").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("shared"))
    least = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    able = materialize(ranked.where(F.size("shared") >= least).select("grp", "class", "n", F.col("shared.token").alias("shared")), "similar-shared")
    prefix = able.select("grp", "class", "n", F.explode(F.slice("shared", F.lit(1), F.size("shared") - least + 1)).alias("token"))
    left, right = prefix.withColumnsRenamed({"class": "a", "n": "na"}), prefix.withColumnsRenamed({"class": "b", "n": "nb"})
    pairs = left.join(right, ["grp", "token"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("grp", "a", "b").distinct()
    both = pairs.join(able.withColumnsRenamed({"class": "a", "n": "na", "shared": "x"}), ["grp", "a"]).join(able.withColumnsRenamed({"class": "b", "n": "nb", "shared": "y"}), ["grp", "b"])
    common = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    links = common.withColumn("similarity", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).where(F.col("similarity") >= threshold)
    return SimilarTexts(members, materialize(links.select("grp", "a", "b", "similarity"), "similar-links"))


def linked(found: SimilarTexts) -> DataFrame:
    """(grp, id, class_id, links): each member, the least id of its class, and the number of other members similar to it."""
    sizes = found.members.groupBy("grp", "class").agg(F.count("*").alias("n"), F.min("id").alias("class_id"))
    both = found.links.select("grp", "a", "b").union(found.links.select("grp", "b", "a"))
    others = both.join(sizes.select("grp", F.col("class").alias("b"), "n"), ["grp", "b"]).groupBy("grp", F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    rows = found.members.join(sizes, ["grp", "class"]).join(others, ["grp", "class"], "left")
    return rows.select("grp", "id", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
