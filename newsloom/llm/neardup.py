"""Problem 7: near-duplicate records, by a chosen-path similarity join over word shingles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.shingling import mix
from newsloom.operators.components import connected_components
from newsloom.operators.similar import arrays, class_of, lists, longs, shingle_set
from newsloom.runtime import BitFilter, discard, materialize

_SIGNED = np.int64
_SKETCH_BITS = 128
#: Bits of the filter of ids whose sets are wanted: 8 MB, whatever their number.
FILTER_BITS = 26
_rng = np.random.default_rng(20240501)
_MULTIPLIERS = (_rng.integers(0, 1 << 32, _SKETCH_BITS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADDENDS = _rng.integers(0, 1 << 32, _SKETCH_BITS, dtype=np.uint32)[:, None]


def sketch(s: np.ndarray) -> np.ndarray:
    """128 one-bit minwise values in two words; sets of similarity J agree on about (1 + J) / 2 of them."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = (low[None, :] * _MULTIPLIERS + _ADDENDS).min(axis=1)
    return np.packbits((least >> np.uint32(7)).astype(np.uint8) & 1).view(np.uint64)


def survival(deepest: int) -> float:
    """The least probability that two sets at the threshold meet in one run whose nodes are all crowded.

    At each node they have at least one common child in expectation (exactly one where one set holds the other); the path
    goes on below it, until all children end at the depth ``deepest``. For ``deepest`` 1 it is 1 - 1/e.
    """
    met = 1 - math.exp(-1)
    for _ in range(deepest - 1):
        met = 1 - math.exp(-met)
    return met


def runs_for(recall: float, deepest: int) -> int:
    """How many runs miss at most 1 - ``recall`` of the pairs at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(deepest)))


def roots(first: int, last: int) -> np.ndarray:
    """The root nodes of the runs from ``first`` up to ``last``."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def children(nodes: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
    """The nodes below ``nodes`` that a set takes: of its tokens each is chosen, by a hash all sets share, with probability 1 / (threshold * size)."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    below = mix(nodes[:, None] ^ s[None, :])
    return np.unique(below[mix(below) < limit])


def halves(sets: list[np.ndarray]) -> pa.Array:
    """The upper halves of the tokens of sorted sets, each once."""
    own = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
    offsets = np.zeros(len(own) + 1, np.int32)
    np.cumsum([len(x) for x in own], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int32) if own else np.empty(0, np.int32)))


class NearDuplicates:
    """members: (id, class), one row per text long enough; links: (a, b, similarity) between classes, a < b."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def _pairs_in_bucket(classes, sizes, sketches, parts, threshold: float, differ: int, block: int = 512):
    """Brute force over one bucket in blocks: pairs whose sketches and sizes allow the similarity; of a split bucket only pairs across its two parts."""
    n = len(classes)
    for i in range(0, n, block):
        left = sketches[i : i + block]
        for j in range(i, n, block):
            right = sketches[j : j + block]
            bits = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int32)
            small = np.minimum(sizes[i : i + block][:, None], sizes[j : j + block][None, :])
            large = np.maximum(sizes[i : i + block][:, None], sizes[j : j + block][None, :])
            a, b = np.nonzero((bits <= differ) & (small >= threshold * large))
            a, b = a + i, b + j
            keep = (a < b) & ((parts[a] < 0) | (parts[a] != parts[b]))
            yield classes[a[keep]], classes[b[keep]]


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    threshold: float = 0.7,
    k: int = 5,
    min_words: int = 50,
    recall: float = 0.999,
    bucket: int = 2000,
    deepest: int = 3,
) -> NearDuplicates:
    """All pairs of texts whose shingle sets have a Jaccard similarity of at least ``threshold``, as classes and links.

    Texts with the same set form a class, so copies add no work. The sets are split recursively by shared tokens: at each
    node of a random tree a set chooses its tokens by a hash all sets share, with probability 1 / (threshold * size), and
    goes on in the child of each. Nodes are counted level by level over all sets; one that at most ``bucket`` classes
    reach is a small bucket and compared by brute force, its sets go no deeper; those of a crowded node are split again
    below it. Two sets of similarity J meet in J / threshold children of a node in expectation, so a pair at the
    threshold is missed by one run of uncrowded nodes with probability 1/e at most; ceil(-ln(1 - recall)) + 3 runs are
    made by all. Below crowded nodes a pair must survive at each level (``survival``): classes that reach any make all
    the runs that ``recall`` asks for at the greatest depth. Nodes still crowded at ``deepest`` are split into blocks,
    whose pairs are compared in tasks of their own, so no bucket of a task exceeds twice ``bucket``.

    No count or token reaches the driver but whether a level has crowded nodes. Buckets are compared by 128-bit sketches,
    far below the threshold in what they reject, and every pair that is left is verified on its sets: by the upper halves
    of the tokens, and by whole tokens where a few tokens more or less would change the verdict. Each class enters once,
    from the first aggregation on; one shuffle moves (path, class, size, sketch). Sets are made and shuffled of candidates
    and of classes below crowded nodes only, half tokens of them. Null texts and texts with fewer words aren't members; a null id is left out; rows delivered
    again count once (texts of one id are taken to agree); an empty table gives no rows; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    least = math.ceil(-math.log(1 - recall)) + 3
    most = max(least, runs_for(recall, deepest))

    def enter(batches):
        first = roots(0, least)
        for b in batches:
            keep, classes, sizes, sketches, ways = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                s = shingle_set(t, k, min_words)
                if s is not None:
                    keep.append(r)
                    classes.append(class_of(s))
                    sizes.append(len(s))
                    sketches.append(sketch(s))
                    ways.append(children(first, s, threshold))
            both = np.array(sketches, np.uint64).reshape(-1, 2).view(_SIGNED)
            yield pa.record_batch(
                [b.column(0).take(pa.array(keep, pa.int64())), longs(classes), pa.array(sizes, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists(ways)],
                ["id", "class", "size", "s0", "s1", "paths"],
            )

    def descend(batches):
        """From (class, size, s0, s1, set, first, paths): the children of the paths, in the first descent also the first level of the further runs."""
        further = roots(least, most)
        for b in batches:
            ways = []
            for s, nodes, start in zip(arrays(b.column(4)), arrays(b.column(6)), b.column(5).to_pylist()):
                s, nodes = s.view(np.uint32).astype(np.uint64), nodes.view(np.uint64)
                ways.append(children(np.concatenate([nodes, further]) if start else nodes, s, threshold))
            yield pa.record_batch([*(b.column(i) for i in range(4)), lists(ways)], ["class", "size", "s0", "s1", "paths"])

    def sets_of(wanted: DataFrame, half: bool) -> DataFrame:
        """(class, set) of at least the classes in ``wanted``, from the least text of each; ``half`` gives the upper halves of tokens.

        The texts pass a filter of the wanted ids on their way into the shingling, so none is shuffled; a class comes out
        more than once if its text was delivered again.
        """
        ids = BitFilter(members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).select(F.xxhash64("id").alias("h")), FILTER_BITS)

        def sets(batches):
            for b in batches:
                rows = b.filter(pa.array(ids.passes(b.column(0).to_numpy())))
                own = [s for s in (shingle_set(t, k, min_words) for t in rows.column(1).to_pylist()) if s is not None]
                yield pa.record_batch([longs([class_of(s) for s in own]), halves(own) if half else lists(own)], ["class", "set"])

        return texts.select(F.xxhash64("id"), "text").mapInArrow(sets, f"class bigint, set array<{'int' if half else 'bigint'}>")

    entered = materialize(texts.mapInArrow(enter, f"id {id_type}, class bigint, size int, s0 bigint, s1 bigint, paths array<bigint>"), "paths")
    members = entered.select("id", "class").distinct()
    differ = int(_SKETCH_BITS * (1 - threshold) / 2 + 4.5 * math.sqrt(_SKETCH_BITS * (1 + threshold) * (1 - threshold)) / 2)

    def compare(batches):
        held: list[tuple] = []

        def within(parts):
            path, cls, size, part, sk = (np.concatenate(x) for x in zip(*parts))
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            ends = np.r_[starts[1:], len(path)]
            a, b = [], []
            for i, j in zip(starts, ends):
                if j - i > 1:
                    for x, y in _pairs_in_bucket(cls[i:j], size[i:j], sk[i:j], part[i:j], threshold, differ):
                        a.append(x)
                        b.append(y)
            a, b = (np.concatenate(x) if x else np.empty(0, _SIGNED) for x in (a, b))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)  # a class delivered again may meet itself
            return pa.record_batch([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], ["a", "b"])

        for batch in batches:
            path = batch.column(0).to_numpy()
            if not len(path):
                continue
            sk = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1).view(np.uint64)
            part = (path, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(5).to_numpy(), sk)
            last = int(np.searchsorted(path, path[-1]))  # the last bucket may go on in the next batch
            if last:
                held.append(tuple(x[:last] for x in part))
                yield within(held)
                held = []
            held.append(tuple(x[last:] for x in part))
        if held:
            yield within(held)

    def pairs_in(ways: DataFrame) -> DataFrame:
        return ways.repartition("path").sortWithinPartitions("path").mapInArrow(compare, "a bigint, b bigint")

    once = entered.groupBy("class").agg(*[F.first(c).alias(c) for c in ("size", "s0", "s1", "paths")])
    level, depth, known, found, spent = once, 1, None, [], []
    while True:
        ways = level.select(F.explode("paths").alias("path"), "class", "size", "s0", "s1")
        crowded = materialize(ways.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > bucket), f"crowded-{depth}")
        if crowded.isEmpty():
            found.append(pairs_in(ways.withColumn("part", F.lit(-1))))
            break
        marked = ways.join(crowded, "path", "left")
        small = marked.where("n is null").select("path", "class", "size", "s0", "s1", F.lit(-1).alias("part"))
        if depth == deepest:
            blocks = F.ceil(F.col("n") / bucket).cast("int")
            own = F.pmod(F.xxhash64("class"), blocks).cast("int")
            other = F.explode(F.sequence(F.lit(0), blocks - 1))
            split = marked.where("n is not null").withColumn("own", own).select("*", other.alias("other"))
            block = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
            part = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
            found.append(pairs_in(small.unionByName(split.select(block.alias("path"), "class", "size", "s0", "s1", part.alias("part")))))
            break
        found.append(pairs_in(small))
        inside = marked.where("n is not null").groupBy("class").agg(F.first("size").alias("size"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.collect_list("path").alias("paths"))
        inside = materialize(inside, f"inside-{depth}")
        if known is None:
            known = materialize(sets_of(inside.select("class"), True), "crowded-sets")
        below = inside.join(known, "class").select("class", "size", "s0", "s1", "set", F.lit(depth == 1).alias("first"), "paths")
        level = materialize(below.mapInArrow(descend, "class bigint, size int, s0 bigint, s1 bigint, paths array<bigint>"), f"paths-{depth + 1}")
        spent += [crowded, inside, level]
        depth += 1
    candidates = materialize(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    discard(*spent, *[known for _ in spent[:1]])

    # verification on the sets of the candidates' classes
    def with_sets(pairs: DataFrame, half: bool) -> DataFrame:
        own = materialize(sets_of(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), half), "sets")
        return pairs.join(own.withColumnsRenamed({"class": "a", "set": "set_a"}), "a").join(own.withColumnsRenamed({"class": "b", "set": "set_b"}), "b").select("a", "b", "set_a", "set_b")

    def verify(batches):
        for b in batches:
            similarity, spare = [], []
            for x, y in zip(arrays(b.column(2)), arrays(b.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                similarity.append(common / (len(x) + len(y) - common))
                spare.append(common - threshold * (len(x) + len(y)) / (1 + threshold))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(similarity, pa.float64()), pa.array(spare, pa.float64())], ["a", "b", "similarity", "spare"])

    verdict = "a bigint, b bigint, similarity double, spare double"
    by_halves = materialize(with_sets(candidates, True).mapInArrow(verify, verdict).where("spare >= -4").distinct(), "half-verified")
    closely = with_sets(by_halves.where("spare < 4").select("a", "b"), False).mapInArrow(verify, verdict).where(F.col("similarity") >= threshold)
    links = materialize(by_halves.where("spare >= 4").unionByName(closely).select("a", "b", "similarity").dropDuplicates(["a", "b"]), "links")
    discard(candidates, by_halves)
    return NearDuplicates(members, links)


def linked_pairs(found: NearDuplicates) -> DataFrame:
    """(a, b) of ids, a < b: pairs of one class and pairs of linked classes."""
    m = found.members
    across = found.links.select("a", "b").join(m.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    repeated = m.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    copies = m.join(repeated.select("class"), "class", "left_semi")
    within = copies.withColumnRenamed("id", "x").join(copies.withColumnRenamed("id", "y"), "class").where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))


def grouped(found: NearDuplicates) -> DataFrame:
    """(id, class, group, links): each member once, the class of its text, the least id of all that links connect it with, and how many members it is linked to.

    Copies aren't expanded: links are counted from class sizes, groups are components of classes.
    """
    sizes = found.members.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("head"))
    both = found.links.select("a", "b").union(found.links.select("b", "a"))
    other = both.join(sizes.select(F.col("class").alias("b"), "n"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    component = connected_components(found.links).select(F.col("node").alias("class"), "root")
    placed = sizes.join(component, "class", "left").withColumn("root", F.coalesce("root", "class"))
    heads = placed.groupBy("root").agg(F.min("head").alias("group"))
    classes = placed.join(heads, "root").join(other, "class", "left")
    return found.members.join(classes, "class").select("id", "class", "group", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def group_report(members: DataFrame, df: DataFrame, id_col: str = "id", title_col: str = "title", wire_col: str = "is_wire_content") -> DataFrame:
    """(group, articles, classes, titles, marked) of the groups of two or more, from ``grouped``: different texts, different titles (case and blanks aside, blank ones none) and how many are marked as wire copy (on any delivery)."""
    title = F.nullif(F.lower(F.trim(df[title_col])), F.lit(""))
    facts = df.select(df[id_col].alias("id"), F.xxhash64(title).alias("h"), title.isNotNull().alias("titled"), F.coalesce(df[wire_col], F.lit(False)).alias("wire"))
    one = facts.groupBy("id").agg(F.min(F.when(F.col("titled"), F.col("h"))).alias("title"), F.bool_or("wire").alias("wire"))
    rows = members.join(one, "id", "left").groupBy("group").agg(F.count("*").alias("articles"), F.count_distinct("class").alias("classes"), F.count_distinct("title").alias("titles"), F.count_if("wire").alias("marked"))
    return rows.where("articles > 1")
