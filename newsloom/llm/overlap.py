"""Problem 3: same or near-same records across splits, by a distributed suffix array over word positions."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.shingling import WordHash, hashed, mix, shingles, words
from newsloom.operators.similar import arrays, class_of, lists, longs
from newsloom.runtime import BitFilter, latest_rows, materialize

_memo = WordHash()
#: Bits of the filter of crossing runs, 16 MB; more runs than an eighth of them are joined instead.
FILTER_BITS = 27


class Overlap:
    """members: (id, side, class); coverage: (class, side, words, shared, spans, longest); links: (train, eval, similarity) of classes."""

    def __init__(self, members: DataFrame, coverage: DataFrame, links: DataFrame):
        self.members, self.coverage, self.links = members, coverage, links


def sides(df: DataFrame, id_col: str, split_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """(id, side, text): side 0 is training (the split begins with 'train', case and blanks aside), 1 any other; null splits are left out."""
    named = df.select(df[id_col].alias("id"), df[split_col].alias("split"), df[text_col].alias("text"), (df[order_col] if order_col else F.lit(0)).alias("at")).where("id is not null")
    one = latest_rows(named, "id", "at")
    return one.where("split is not null and text is not null").select("id", F.when(F.lower(F.trim("split")).startswith("train"), 0).otherwise(1).alias("side"), "text")


def _word_arrays(column) -> list[np.ndarray]:
    """The 32-bit words of a binary column of big-endian words."""
    return [np.frombuffer(x, ">u4") for x in column.to_pylist()]


def _runs(ws: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words at each position."""
    return shingles(mix(ws.astype(np.uint64)), k)


def _suffixes(ws: np.ndarray, k: int, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix with ``k`` words or more, a row of ``depth`` words each; beyond the end stands 0."""
    padded = np.concatenate([ws, np.zeros(depth, ">u4")])
    return np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(ws) - k + 1]


def _keys(rows: np.ndarray) -> pa.Array:
    """Rows of words as binary values, in whose order suffixes are sorted."""
    raw = np.ascontiguousarray(rows, ">u4")
    width = raw.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def _common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words each row of ``a`` has in common with the row of ``b`` from the beginning; ends of text don't count."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1, dtype=np.int32)


def _neighbours(keys: np.ndarray, sides: np.ndarray, before: dict[int, np.ndarray], behind: dict[int, np.ndarray]) -> np.ndarray:
    """Of sorted suffixes the longest common prefix with the nearest suffix of the other side, above and below.

    ``before`` and ``behind`` hold, by side, the last suffix above and the first one below these.
    """
    n = len(keys)
    best, at = np.zeros(n, np.int32), np.arange(n)
    for side in (0, 1):
        mine, other = np.flatnonzero(sides == side), sides != side
        above = np.maximum.accumulate(np.where(other, at, -1))[mine]
        below = np.minimum.accumulate(np.where(other, at, n)[::-1])[::-1][mine]
        for near, none, edge in ((above, -1, before.get(1 - side)), (below, n, behind.get(1 - side))):
            inside = near != none
            best[mine[inside]] = np.maximum(best[mine[inside]], _common_prefix(keys[mine[inside]], keys[near[inside]]))
            if edge is not None and not inside.all():
                out = mine[~inside]
                best[out] = np.maximum(best[out], _common_prefix(keys[out], np.broadcast_to(edge, (len(out), keys.shape[1]))))
    return best


def shared_prefixes(texts: DataFrame, k: int, depth: int = 16, part_suffixes: int = 200_000) -> DataFrame:
    """(class, side, pos, lcp) of every suffix that has at least ``k`` words in common with a suffix of the other side.

    ``texts`` is (class, side, n, words). The suffix array of all texts together: a suffix is a position, its key the
    first ``depth`` words. Bounds from a sample of keys cut the order into parts of about ``part_suffixes`` suffixes;
    each is sorted in one task, equal suffixes of a side once (a task drops its own repeats before it sends them, so a
    suffix that a third of all texts hold is a few rows). The ends of the parts - a row a part - show each part its
    neighbours in the others. lcp is the longest common prefix with the nearest suffixes of the other side, up to ``depth``
    words; what is longer goes on at the next position.
    """
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_suffixes))

    def keys(batches):
        for b in batches:
            rows = [_suffixes(ws, k, depth) for ws in _word_arrays(b.column(1))]
            if rows:
                sides = np.repeat(b.column(0).to_numpy(), [len(r) for r in rows]).astype(np.uint32)
                unique = np.unique(np.column_stack([sides, np.concatenate(rows).astype(np.uint32)]), axis=0)
                yield pa.record_batch([pa.array(unique[:, 0].astype(np.int32)), _keys(unique[:, 1:])], ["side", "key"])

    emitted = texts.select("side", "words").mapInArrow(keys, "side int, key binary")
    bounds: list[bytes] = []
    if parts > 1:
        sample = sorted(bytes(r[0]) for r in emitted.sample(min(1.0, 20 * parts / total), 7).select("key").collect())
        bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    shared_bounds = spark.sparkContext.broadcast(bounds)

    def place(batches):
        cuts = shared_bounds.value
        for b in batches:
            yield pa.record_batch([pa.array([bisect_right(cuts, x) for x in b.column(1).to_pylist()], pa.int32()), b.column(0), b.column(1)], ["part", "side", "key"])

    placed = emitted.mapInArrow(place, "part int, side int, key binary")
    ends = placed.groupBy("part", "side").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect() if bounds else []
    before: dict[int, dict[int, bytes]] = {}
    behind: dict[int, dict[int, bytes]] = {}
    for side in (0, 1):
        mine = sorted((r["part"], bytes(r["low"]), bytes(r["high"])) for r in ends if r["side"] == side)
        for p in range(len(bounds) + 1):
            lower, higher = [h for q, _, h in mine if q < p], [x for q, x, _ in mine if q > p]
            if lower:
                before.setdefault(p, {})[side] = lower[-1]
            if higher:
                behind.setdefault(p, {})[side] = higher[0]
    edges = spark.sparkContext.broadcast((before, behind))

    def measure(batches):
        above, below = edges.value
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            raw = np.frombuffer(b"".join(whole["key"].to_pylist()), ">u4").reshape(-1, depth).astype(np.uint32)
            unique = np.unique(np.column_stack([raw, whole["side"].to_numpy().astype(np.uint32)]), axis=0)
            rows, sides = unique[:, :-1], unique[:, -1]
            edge = lambda x: {s: np.frombuffer(v, ">u4").astype(np.uint32) for s, v in x.get(whole["part"][0].as_py(), {}).items()}
            lcp = _neighbours(rows, sides, edge(above), edge(below))
            keep = lcp >= k
            return pa.record_batch([pa.array(sides[keep].astype(np.int32)), _keys(rows[keep]), pa.array(lcp[keep])], ["side", "key", "lcp"])

        for b in batches:
            while b.num_rows:
                part = b.column(0).to_numpy()
                first = int(np.searchsorted(part, part[0], "right"))
                if held and held[0].column(0)[0].as_py() != part[0]:
                    yield done()
                    held.clear()
                held.append(b.slice(0, first))
                b = b.slice(first)
        if held:
            yield done()

    ordered = placed.repartition("part").sortWithinPartitions("part")
    found = ordered.mapInArrow(measure, "side int, key binary, lcp int").select("side", F.xxhash64("key").alias("h"), "lcp")

    def positions(batches):
        for b in batches:
            rows = [_suffixes(ws, k, depth) for ws in _word_arrays(b.column(2))]
            sizes = [len(r) for r in rows]
            at = pa.array(np.repeat(np.arange(len(rows)), sizes))
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if rows else np.empty(0, np.int32)
            whole = np.concatenate(rows) if rows else np.empty((0, depth), np.uint32)
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(pos), _keys(whole)], ["class", "side", "pos", "key"])

    every = texts.select("class", "side", "words").mapInArrow(positions, "class bigint, side int, pos int, key binary")
    return every.select("class", "side", "pos", F.xxhash64("key").alias("h")).join(found, ["side", "h"]).select("class", "side", "pos", "lcp")


def cross_split_overlap(
    df: DataFrame,
    id_col: str = "id",
    split_col: str = "split",
    text_col: str = "primary_text",
    order_col: str | None = "created_at",
    threshold: float = 0.8,
    k: int = 5,
    min_words: int = 20,
    part_suffixes: int = 200_000,
) -> Overlap:
    """Pairs of a training and an evaluation record whose distinct runs of ``k`` words have a Jaccard similarity of ``threshold`` or more.

    1. Texts with the same runs on one side are one class, so groups of copies enter once. The sides of each run are put
       together on the map side first. A text less than ``threshold`` of whose runs occur on both sides can have no
       partner and stays out of the array: a filter of fixed size tells, or, where there are too many such runs for it, a
       join.
    2. The suffixes of the others are sorted (``shared_prefixes``). Neighbours of different sides with a common prefix of
       ``k`` words or more are shared spans; successive positions merge into longer ones, and all of a text into its
       coverage. Only texts covered to ``threshold`` go on.
    3. Of each the rarest covered runs that any partner must share (prefix filter) are joined across the sides, and every
       pair is verified on all covered runs. Nothing is sampled or capped, the result is exact.

    Rows delivered again count once (the latest by ``order_col``; ties agree). Null splits, ids and texts and texts of
    fewer than ``min_words`` words are left out; an empty table gives no rows; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def enter(batches):
        for b in batches:
            keep, classes, sizes, texts = [], [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                ws = words(t)
                if len(ws) >= max(min_words, k):
                    own = ((hashed(ws, _memo) >> np.uint64(32)) | np.uint64(1)).astype(">u4")
                    distinct = np.unique(_runs(own, k))
                    keep.append(r)
                    classes.append(class_of(distinct))
                    sizes.append(len(distinct))
                    texts.append(own.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), longs(classes), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], ["id", "side", "class", "n", "words"])

    entered = materialize(sides(df, id_col, split_col, text_col, order_col).mapInArrow(enter, f"id {id_type}, side int, class bigint, n int, words binary"), "records")
    members = entered.select("id", "side", "class")
    texts = materialize(entered.groupBy("class", "side").agg(F.first("n").alias("n"), F.first("words").alias("words")), "texts")

    def run_sides(batches):
        """Each run of a batch once with the sides it occurs on: 1 training, 2 the others, 3 both."""
        for b in batches:
            own = [np.unique(_runs(ws, k)) for ws in _word_arrays(b.column(1))]
            if own:
                bits = np.repeat(1 << b.column(0).to_numpy(), [len(x) for x in own])
                values, at = np.unique(np.concatenate(own), return_inverse=True)
                found = np.zeros(len(values), np.int32)
                np.bitwise_or.at(found, at, bits)
                yield pa.record_batch([longs(values), pa.array(found)], ["run", "sides"])

    least = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    both = texts.select("side", "words").mapInArrow(run_sides, "run bigint, sides int").groupBy("run").agg(F.bit_or("sides").alias("sides"))
    crossing = materialize(both.where("sides = 3").select("run"), "crossing-runs")
    if crossing.count() <= (1 << FILTER_BITS) // 8:
        known = BitFilter(crossing, FILTER_BITS)

        def hits(batches):
            for b in batches:
                counted = [int(np.count_nonzero(known.passes(np.unique(_runs(ws, k))))) for ws in _word_arrays(b.column(3))]
                yield pa.record_batch([*b.columns, pa.array(counted, pa.int32())], ["class", "side", "n", "words", "hits"])

        able = texts.mapInArrow(hits, "class bigint, side int, n int, words binary, hits int").where(F.col("hits") >= least).drop("hits")
    else:

        def distinct_runs(batches):
            for b in batches:
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), lists([np.unique(_runs(ws, k)) for ws in _word_arrays(b.column(3))])], ["class", "side", "n", "runs"])

        runs = texts.mapInArrow(distinct_runs, "class bigint, side int, n int, runs array<bigint>").select("class", "side", "n", F.explode("runs").alias("run"))
        counted = runs.join(crossing, "run").groupBy("class", "side").agg(F.first("n").alias("n"), F.count("*").alias("hits")).where(F.col("hits") >= least)
        able = texts.join(counted.select("class", "side"), ["class", "side"])
    kept = materialize(able.select("class", "side", "n", "words"), "able-texts")

    spans = shared_prefixes(kept, k, part_suffixes=part_suffixes).groupBy("class", "side").agg(F.array_sort(F.collect_set("pos")).alias("covered"))

    def covered_runs(batches):
        for b in batches:
            runs, counts, longest = [], [], []
            for ws, at in zip(_word_arrays(b.column(3)), arrays(b.column(4))):
                runs.append(np.unique(_runs(ws, k)[at]))
                breaks = np.flatnonzero(np.diff(at) > 1)
                ends = np.concatenate([[-1], breaks, [len(at) - 1]])
                counts.append(len(breaks) + 1)
                longest.append(int(np.diff(ends).max()) + k - 1)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), lists(runs), pa.array(counts, pa.int32()), pa.array(longest, pa.int32())], ["class", "side", "n", "runs", "spans", "longest"])

    with_spans = kept.join(spans, ["class", "side"]).select("class", "side", "n", "words", "covered")
    covered = materialize(
        with_spans.mapInArrow(covered_runs, "class bigint, side int, n int, runs array<bigint>, spans int, longest int").where(F.size("runs") >= least), "covered"
    )
    tokens = covered.select("class", "side", "n", F.explode("runs").alias("run"))
    ranked = tokens.join(tokens.groupBy("run").agg(F.count("*").alias("width")), "run").groupBy("class", "side").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("width", "run"))).alias("runs"))
    must = F.col("n") - least + 1 - (F.col("n") - F.size("runs"))
    prefix = ranked.select("class", "side", "n", F.explode(F.slice("runs", F.lit(1), F.greatest(must, F.lit(0)))).alias("r")).select("class", "side", "n", F.col("r.run").alias("run"))
    train = prefix.where("side = 0").select(F.col("class").alias("train"), F.col("n").alias("n_train"), "run")
    other = prefix.where("side = 1").select(F.col("class").alias("eval"), F.col("n").alias("n_eval"), "run")
    candidates = train.join(other, "run").where(F.least("n_train", "n_eval") >= threshold * F.greatest("n_train", "n_eval") - 1e-9).select("train", "eval").distinct()
    full = covered.select("class", "side", "n", "runs")
    pairs = candidates.join(full.where("side = 0").select(F.col("class").alias("train"), F.col("n").alias("n_train"), F.col("runs").alias("x")), "train").join(
        full.where("side = 1").select(F.col("class").alias("eval"), F.col("n").alias("n_eval"), F.col("runs").alias("y")), "eval"
    )
    common = pairs.withColumn("common", F.size(F.array_intersect("x", "y")))
    links = materialize(
        common.withColumn("similarity", F.col("common") / (F.col("n_train") + F.col("n_eval") - F.col("common"))).where(F.col("similarity") >= threshold).select("train", "eval", "similarity"), "links"
    )
    coverage = covered.select("class", "side", F.col("n").alias("runs"), F.size("runs").alias("shared"), "spans", "longest")
    return Overlap(members, coverage, links)


def overlapping_pairs(found: Overlap) -> DataFrame:
    """(a, b, train_id, eval_id, similarity) of record ids, a the smaller."""
    m = found.members
    t = m.where("side = 0").select(F.col("class").alias("train"), F.col("id").alias("train_id"))
    e = m.where("side = 1").select(F.col("class").alias("eval"), F.col("id").alias("eval_id"))
    return found.links.join(t, "train").join(e, "eval").select(F.least("train_id", "eval_id").alias("a"), F.greatest("train_id", "eval_id").alias("b"), "train_id", "eval_id", "similarity")


def overlap_report(df: DataFrame, found: Overlap, id_col: str = "id", split_col: str = "split", source_col: str = "source_id", order_col: str = "created_at") -> DataFrame:
    """(split, source, records, overlapping, pairs) of the evaluation splits, split names trimmed and in lower case."""
    named = latest_rows(df.select(df[id_col].alias("id"), df[order_col].alias("at"), df[split_col].alias("split"), df[source_col].alias("source")), "id", "at")
    own = named.select("id", F.lower(F.trim("split")).alias("split"), "source").where("split is not null and not startswith(split, 'train')")
    sizes = found.members.where("side = 0").groupBy(F.col("class").alias("train")).agg(F.count("*").alias("n"))
    per_class = found.links.join(sizes, "train").groupBy(F.col("eval").alias("class")).agg(F.sum("n").alias("pairs"))
    per_record = found.members.where("side = 1").join(per_class, "class").select("id", "pairs")
    return own.join(per_record, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def record_overlaps(found: Overlap) -> DataFrame:
    """(id, side, class, links, shared, runs, spans, longest): each record once, its class and its partners on the other side.

    Coverage (covered and all distinct runs, number of spans, words of the longest) is null for records whose spans cover
    too little for any partner. Copies aren't expanded: links are counted from class sizes.
    """
    sizes = found.members.groupBy("side", "class").agg(F.count("*").alias("n"))
    ends = found.links.select(F.col("train").alias("class"), F.lit(0).alias("side"), F.col("eval").alias("other")).union(found.links.select("eval", F.lit(1), "train"))
    partner = sizes.select((1 - F.col("side")).alias("side"), F.col("class").alias("other"), "n")
    links = ends.join(partner, ["side", "other"]).groupBy("side", "class").agg(F.sum("n").alias("links"))
    rows = found.members.join(links, ["side", "class"], "left").join(found.coverage, ["side", "class"], "left")
    return rows.select("id", "side", "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "shared", "runs", "spans", "longest")
