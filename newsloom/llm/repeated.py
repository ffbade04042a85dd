"""Problem 4: lines repeated across the documents of one source, by distributed PrefixSpan over line identifiers."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.lines import distinct_support, exploded, line_key
from newsloom.runtime import discard, materialize


def line_occurrences(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(source, id, line_no, key) of every line with a key; the key is a 64-bit hash."""
    named = df.select(df[source_col].alias("source"), df[id_col].alias("id"), df[text_col].alias("text")).where("source is not null and id is not null")
    lines = exploded(named, "text", "source", "id").withColumn("k", line_key(F.col("line")))
    return lines.where("k != ''").select("source", "id", "line_no", F.xxhash64("k").alias("key"))


def frequent_lines(df: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "content", min_support: int = 10) -> DataFrame:
    """(source, id, line_no, key, support), once each: the lines that at least ``min_support`` documents of their source hold.

    The first level of PrefixSpan. Lines are read once and written as hashes; support is aggregated by (source, line,
    document) on the map side first, so a line that a third of all documents share costs no task more than its distinct
    documents' counters.
    """
    lines = materialize(line_occurrences(df, id_col, source_col, text_col), "lines")
    support = distinct_support(lines, ["source", "key"], "id").where(F.col("support") >= min_support)
    return lines.join(support, ["source", "key"]).select("source", "id", "line_no", "key", "support").distinct()


def _elements(frequent: DataFrame) -> DataFrame:
    """(source, id, at, keys, element): the frequent lines of each document in order, lines that never occur apart taken together.

    Two different lines are taken together if each occurrence of the one is followed by the other, and each of the other
    preceded by it, frequent lines alone considered: any sequence with one of them can take up the other at no loss of
    support. A 2,000-line notice is one element so, found without a round a line.
    """
    order = Window.partitionBy("source", "id").orderBy("line_no", "key")
    ranked = materialize(frequent.select("source", "id", "key", F.row_number().over(order).alias("at"), F.lead("key").over(order).alias("next"), F.lag("key").over(order).alias("last")), "ranked-lines")
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    sides = ranked.groupBy("source", "key").agg(one("next").alias("next"), one("last").alias("last"))
    after, before = sides.where("next is not null and next != key").select("source", "key", "next"), sides.where("last is not null").select("source", F.col("key").alias("next"), F.col("last").alias("key"))
    glued = after.join(before, ["source", "key", "next"]).select("source", "key", F.lit(1).alias("glued"))
    linked = ranked.join(glued, ["source", "key"], "left")
    by_place = Window.partitionBy("source", "id").orderBy("at")
    begins = F.coalesce(F.lag("glued").over(by_place), F.lit(0)) == 0
    runs = linked.withColumn("begins", begins).withColumn("run", F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(by_place))
    runs = runs.groupBy("source", "id", "run").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("k"))
    return runs.select("source", "id", F.col("run").alias("at"), F.col("k.key").alias("keys"), F.xxhash64("k.key").alias("element"))


def periods(prefix: list[int], seq: list[int]) -> list[tuple[int, int]]:
    """(place, element), once each, of a sequence that holds ``prefix``.

    Place 0: what follows the first instance of the prefix, its projected suffix. Place i: what stands before element i of the
    prefix (counted from 0) wherever the prefix can grow on from its first instance; -i: wherever the whole of it can stand.
    """
    ends, p = [], -1
    for e in prefix:
        p = seq.index(e, p + 1)
        ends.append(p)
    out = [(0, x) for x in set(seq[p + 1 :])]
    for sign, upto in ((1, p + 1), (-1, len(seq))):
        for i in range(len(prefix) - 1, 0, -1):
            upto -= 1
            while seq[upto] != prefix[i]:
                upto -= 1
            out += [(sign * i, x) for x in set(seq[ends[i - 1] + 1 : upto])]
    return out


def _project(batches):
    """(source, pattern, prefix, seq, weight) to (source, pattern, place, element, weight)."""
    for b in batches:
        rows, places, elements = [], [], []
        for r, (prefix, seq) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for place, element in periods(prefix, seq):
                rows.append(r)
                places.append(place)
                elements.append(element)
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(places, pa.int32()), pa.array(elements, pa.int64()), b.column(4).take(at)], ["source", "pattern", "place", "element", "weight"])


def _mined(frequent: DataFrame, min_support: int) -> DataFrame:
    """(source, pattern, length, keys, support) of ``prefix_span``, from the materialized frequent lines."""
    elements = materialize(_elements(frequent), "elements")
    own = materialize(elements.groupBy("source", "element").agg(F.first("keys").alias("own"), F.count_distinct("id").alias("support")), "own-keys")
    whole = elements.groupBy("source", "id").agg(F.array_sort(F.collect_list(F.struct("at", "element"))).alias("s"))
    sequences = materialize(whole.groupBy("source", F.col("s.element").alias("seq")).agg(F.count("*").alias("weight")), "sequences")
    source = sequences.schema["source"].dataType.simpleString()
    level = own.select("source", F.col("element").alias("pattern"), F.col("own").alias("keys"), "support")
    state = sequences.select("source", F.explode(F.array_distinct("seq")).alias("pattern"), "seq", "weight").select("source", "pattern", F.array("pattern").alias("prefix"), "seq", "weight")
    patterns, made = [], None
    while True:
        seen = state.mapInArrow(_project, f"source {source}, pattern bigint, place int, element bigint, weight bigint").groupBy("source", "pattern", "place", "element").agg(F.sum("weight").alias("n"))
        counts = materialize(seen.join(level.select("source", "pattern", "support"), ["source", "pattern"]).where((F.col("n") == F.col("support")) | ((F.col("place") == 0) & (F.col("n") >= min_support))), "counts")
        patterns.append(level.join(counts.where("place != 0").select("source", "pattern").distinct(), ["source", "pattern"], "left_anti"))
        ended = counts.where("place > 0").select("source", "pattern").distinct()
        grown = counts.where("place = 0").join(ended, ["source", "pattern"], "left_anti").select("source", "pattern", "element", F.col("n").alias("support"))
        longer = grown.join(level.select("source", "pattern", "keys"), ["source", "pattern"]).join(own.select("source", "element", "own"), ["source", "element"])
        following = materialize(longer.select("source", F.col("pattern").alias("before"), "element", F.xxhash64("pattern", "element").alias("pattern"), F.concat("keys", "own").alias("keys"), "support"), "patterns")
        if following.isEmpty():
            break
        first_end = lambda seq, prefix: F.aggregate(prefix, F.lit(0), lambda at, e: at + F.array_position(F.slice(seq, at + 1, F.size(seq)), e).cast("int"))
        suffix = F.slice("seq", first_end(F.col("seq"), F.col("prefix")) + 1, F.size("seq"))
        each = state.select("source", F.col("pattern").alias("before"), "prefix", "seq", "weight", F.explode(F.array_distinct(suffix)).alias("element"))
        state = materialize(
            each.join(following.select("source", "before", "element", "pattern"), ["source", "before", "element"]).select("source", "pattern", F.concat("prefix", F.array("element")).alias("prefix"), "seq", "weight"), "projected"
        )
        if made is not None:
            discard(made)
        made, level = state, following.select("source", "pattern", "keys", "support")
    return reduce(DataFrame.unionByName, patterns).select("source", "pattern", F.size("keys").alias("length"), "keys", "support")


def prefix_span(df: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "content", min_support: int = 10) -> DataFrame:
    """(source, pattern, length, keys, support): sequences of lines that follow one another in at least ``min_support`` documents of a source, gaps allowed.

    Lines that aren't frequent leave the sequences first; lines that never occur apart are one element (``_elements``).
    Documents with equal sequences are one row with its weight. The frequent elements are the prefixes of the first level;
    the suffix of each sequence behind the first instance of a prefix is its projected database, and the prefix grows by any
    element that enough of these suffixes hold, however far behind. Growth ends when none does: as many rounds as the
    longest pattern has elements; no length is set.
    A pattern is left out if the same documents all have a further element between two of its elements: the longer pattern,
    of the same support, says more. Where that holds for all that grows from a prefix too (the element stands there in the
    first instance of each, as BIDE's scan backward tells), the prefix isn't grown. So each frequent sequence is given, or
    part of one given with its support. Sub-runs inside an element aren't listed either.
    """
    return _mined(materialize(frequent_lines(df, id_col, source_col, text_col, min_support), "frequent-lines"), min_support)


def repeated_lines(df: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "content", min_support: int = 10) -> DataFrame:
    """(id_col, line_no) of the lines that belong to a frequent sequence of their source, single lines included.

    The sequences are those of ``prefix_span``, grown to their end; each occurrence in the source of a line that one of
    them holds is given. Null texts, ids and sources give no rows, lines that are empty once normalised belong to none,
    rows delivered again count once, a line twice in a document gives two rows and one unit of support.
    """
    frequent = materialize(frequent_lines(df, id_col, source_col, text_col, min_support), "frequent-lines")
    held = _mined(frequent, min_support).select("source", F.explode("keys").alias("key")).distinct()
    found = frequent.join(held, ["source", "key"], "left_semi")
    return found.select(F.col("id").alias(id_col), F.col("line_no")).distinct()


def without_repeated_lines(df: DataFrame, id_col: str = "id", source_col: str = "source_id", text_col: str = "content", min_support: int = 10) -> DataFrame:
    """(id_col, text_col, removed): each document once, its text without the repeated lines, and how many went.

    Texts are shuffled once, by id. A null text stays null with 0 removed; of several rows of an id the greatest text
    counts (they agree but for copies).
    """
    gone = repeated_lines(df, id_col, source_col, text_col, min_support).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(gone, "id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    one = texts.groupBy("id").agg(F.max("text").alias("text"), F.max("gone").alias("gone"))
    return one.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(text_col),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )
