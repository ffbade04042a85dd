"""Problem 6: values cut by field limits or in transfer, and how often each source cuts."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.lines import distinct_support, line_key
from newsloom.llm.residue import WHOLE_VALUES, evidence, values_of
from newsloom.runtime import materialize

#: What a cut leaves at the end, beside a bare stop.
MARKS = r"(?:\[(?:…|\.\.\.)\]|…|\.\.\.|\[\+\d+ chars?\]|\(|<[/!]?\w{0,12}|&#?\w{0,8}|�+|\\(?:u[0-9A-Fa-f]{0,4})?)\s*$"
CLOSED = r"[.!?]['\"”’»)\]]*$"
_SENTENCE_BREAK = r"(?<=[.!?]|[.!?]['\"”’»)\]])\s+(?=['\"“‘«(]?[\p{Lu}\d])"
#: Function words of the sentence skeleton; all other words count by class.
FUNCTION_WORDS = frozenset(
    "a about according after against all an and are as asked at be because been before by could did for from had has have in into is it its"
    " less may might more must neither no none nor not of off on once or our over said say says shall should so than that the their then these"
    " they this those through to told under until was were what when where which while who whose why will with would".split()
)
SKELETON = 6
_break = re.compile(r"(?<=[.!?])['\"”’»)\]]*\s+(?=['\"“‘«(]?[A-ZÀ-ÞŠŽ0-9])")
_closed = re.compile(CLOSED)
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,]*")


def skeleton(sentence: str, skip_last: bool, length: int = SKELETON) -> str:
    """The first words of a sentence: function words as they are, others by class (number, capital, -ed, -ing, -s, other)."""
    out = []
    words = _word.findall(sentence) if skip_last else _word.findall(sentence[:400])
    for i, w in enumerate(words[:-1] if skip_last else words):
        if i == length:
            break
        low = w.lower()
        if low in FUNCTION_WORDS:
            out.append(low)
        elif w[0].isdigit():
            out.append("9")
        elif w[0].isupper():
            out.append("C")
        else:
            out.append("D" if low.endswith("ed") else "G" if low.endswith("ing") else "S" if low.endswith("s") else "w")
    return " ".join(out)


def _count_openings(batches):
    """Skeleton prefixes of complete sentences, counted per batch."""
    for b in batches:
        seen: Counter[str] = Counter()
        for value in b.column(0).to_pylist():
            for line in value.split("\n"):
                for sentence in _break.split(line.strip()):
                    if _closed.search(sentence):
                        parts = skeleton(sentence, True).split(" ")
                        for n in range(1, len(parts) + 1) if parts[0] else ():
                            seen[" ".join(parts[:n])] += 1
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["opening", "n"])


@F.pandas_udf(T.StringType())
def _opening(units: pd.Series) -> pd.Series:
    return units.map(lambda u: skeleton(u, True), na_action="ignore")


def measures(value: Column) -> Column:
    """Lengths of a text as different stores count it."""

    def times(pattern: str) -> Column:
        return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))

    def literal(ch: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(ch), F.lit("")))

    length, feeds, returns, quotes = F.length(value), literal("\n"), literal("\r"), literal('"')
    beyond = F.octet_length(value) != length
    non_ascii = F.when(beyond, times(r"[^\x00-\x7f]")).otherwise(0)
    entities = 4 * literal("&") + 3 * (literal("<") + literal(">"))
    counted = {
        "characters": length,
        "bytes": F.octet_length(value),
        "utf16": length + F.when(beyond, times(r"[\x{10000}-\x{10ffff}]")).otherwise(0),
        "lf": length - returns,
        "crlf": length - returns + feeds,
        "entities": length + entities,
        "entities_quotes": length + entities + 5 * quotes + 4 * literal("'"),
        "json": length + quotes + literal("\\") + feeds + returns,
        "json_ascii": length + quotes + literal("\\") + feeds + returns + 5 * non_ascii,
    }
    return F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("size")) for k, v in counted.items()])


def hidden_limits(texts: DataFrame, min_values: int = 5, factor: float = 2.0, deviations: float = 5.0) -> DataFrame:
    """(source, field_name, measure, size, values): sizes at which the texts of a source pile up, however they end.

    ``texts`` is (source, field_name, sizes), one row per distinct text. A size counts if at least ``min_values`` texts
    have it, ``factor`` times as many as around it and more than ``deviations`` standard deviations of what lies around,
    the mean of the ten sizes on either side but its direct neighbours (a cut that is trimmed falls just short). So the
    bar follows the counts. What is grouped is bounded by the lengths texts can have, not by their number.
    """
    at = ["source", "field_name", "measure", "size"]
    sizes = texts.select("source", "field_name", F.inline("sizes")).groupBy(*at).agg(F.count("*").alias("values"))
    by_size = Window.partitionBy("source", "field_name", "measure").orderBy("size")
    within = lambda i: F.sum("values").over(by_size.rangeBetween(-i, i))
    # no join: Spark would size a broadcast by the compressed file, a small part of what its rows take on the driver
    around = sizes.withColumn("usual", (within(10) - within(1)) / 18)
    usual = F.col("usual")
    spikes = around.where((F.col("values") >= min_values) & (F.col("values") >= factor * usual) & (F.col("values") >= usual + deviations * F.sqrt(usual + 1) - deviations))
    return spikes.select(*at, "values")


class Truncation:
    """found: (id, field_name); limits: hidden_limits and how many of the texts at each are cut by their endings; values: (source, field_name, values)."""

    def __init__(self, found: DataFrame, limits: DataFrame, values: DataFrame):
        self.found, self.limits, self.values = found, limits, values


def truncation(df: DataFrame, id_col: str = "id", source_col: str = "source_id", fields: tuple[str, ...] = ("content", "summary"), min_recurrent: int = 10, closed_share: float = 3.0) -> Truncation:
    """Values that stop inside a word or sentence.

    1. The length of every value is taken as stored and as counted in bytes, UTF-16, with line ends converted, entities or
       JSON escaped, and for marked values also without the mark. Grouped by source and field, the sizes at which
       distinct texts pile up against what lies around them are its hidden limits, whatever their endings.
    2. Endings are inspected. A value is cut if it ends openly and
       (a) a mark of a cut stands at its end (ellipsis, opened bracket or tag, broken entity, character or escape), or
       (b) its size is one of the limits of its source, or up to two below it (a trimmed cut), provided that at least
           half of the texts of that size are cut by (a), (c) or (d): texts of one size may be near-copies, or
       (c) its last line goes on after a complete sentence, or
       (d) its last line opens as complete, longer sentences of the corpus do, at least ``closed_share`` times as many as
           there are openly ending lines with this opening, itself included: headlines, credits and notices, which are
           complete without a full stop, end openly as a rule. Both sides of this comparison grow with the data.
    An unmarked last line that at least ``min_recurrent`` distinct texts of its source share is no cut: a notice ends
    them, at a limit by chance too, while copies of one text count once. A mark is evidence by itself. Messages and filler
    (problem 1) are no cuts. Copies count once where sizes vote for limits and where open lines are weighed.
    Null and blank values are complete; null ids and sources are left out; rows delivered again count once.
    """
    source = df[source_col].alias("source")
    values = values_of(df, id_col, list(fields), source).where("source is not null").withColumn("value", F.rtrim(F.col("value"), F.lit(" \t\r\n\u00a0")))
    tail = F.element_at(F.split("value", "\n", -1), -1)
    mark = F.regexp_extract(F.substring("value", -40, 40), MARKS, 0)
    is_open = ((F.col("mark") != "") | ~F.substring("value", -12, 12).rlike(CLOSED)) & ~F.lower(F.trim(F.col("value"))).rlike(f"^(?:{WHOLE_VALUES})$")
    if_open = lambda c: F.when(F.col("open"), c)
    ends = materialize(
        values.withColumn("mark", mark)
        .withColumn("open", is_open)
        .withColumn("line", if_open(F.trim(tail)))
        .withColumn("base", F.when(F.col("mark") != "", F.expr("substring(value, 1, length(value) - length(mark))")))
        .withColumn("units", if_open(F.split("line", _SENTENCE_BREAK)))
        .select(
            "source", "id", "field_name", "open", F.xxhash64("value").alias("text"), (F.col("mark") != "").alias("marked"), if_open(F.xxhash64(line_key(F.col("line")))).alias("key"), if_open(F.element_at("units", -1)).alias("unit"),
            if_open(F.size("units") > 1).alias("follows"), if_open(evidence(F.col("line"))).alias("evidence"),
            F.when(F.col("base").isNull(), measures(F.col("value"))).otherwise(F.array_distinct(F.concat(measures(F.col("value")), measures(F.col("base"))))).alias("sizes"),
        ),
        "endings",
    )
    lengths = ends.groupBy("source", "field_name", "text").agg(F.first("sizes").alias("sizes"))
    piles = materialize(hidden_limits(lengths), "piles")

    # each text stands for its least article, so neither copies nor two fields of one article count twice
    keys = F.transform(F.split("value", "\n", -1), line_key)
    lines = values.select("source", "id", keys.alias("keys")).select("source", "id", F.xxhash64("keys").alias("text"), F.explode("keys").alias("k")).where("k != ''")
    once = lines.groupBy("source", F.xxhash64("k").alias("key"), "text").agg(F.min("id").alias("id"))
    recurrent = distinct_support(once, ["source", "key"], "id").where(F.col("support") >= min_recurrent).select("source", "key", F.lit(True).alias("recurs"))
    openings = values.select("value").mapInArrow(_count_openings, "opening string, n bigint").groupBy("opening").agg(F.sum("n").alias("n")).where(F.col("n") >= closed_share)
    news, own = F.col("evidence").isNull(), ~F.col("recurs")
    usual = F.coalesce("usual", F.lit(False)) & F.col("unit").rlike(r"^['\"\u201c\u2018(]?[\p{Lu}\d]")
    known = ends.where("open").withColumn("opening", _opening("unit")).join(recurrent, ["source", "key"], "left")
    opened = materialize(known.withColumn("recurs", F.coalesce("recurs", F.lit(False))), "open-lines")
    as_open = opened.where("not marked and not follows and not recurs").select("opening", "source", "key").distinct().groupBy("opening").agg(F.count("*").alias("n_open"))
    closing = openings.join(as_open, "opening", "left").where(F.col("n") >= closed_share * F.coalesce("n_open", F.lit(0)))
    inspected = materialize(
        opened.join(closing.select("opening", F.lit(True).alias("usual")), "opening", "left")
        .withColumn("ends_open", (news & (F.col("marked") | (F.col("follows") & own))) | ((news | (F.col("evidence") == "template")) & (F.col("marked") | (usual & own))))
        .select("source", "id", "field_name", "text", "sizes", "recurs", (news | (F.col("evidence") == "template")).alias("text_proper"), "ends_open"),
        "open-endings",
    )
    at = ["source", "field_name", "measure", "size"]
    by_ending = inspected.where("ends_open").dropDuplicates(["source", "field_name", "text"]).select("source", "field_name", F.inline("sizes")).join(piles.select(*at).hint("merge"), at).groupBy(*at).agg(F.count("*").alias("cut"))
    limits = materialize(piles.join(by_ending, at, "left").withColumn("cut", F.coalesce("cut", F.lit(0))), "limits")
    hit = (
        inspected.where("not ends_open and not recurs and text_proper")
        .select("source", "id", "field_name", F.inline("sizes"))
        .withColumnRenamed("size", "exact")
        .withColumn("size", F.explode(F.sequence(F.col("exact"), F.col("exact") + 2)))
        .join(limits.where("2 * cut >= values").select(*at).hint("merge"), at, "left_semi")
        .select("id", "field_name")
    )
    found = inspected.where("ends_open").select("id", "field_name").unionByName(hit).distinct().withColumnRenamed("id", id_col)
    counted = ends.select("source", "field_name", "id").distinct().groupBy("source", "field_name").agg(F.count("*").alias("values"))
    return Truncation(found, limits, counted)
