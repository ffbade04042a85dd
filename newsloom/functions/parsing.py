"""Answers of language models as Spark columns: repair, parse, pad. Nothing leaves the JVM.

Common rules: <think> parts go, the text is read as JSON, else the part that looks like JSON is, else a fallback holds;
lists are cut or padded to the expected length. Null answers count as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.functions.text import stripped


def cleaned(answer: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", ""))


def _json(text: Column, schema: str, opening: str, closing: str, lazy: bool = False) -> Column:
    """``text`` as JSON of the schema if it is a value of that shape, else its first part that is; null if neither."""
    part = F.regexp_extract(text, rf"(?s)\{opening}.*{'?' if lazy else ''}\{closing}", 0)

    def read(x: Column) -> Column:
        return F.when(x.startswith(opening) & x.endswith(closing) & F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))

    return F.coalesce(read(text), read(part))


def _sized(items: Column, n: Column, pad: Column) -> Column:
    return F.slice(F.concat(items, F.array_repeat(pad, F.greatest(n, F.lit(0)).cast("int"))), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def strings(answer: Column, n: Column) -> Column:
    """A list of strings, '' where one is missing or nothing can be read."""
    items = _json(cleaned(answer), "array<string>", "[", "]")
    return _sized(F.coalesce(items, F.array().cast("array<string>")), n, F.lit(""))


def tiers(answer: Column, n: Column) -> Column:
    """A list of 1, 2 or 3; anything else is 3. Without a JSON list, the first lone 1, 2 or 3 of each line."""
    text = cleaned(answer)
    whole = F.transform(_json(text, "array<string>", "[", "]"), lambda x: x.try_cast("int"))
    valid = F.transform(whole, lambda v: F.when(v.between(1, 3), v).otherwise(3))
    by_line = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"\b([123])\b", 1).try_cast("int")), lambda v: v.isNotNull())
    return _sized(F.coalesce(valid, by_line), n, F.lit(3))


def labels(answer: Column, n: Column) -> Column:
    """support, partial_support or not_support; without a JSON list by the words of each line; missing ones are not_support."""
    text = cleaned(answer)
    listed = F.transform(_json(text, "array<string>", "[", "]", lazy=True), scoring.label)
    low = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(x)))
    by_line = F.filter(
        F.transform(
            low,
            lambda x: F.when(x.contains("partial"), "partial_support").when(x.contains("support") & ~x.contains("not"), "support").when(x.contains("no"), "not_support"),
        ),
        lambda v: v.isNotNull(),
    )
    return _sized(F.coalesce(listed, by_line), n, F.lit("not_support"))


def verdicts(answer: Column, n: Column) -> Column:
    """confirm or reject; unreadable and missing ones are confirmed."""
    items = F.transform(_json(cleaned(answer), "array<string>", "[", "]"), lambda x: F.when(F.lower(x).contains("confirm"), "confirm").otherwise("reject"))
    return _sized(F.coalesce(items, F.array().cast("array<string>")), n, F.lit("confirm"))


def selected(answer: Column, n: Column) -> Column:
    """The distinct numbers from 1 to n that were chosen, ascending; without a JSON list of numbers, all numbers in the text."""
    text = cleaned(answer)
    listed = F.transform(_json(text, "array<string>", "[", "]"), lambda x: x.try_cast("int"))
    all_numbers = F.exists(listed, lambda v: v.isNull())
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("int"))
    chosen = F.when(F.coalesce(all_numbers, F.lit(True)), found).otherwise(listed)
    return F.array_sort(F.array_distinct(F.filter(chosen, lambda v: v.between(F.lit(1), n))))


_FACT = "array<struct<fact:string,type:string>>"


def facts(answer: Column) -> Column:
    """(fact, type) of a list of objects, code fences aside; objects without a fact go, a missing type is 'unknown'."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"^```(?:json)?", ""), r"```$", "")
    items = F.coalesce(_json(F.trim(text), _FACT, "[", "]"), F.array().cast(_FACT))
    kept = F.filter(items, lambda x: x.isNotNull() & (F.coalesce(x["fact"], F.lit("")) != ""))
    return F.transform(kept, lambda x: F.struct(F.trim(x["fact"]).alias("fact"), F.trim(F.coalesce(x["type"], F.lit("unknown"))).alias("type")))


_CONFLICT = "array<struct<status:string,groups:array<array<int>>,explanation:string>>"


def conflicts(answer: Column, n: Column) -> Column:
    """agree, or contradict with at least two groups; anything else, missing ones included, is null."""
    items = F.transform(
        _json(cleaned(answer), _CONFLICT, "[", "]"),
        lambda x: F.when(x.isNull(), None)
        .when(F.coalesce(x["status"], F.lit("agree")) == "agree", F.struct(F.lit("agree").alias("status"), F.lit(None).cast("array<array<int>>").alias("groups"), F.lit(None).cast("string").alias("explanation")))
        .when((x["status"] == "contradict") & (F.size(x["groups"]) >= 2), F.struct(x["status"].alias("status"), x["groups"].alias("groups"), F.coalesce(x["explanation"], F.lit("")).alias("explanation"))),
    )
    empty = F.array().cast(_CONFLICT)
    return _sized(F.coalesce(items, empty), n, F.lit(None).cast(_CONFLICT[6:-1]))


_THEMES = "struct<themes:array<struct<name:string,facts:array<string>>>>"


def themes(answer: Column, n: Column) -> Column:
    """(name, facts) with facts counted from 0 and within range; themes without a name or facts go; null if none is left."""
    parsed = _json(cleaned(answer), _THEMES, "{", "}")["themes"]
    valid = F.transform(
        parsed,
        lambda x: F.struct(
            F.trim(x["name"]).alias("name"),
            F.filter(F.transform(x["facts"], lambda f: f.try_cast("int") - 1), lambda i: i.isNotNull() & (i >= 0) & (i < n)).alias("facts"),
        ),
    )
    kept = F.filter(valid, lambda x: (F.coalesce(x["name"], F.lit("")) != "") & (F.size(x["facts"]) > 0))
    return F.when(F.size(kept) > 0, kept)


_JUDGE = "struct<factuality:string,neutrality:string,coherence:string,completeness:string>"
CRITERIA = ["factuality", "neutrality", "coherence", "completeness"]


def judge_scores(answer: Column) -> Column:
    """The four criteria from 1 to 5; unreadable ones are 3."""
    parsed = _json(cleaned(answer), _JUDGE, "{", "}")
    return F.struct(*[scoring.clamped(parsed[c]).alias(c) for c in CRITERIA])
