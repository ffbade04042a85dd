"""Problem 1: template residue, filler and error pages where text belongs."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.lines import distinct_support, line_key

# The forms of evidence. All patterns are tried on single lines.
TEMPLATE_MARKS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"[$#]\{[^{}]*\}", r"\{[A-Za-z_][\w.]*\}",
    r"<%[^<>]*%>", r"<!--\s*(?:TODO|FIXME|TBD|insert)\b", r"%%[A-Z_]{2,}%%", r"%[A-Z_]{3,}%",
    r"%\([\w.]+\)[sd]", r"@@[\w.]{2,}@@", r"__[A-Z][A-Z_]+__", r"\[\[[\w. ]+\]\]",
    r"\[(?:INSERT|ADD|ENTER|YOUR|YOUR OWN)\b[A-Z _]*\]", r"\[[A-Z][A-Z _]* TK\]", r"&lt;[A-Za-z_.]{2,}&gt;",
    r"\[object Object\]", r"^\W*\[(?i:headline|title|subtitle|byline|author|name|date|city|location|summary|body|content|text|image|caption|quote|source|link|url|placeholder)(?: here| goes here)?\]\W*$",
]
FILLER_WORDS = (
    "adipiscing aliqua aliquam amet ante arcu augue consectetur consequat cras curabitur dapibus dictum dolor dolore donec"
    " eget eiusmod elit enim erat eros est euismod facilisis felis fermentum fusce gravida iaculis incididunt integer"
    " ipsum justo labore lacinia lacus laoreet lectus leo libero ligula lorem luctus maecenas magna massa mattis mauris"
    " metus morbi neque nibh nisi nisl nulla nunc odio orci pellentesque porta porttitor pretium proin pulvinar purus quam"
    " quis risus rutrum sagittis sapien sed sem sit sodales sollicitudin suscipit tellus tempor tempus tincidunt tortor"
    " turpis ullamcorper ultrices urna ut vehicula vel velit vestibulum vitae vivamus viverra volutpat vulputate varius"
).split()
STAND_INS = [
    r"(?:your|summary|text|content|headline|article|story|body|copy|caption|description|title)(?: \w+)? goes here",
    r"test test test", r"dummy (?:story|text|copy|article|content)", r"(?:paragraph|text|copy)\b.{0,40} for layout only",
    r"this is (?:a|only a) (?:test|placeholder|dummy)\b(?: (?:story|text|article|post|page))?\W*$", r"placeholder (?:text|copy|article|content)",
]
WHOLE_VALUES = (
    r"null|nan|undefined|none|nil|todo|tbd|tk|tktk|n/?a|xxx+|test|asdf\w*|placeholder|untitled|lorem ipsum\b.*"
    r"|\[(?:insert|add|enter|your)\b[^\]]*\]|%\w+%|summary|summary here|(?:add|enter|insert) (?:summary|text|content) here"
)
ERROR_FORMS = [
    r"(?:40\d|41\d|50\d)(?: error)?\W{1,3}(?:page )?not found", r"^\W*(?:error )?(?:40\d|50\d)\b\W*(?:error|forbidden|not found|bad request)?\W*$",
    r"\bpage not found\b", r"\bpage \S+ could not be (?:located|found)", r"\bcan(?:'|’|no)t find what you are looking for",
    r"(?:^|\W)access denied\b", r"you don(?:'|’)t have permission to (?:view|access)", r"^\W*(?:403 )?forbidden\W*$",
    r"\bservice (?:temporarily )?unavailable\b", r"\binternal server error\b", r"\bbad gateway\b", r"\bgateway time-?out\b",
    r"\berror establishing a database connection", r"\bfatal error: uncaught", r"\bsomething went wrong while\b",
    r"\btoo many requests\b", r"\baddress has been rate limited\b", r"\byour session (?:for \S+ )?has expired\b",
    r"\bnot available in your (?:region|country)\b", r"\bchecking your browser before\b", r"\bwhile we verify your browser\b",
    r"^\W*o+ps\b.*\b(?:went wrong|error|not found|problem)\b", r"^\W*something went wrong\W*(?:$|(?:please )?(?:try|reload|refresh)\b)",
    r"\b(?:page|url|address|document) (?:that )?you (?:requested|are looking for|were looking for|tried to (?:reach|open)) (?:does not|doesn(?:'|’)t|no longer) exists?\b",
    r"\bthis page (?:does not exist|doesn(?:'|’)t exist|no longer exists|is (?:no longer|not) available|isn(?:'|’)t available)\b", r"\bthis site can(?:'|’|no)t be reached\b",
    r"\bverify (?:that )?you are (?:a )?human\b", r"^\W*just a moment\W*$", r"\bdown for maintenance\b", r"^\W*please wait\W*(?:$|while\b)",
]
SCRIPT_DEMANDS = [
    r"\benable (?:java)?scripts?\b", r"\bjavascript is (?:disabled|required|off)", r"\bturn on (?:java)?scripts?\b", r"\bnoscript\b",
    r"\bscripts switched off\b", r"\brequires? (?:cookies|javascript|scripting)\b", r"\b(?:enable|accept|allow) cookies to\b",
    r"\bcookies are (?:disabled|required)\b", r"\baktivieren sie (?:javascript|cookies)\b", r"\bactiver (?:javascript|les cookies)\b",
    r"\bactiv[ae]r? (?:javascript|las cookies)\b", r"\bbrowser is not supported\b", r"\bunsupported browser\b",
]
#: A line that reads as text: five words or more and the end of a sentence.
SENTENCE = r"""(?s)^(?:\S+\s+){4,}\S+.*[.!?]["'”’)]*\s*$"""
_MARK_HINT = r"[{}%@_\[\]]|<[!%]|&lt;"
#: A quotation: what it holds is reported, not shown.
_QUOTED = r"""["“][^"“”]{1,60}["”](?= |,|\.|$)"""


def needed(pattern: str) -> set[str] | None:
    """Literals, in lower case, one of which every match of ``pattern`` holds; None if there is no such set."""

    def of(items) -> set[str] | None:
        found: list[set[str]] = []
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                found.append({run})
                run = ""
            inner: list | None = None
            if op is sre.SUBPATTERN:
                inner = [arg[3]]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                inner = [arg[2]]
            elif op is sre.BRANCH:
                inner = arg[1]
            if inner:
                sets = [of(x) for x in inner]
                if all(sets):
                    found.append(set().union(*sets))
        return max(found, key=lambda x: min(map(len, x)), default=None)

    return of(sre_parser.parse(pattern))


def hints(patterns: list[str], least: int = 4) -> tuple[list[str], list[str]]:
    """(literals, patterns without): every match of the other patterns holds one of the literals, none of which is shorter than ``least``.

    The literals come from the patterns themselves, so no line that a pattern matches is skipped.
    """
    sets = {p: needed(p) for p in patterns}
    guarded = {p: x for p, x in sets.items() if x and min(map(len, x)) >= least}
    every = set().union(*guarded.values())
    return sorted(x for x in every if not any(y != x and y in x for y in every)), [p for p in patterns if p not in guarded]


_LITERALS, _UNGUARDED = hints(SCRIPT_DEMANDS + ERROR_FORMS + STAND_INS)


def _any(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def _contains_any(text: Column, literals: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in literals])


def _by_initial(words: list[str]) -> str:
    """An alternation of words grouped by their first letter, so that most words of a text fail on one character."""
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words}))


def _hinted(line: Column) -> Column:
    """Whether a line, quotations taken out, can match SCRIPT_DEMANDS, ERROR_FORMS or STAND_INS at all."""
    held = F.get(F.transform(F.array(F.lower(line)), lambda low: _contains_any(low, _LITERALS)), F.lit(0))
    return held | line.rlike(_any(_UNGUARDED))


def evidence(line: Column) -> Column:
    """'template', 'filler', 'error' or 'script' for a line that shows it, else null."""
    filler = r"(?i)(?:(?<![\w])(?:" + _by_initial(FILLER_WORDS) + r")(?![\w])[\s,.;:]*){4}"
    bare = F.when(line.contains('"') | line.contains("“"), F.regexp_replace(line, _QUOTED, " ")).otherwise(line)

    def phrases(x: Column) -> Column:
        return F.when(_hinted(x), F.when(x.rlike(_any(SCRIPT_DEMANDS)), "script").when(x.rlike(_any(ERROR_FORMS)), "error").when(x.rlike(_any(STAND_INS)), "filler"))

    # a lambda's variable is computed once, however often it is named
    by_phrase = F.get(F.transform(F.array(bare), phrases), F.lit(0))
    return F.when(line.rlike(_MARK_HINT) & line.rlike("|".join(TEMPLATE_MARKS)), "template").when(line.rlike(filler), "filler").otherwise(by_phrase)


def values_of(df: DataFrame, id_col: str, fields: list[str], *keep: Column) -> DataFrame:
    """(id, keep..., field_name, value), one row per non-blank value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), df[f].alias("value")) for f in fields])
    return (
        df.select(df[id_col].alias("id"), *keep, F.explode(pairs).alias("p"))
        .select("*", "p.field_name", "p.value")
        .drop("p")
        .where("id is not null and value is not null and trim(value) != ''")
    )


def residue(
    df: DataFrame, id_col: str = "id", url_col: str = "url", fields: tuple[str, ...] = ("content", "summary"), min_support: int = 10
) -> DataFrame:
    """(id_col, field_name, evidence), one row per affected value.

    Normalised lines are counted by host over all values; lines that at least ``min_support`` articles of the host share
    are recurrent: boilerplate, which leaves the value, if what remains holds a sentence of its own. Where nothing but
    recurrent lines, ids and the like remain the value is such a page itself and keeps them. Lines with a template mark or
    filler stay in any case (a broken template recurs by nature). A value is affected if a line of what remains shows a template mark never filled in, filler, an error, block or waiting page, or a demand for
    scripts or cookies; several kinds give the first in this order: template, filler, error, script. Messages in short
    quotation marks are reported speech and don't count, template marks do.

    Null and blank values are never affected; an unreadable or null URL counts as the host ''; rows delivered again give
    one row; null ids are left out; other columns are ignored. Only line hashes are shuffled, pre-aggregated; the text of
    a line never leaves its task.
    """
    host = F.coalesce(F.try_parse_url(df[url_col], F.lit("HOST")), F.lit("")).alias("host")
    whole = F.lower(F.trim(F.col("value"))).rlike(f"^(?:{WHOLE_VALUES})$")
    lines = F.filter(F.split("value", "\n", -1), lambda x: F.trim(x) != "")
    values = values_of(df, id_col, list(fields), host).select("id", "host", "field_name", lines.alias("lines"), whole.alias("whole"))
    line = values.select("id", "host", "field_name", "whole", "lines", F.explode("lines").alias("line"))
    support = distinct_support(line.select("host", F.xxhash64(line_key(F.col("line"))).alias("key"), "id"), ["host", "key"], "id").where(F.col("support") >= min_support)
    shown = (
        line.withColumn("evidence", F.when(F.col("whole"), "filler").otherwise(evidence(F.col("line"))))
        .where("evidence is not null")
        .select(
            "id", "host", "field_name", "evidence", F.xxhash64(line_key(F.col("line"))).alias("key"),
            F.transform("lines", lambda x: F.struct(F.xxhash64(line_key(x)).alias("key"), x.rlike(SENTENCE).alias("sentence"))).alias("keys"),
        )
    )
    # of each line of a value with evidence: is it recurrent? A sentence that isn't, and not the evident line, makes the rest boilerplate
    parts = (
        shown.select("id", "host", "field_name", "evidence", F.col("key").alias("evident"), F.inline("keys"))
        .distinct()
        .join(support, ["host", "key"], "left")
        .withColumn("recurrent", F.col("support").isNotNull())
    )
    rank = F.array_position(F.array(*map(F.lit, ("template", "filler", "error", "script"))), F.col("evidence"))
    return (
        parts.groupBy("id", "field_name")
        .agg(
            F.bool_or((F.col("key") == F.col("evident")) & (~F.col("recurrent") | F.col("evidence").isin("template", "filler"))).alias("remains"),
            F.bool_or(F.col("sentence") & ~F.col("recurrent") & (F.col("key") != F.col("evident"))).alias("own_text"),
            F.min_by("evidence", rank).alias("evidence"),
        )
        .where("remains or not own_text")
        .select(F.col("id").alias(id_col), "field_name", "evidence")
    )
