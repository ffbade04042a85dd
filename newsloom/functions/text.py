"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# By-line patterns of wire services and hosts that are wire services themselves.
WIRE_NAMES = [
    "Associated Press", "AP", "Reuters", "AFP", "Agence France[- ]Presse", "United Press International", "UPI", "Canadian Press",
    "The Canadian Press", "Press Association", "Press Trust of India", "PTI", "IANS", "ANI", "dpa",
]
WIRE_HOSTS = ["apnews.com", "reuters.com", "afp.com", "upi.com"]
WIRE_PATTERN = "(?iU)" + "|".join(rf"\b{n}\b" for n in WIRE_NAMES)


#: All white space of Unicode.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def is_wire_copy(author: Column, host: Column) -> Column:
    """By-line of a wire service on a host that isn't one itself; null or empty authors never."""
    return F.coalesce(author.rlike(WIRE_PATTERN), F.lit(False)) & ~F.coalesce(F.lower(host).isin(WIRE_HOSTS), F.lit(False))


def wire_service(author: Column) -> Column:
    """The first wire service named in a by-line, in lower case; null if none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(author, WIRE_PATTERN, 0))), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9']+)"), 1)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; linear, whatever runs of blanks a text holds."""
    return F.trim(text, F.lit(WHITE_SPACE))


def word_count(text: Column) -> Column:
    """Number of runs without white space (of any kind)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def word_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` tokens; empty where there are fewer."""
    t = tokens(text)
    return F.when(F.size(t) < k, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " ")))
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets: 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def sentences(text: Column, min_words: int = 5) -> Column:
    """Sentences that end in . ! or ? before a capital or quotation mark, trimmed, with at least ``min_words`` words."""
    parts = F.transform(F.split(stripped(text), r'(?U)(?<=[.!?])\s+(?=[A-Z"“])'), stripped)
    return F.filter(parts, lambda s: word_count(s) >= min_words)


def statute_sentences(text: Column) -> Column:
    """Sentences of legal text: titles before names and U.S. don't end one."""
    hidden = F.regexp_replace(F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Jr|Sr|Rep|Sen|Gov)\.", "$1\u0001"), r"\bU\.S\.(C\.)?", "U\u0001S\u0001$1")
    hidden = F.regexp_replace(hidden, "U\u0001S\u0001C\\.", "U\u0001S\u0001C\u0001")
    return F.transform(F.split(hidden, r"(?<=[.!?])\s+"), lambda s: F.translate(s, "\u0001", "."))


# Words that tell the kind of a legal sentence, in order of precedence; parts of words count.
STATUTE_KINDS = {
    "amendment": "amend|strike|insert|delete|redesignate",
    "appropriation": "appropriate|authoriz|million|billion|fund",
    "definition": "define|means|referred to as",
    "requirement": "require|shall|must|prohibit|mandate",
    "effective_date": "effective|take effect|enact|upon enactment",
}


def statute_kind(sentence: Column) -> Column:
    kind = F.lit("provision")
    for name, words in reversed(STATUTE_KINDS.items()):
        kind = F.when(F.lower(sentence).rlike(words), name).otherwise(kind)
    return kind


def slugify(text: Column, length: int) -> Column:
    """Lower case, words joined by hyphens, other characters dropped, at most ``length`` characters."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", ""), 1, length)


def source_name(host: Column) -> Column:
    """A display name from a host: its first label, each run of letters capitalised."""
    runs = F.split(F.split_part(host, F.lit("."), F.lit(1)), r"(?<=\P{L})")
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000)))), "")


def names_joined(names: Column, length: int = 300) -> Column:
    return F.substring(F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", "), 1, length)


def localized(by_language: Column, language: str = "eng") -> Column:
    """The text in a language of a map, else the first there is, else ''."""
    return F.coalesce(F.try_element_at(by_language, F.lit(language)), F.try_element_at(F.map_values(by_language), F.lit(1)), F.lit(""))


def parsed_time(text: Column) -> Column:
    """A timestamp, UTC where the text names no zone; null if it can't be read."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


# Numbers as words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def numbers_as_digits(text: Column) -> Column:
    out = F.replace(F.lower(text), F.lit(" - "), F.lit("-"))
    for n, word in enumerate(NUMBER_WORDS):
        out = F.regexp_replace(out, rf"\b{word}\b", str(n))
    return out


def shortened_prompt(text: Column, limit: int = 12_000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[TRUNCATED]"))).otherwise(text)


def render(template: str, text: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), text)


def date_reference(today: Column, before: int = 7, days: int = 21) -> Column:
    """One line a day, 'Weekday = Month dd, yyyy', today marked."""
    each = F.transform(
        F.sequence(F.date_sub(today, before), F.date_add(today, days - before - 1)),
        lambda x: F.concat(F.date_format(x, "EEEE = MMMM dd, yyyy"), F.when(x == today, " (today)").otherwise("")),
    )
    return F.array_join(each, "\n")


def percent(x: Column, digits: int = 0) -> Column:
    """A share as per cent, halves to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))


def hours_minutes(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")
