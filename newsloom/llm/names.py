"""Problem 5: variant spellings of names typed by people, linked by a sharded trie join."""

from __future__ import annotations

import re
import unicodedata
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import connected_components
from newsloom.runtime import materialize

# General by-lines, titles, roles, words of organisations, nicknames.
GENERAL = frozenset(
    "staff|staff writer|staff writers|staff reporter|staff reporters|anonymous|anon|newsroom|news desk|newsdesk|editorial board|editorial team|editorial staff|the editors"
    "|editors|editor|admin|administrator|contributor|contributors|guest|guest writer|guest contributor|correspondent|correspondents|our correspondent|special correspondent|reporter"
    "|reporters|agencies|wire reports|wire services|web desk|online desk|unknown|none|null|nan|n a|na|author|by|various|various authors|multiple authors|team|desk".split("|")
)
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame rev reverend hon capt col gen lt sgt".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq".split())
ROLES = frozenset("staff writer reporter correspondent editor columnist contributor photographer producer analyst journalist intern".split())
ORGANISATION = {
    "agency": "agency", "agcy": "agency", "association": "association", "assoc": "association", "assn": "association", "institute": "institute",
    "inst": "institute", "company": "company", "co": "company", "cooperative": "cooperative", "coop": "cooperative", "service": "service", "svc": "service",
    "services": "services", "svcs": "services", "corporation": "corporation", "corp": "corporation", "news": "news", "media": "media", "press": "press",
    "wire": "wire", "data": "data", "broadcasting": "broadcasting", "bcasting": "broadcasting", "network": "network", "group": "group", "bureau": "bureau",
    "syndicate": "syndicate", "foundation": "foundation", "university": "university", "univ": "university", "department": "department", "dept": "department",
}
LEGAL = frozenset("ltd limited inc incorporated llc plc gmbh the".split())
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex sandy sasha xander alec al", "amara": "mara", "anthony": "tony ant", "benjamin": "ben benny benji benjy",
    "catherine": "cathy kate katie", "charles": "charlie chuck chas", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betsy betty eliza libby lisa",
    "frederick": "fred freddie freddy", "gabriella": "gabby gabi ella", "george": "georgie", "gregory": "greg gregg", "harold": "harry hal",
    "henry": "hank harry", "hugo": "hugh", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny", "jonathan": "jon jonny johnny nathan",
    "joseph": "joe joey", "katherine": "kate kathy katie kat kit kitty", "lawrence": "larry laurie lawrie", "leonard": "len lenny leo", "lucia": "lucy lu", "margaret": "maggie meg peggy greta marge madge daisy",
    "mateo": "matt teo", "matthew": "matt", "michael": "mike mick mickey mikey", "nicholas": "nick nicky nico", "patricia": "pat patty patti trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philippa": "pippa pip", "philip": "phil", "rebecca": "becky becca", "renee": "ren", "richard": "rick dick rich ricky richie", "robert": "rob bob bobby robbie bert",
    "ronald": "ron ronnie", "rosalind": "roz ros rosie lindy rosa", "samantha": "sam sammy", "samuel": "sam sammy", "sarah": "sally", "stephen": "steve", "steven": "steve", "susan": "sue susie suzie",
    "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "ursula": "ursie", "victoria": "vicky vicki tori vic", "viktor": "vic vik", "walter": "walt wally", "wanda": "wendy",
    "william": "will bill billy willie liam", "yusuf": "joe", "zachary": "zach zack zac", "zoe": "zo",
}
_FORMAL: dict[str, list[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, []).append(_name)
_FOLDS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th", "’": "'"})
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def fold(text: str) -> str:
    """Lower case without diacritics."""
    low = unicodedata.normalize("NFKD", text).lower()
    return "".join(c for c in low if not unicodedata.combining(c)).translate(_FOLDS)


def _capital(word: str) -> bool:
    return word[:1].isupper()


def _organisation(words: list[str], inside: list[str]) -> tuple[str, list[str]] | None:
    """('o', keys) of an organisation: its full form, and its core with the initials of its general words."""
    plain = [ORGANISATION.get(w.replace("-", ""), w) for w in words if w not in LEGAL]
    general = set(ORGANISATION.values())
    if inside:  # "General Words (Core)" or "ACRONYM (Core)"
        core = [w for w in inside if w not in LEGAL]
        if len(core) == 1 and len(plain) == 1 and plain[0] not in general:
            short = plain[0]
            if not short.startswith(core[0][:2]) or not 3 <= len(short) <= 6:
                return None
            return "o", [f"#{core[0]} {short[2:]}"]
        plain = core + plain
    if len(plain) < 2 or not any(w in general for w in plain):
        return None
    return "o", [" ".join(plain), f"#{plain[0]} {''.join(w[0] for w in plain[1:])}"]


def keys_of(author: str | None) -> tuple[str, list[str], str] | None:
    """The kind of a by-line, the keys under which it may meet others, the main one first, and its middle name or initial ('' if none); None if it names nobody or several.

    Kinds: 'o' organisation, 'p' person with a given name, 'i' person with initials only, 's' a single word.
    """
    if not author or not author.strip():
        return None
    text = " ".join(unicodedata.normalize("NFKC", author).split())
    text = re.sub(r"^(?:by|from|text|words)[: ]+", "", text, flags=re.I)
    text = re.split(r" \| | / | // | - | – | — ", text)[0].strip(" .,;:|-")
    if fold(re.sub(r"[^\w ]+", " ", text)).strip() in GENERAL or not text:
        return None
    bracket = re.fullmatch(r"(.*?)\s*\(([^()]*)\)", text)
    outer, inside = (bracket.group(1), _WORD.findall(fold(bracket.group(2)))) if bracket else (text, [])
    as_org = _organisation(_WORD.findall(fold(outer)), inside)
    if as_org and not re.search(r",| & | and ", outer):
        return *as_org, ""
    if bracket:
        text = outer
    if re.search(r"\s(?:and|&|with|und|et|y)\s|;|&", text, flags=re.I):
        return None
    text = re.sub(r"\s(?:in|from|at|for|of)\s+[\w' .-]+$", "", text)
    parts = [p.strip() for p in text.split(",") if p.strip()]
    head = _WORD.findall(parts[0])
    for p in parts[1:]:
        ws = _WORD.findall(p)
        if not ws or not _capital(ws[0]) or fold(ws[-1]) in ROLES or fold(ws[0]) in SUFFIXES:
            continue  # a role, an occupation or a suffix
        if len([w for w in head if fold(w) not in TITLES]) == 1 and len(parts) == 2:
            head = ws + head  # family name first
        elif len(ws) > 1 or len(parts) > 2:
            return None  # several people
        else:
            return None
    while len(head) > 1 and fold(head[-1]) in ROLES | SUFFIXES:
        head = head[:-1]
    words = [w for w in head if fold(w) not in TITLES]
    words = [w for w in words if fold(w) not in SUFFIXES] or words
    if not words or fold(" ".join(words)) in GENERAL:
        return None
    if len(words) > 1 and len(words[0]) > 2 and words[0].isupper() and not words[-1].isupper():
        words = words[1:] + words[:1]  # FAMILY Given
    low = [fold(w) for w in words]
    if len(low) == 1:
        return "s", low, ""
    given, family, middle = low[0], low[-1], low[1] if len(low) > 2 else ""
    if len(family) == 1:  # "Family G"
        given, family = family, given
    if len(given) == 1:
        return "i", [f"{given} {family}"], middle
    return "p", [f"{given} {family}", *(f"{formal} {family}" for formal in _FORMAL.get(given, ()))], middle


def segments(size: int, pieces: int = 3) -> list[tuple[int, int]]:
    """Cuts of a string of ``size`` characters; one edit, a transposition included, leaves at least one piece whole."""
    cuts = [size * i // pieces for i in range(pieces + 1)]
    return list(zip(cuts, cuts[1:]))


def shards_of(key: str, index: bool) -> set[str]:
    """Shards in which a key is stored (index), or in which a neighbour within one edit may be stored.

    A neighbour of another length is shifted behind the edit: a whole piece lies where it does in the neighbour if the
    edit is behind it, moved by the difference if it is before; the first piece has nothing before, the last nothing behind.
    """
    out = set()
    for size in (len(key),) if index else range(len(key) - 1, len(key) + 2):
        cuts = segments(size)
        for n, (i, j) in enumerate(cuts):
            moved = len(key) - size
            for shift in {0 if n < len(cuts) - 1 else moved, moved if n > 0 else 0}:
                if 0 <= i + shift < j + shift <= len(key):
                    out.add(f"{n}:{size}:{key[i + shift : j + shift]}")
    return out


class Trie:
    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, value: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def near(self, word: str, bound: int = 1):
        """Values of all words within ``bound`` insertions, deletions, substitutions or swaps of neighbours.

        The states of the Levenshtein automaton of ``word`` are carried down the trie, a row of distances for each node;
        a branch ends where no state is left within the bound.
        """
        first = list(range(len(word) + 1))
        todo = [(child, c, first, None, "") for c, child in self.root.items() if c]
        while todo:
            node, c, above, before, last = todo.pop()
            row = [above[0] + 1]
            for j, w in enumerate(word, 1):
                d = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (w != c))
                if before is not None and j > 1 and c == word[j - 2] and last == w:
                    d = min(d, before[j - 2] + 1)
                row.append(d)
            if row[-1] <= bound and "" in node:
                yield from node[""]
            if min(row) <= bound or (above and min(above) <= bound - 1):
                todo += [(child, x, row, above, c) for x, child in node.items() if x]


def gentle(a: str, b: str) -> bool:
    """Whether short names one edit apart may be one: a doubled letter or a swap of neighbours, never another letter ('Bo Li' and 'Bo Lii', not 'Bo Xu' and 'Bo Yu')."""
    if len(a) == len(b):
        return a != b and sorted(a) == sorted(b)
    shorter, longer = sorted((a, b), key=len)
    return any(longer[i] == longer[i - 1] and longer[:i] + longer[i + 1 :] == shorter for i in range(1, len(longer)))


SHORT = 6


def _in_shards(frames):
    """Pairs of neighbours inside each shard; the shards arrive sorted, one trie at a time is held."""
    held: list[pd.DataFrame] = []

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, shard in part.groupby("shard", sort=False):
            stored, asked = shard[shard["stored"]], shard[~shard["stored"]]
            if len(stored) and len(asked):
                trie = Trie()
                for form, key in zip(stored["form"], stored["key"]):
                    trie.add(form, (form, key))
                for form, key in zip(asked["form"], asked["key"]):
                    out += [(key, other) for near, other in trie.near(form) if other < key and (min(len(form), len(near)) >= SHORT or near == form or gentle(form, near))]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"])

    for frame in frames:
        if not len(frame):
            continue
        last = frame["shard"].iloc[-1]
        done = frame[frame["shard"] != last]
        if len(done):
            yield joined(pd.concat([*held, done]))
            held = []
        elif held and held[-1]["shard"].iloc[-1] != last:
            yield joined(pd.concat(held))
            held = []
        held.append(frame[frame["shard"] == last])
    if held:
        yield joined(pd.concat(held))


def _forms(frames):
    for frame in frames:
        rows = []
        for kind, key in zip(frame["kind"], frame["key"]):
            if key.startswith("#") or len(key) < 3:
                continue
            ws = key.split(" ")
            alone = "s" if kind == "s" else ""
            rows += [(alone + s, key, key, False) for s in shards_of(key, False)]
            for order in set(permutations(ws)) if 1 < len(ws) <= 3 and kind != "i" else {tuple(ws)}:
                form = " ".join(order)
                rows += [(alone + s, form, key, True) for s in shards_of(form, True)]
        yield pd.DataFrame(rows, columns=["shard", "form", "key", "stored"])


def trie_join(keys: DataFrame, most: int = 20_000) -> DataFrame:
    """(a, b), a < b: keys within one edit of each other, the words of one taken in any order.

    ``keys`` is (kind, key). Every key is stored in the shards of its whole pieces, in all orders of its (two or three)
    words, and asked for in the shards where a neighbour must share a piece; each shard becomes a trie that the automata
    of the asked keys traverse. A shard that stores more than ``most`` forms - a common given name at one length - is cut
    into blocks of stored forms, and its asked keys go to each block, so no trie is larger; shards are counted first.
    Single words (kind 's') meet single words only. Forms of fewer than 6 characters meet by a doubled letter or a swap
    (``gentle``). Not joined: keys of fewer than 3 characters and short forms of organisations ('#').
    """
    forms = materialize(keys.select("kind", "key").distinct().mapInPandas(_forms, "shard string, form string, key string, stored boolean"), "forms")
    hot = forms.groupBy("shard").agg(F.count_if("stored").alias("n")).where(F.col("n") > most).select("shard", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    marked = forms.join(hot, "shard", "left")
    own = F.when(F.col("stored"), F.array(F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = marked.where("blocks is not null").withColumn("block", F.explode(own)).select(F.concat_ws("#", "block", "shard").alias("shard"), "form", "key", "stored")
    placed = marked.where("blocks is null").select("shard", "form", "key", "stored").unionByName(cut)
    # as many tasks as the session shuffles with: the work goes by the tries, not by the few bytes of the rows
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(_in_shards, "a string, b string").distinct()


def _parsed(frames):
    for frame in frames:
        rows = []
        for author in frame["author"]:
            found = keys_of(author)
            if found:
                kind, keys, middle = found
                rows += [(author, kind, n, key, middle) for n, key in enumerate(keys)]
        yield pd.DataFrame(rows, columns=["author", "kind", "n", "key", "middle"])


def variant_groups(df: DataFrame, author_col: str = "author") -> DataFrame:
    """(author, entity): every distinct string that names one person or organisation, and the least key of its entity.

    1. By-lines are parsed: titles, roles, places and outlets go, family-first forms are turned, nicknames add their formal
       forms; by-lines of several people, general ones, null and blank ones are left out.
    2. Keys are linked: those of one string, and those within one edit by ``trie_join``. An edit inside the given name
       doesn't link two given names that are both common (as many families), nor any edit two different initials.
    3. Initials join a full name if all full names with that family and initial are one entity.
    4. Middle names part what else agrees: if the strings of an entity have middle names of different initials, or of one
       initial but more than two edits apart, those of each middle name are an entity ('John Adam Smith', 'John Brian
       Smith'), initials going with the one name they can stand for, and strings without one stay by themselves.
    Repeated rows change nothing; an empty table gives no rows; other columns are ignored. Hot names are one row each from
    the first aggregation on.
    """
    authors = df.select(df[author_col].alias("author")).where("author is not null and trim(author) != ''").distinct()
    parsed = materialize(authors.mapInPandas(_parsed, "author string, kind string, n int, key string, middle string"), "names")
    main = parsed.where("n = 0").select("author", "kind", "key", "middle")
    keys = parsed.select("kind", "key").distinct()
    own = main.join(parsed.where("n > 0").select("author", F.col("key").alias("other")), "author").select(F.col("key").alias("a"), F.col("other").alias("b"))

    near = trie_join(keys)
    given, family = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1)), lambda c: F.substring_index(c, " ", -1)
    families = keys.where("kind = 'p'").select(given("key").alias("given"), family("key").alias("family")).groupBy("given").agg(F.count_distinct("family").alias("families"))
    weighed = (
        near.select("a", "b", given("a").alias("ga"), given("b").alias("gb"))
        .join(families.select(F.col("given").alias("ga"), F.col("families").alias("fa")), "ga", "left")
        .join(families.select(F.col("given").alias("gb"), F.col("families").alias("fb")), "gb", "left")
    )
    both_common = (F.least("fa", "fb") >= 5) & (F.least("fa", "fb") >= 0.3 * F.greatest("fa", "fb"))
    initial = (F.length("ga") == 1) | (F.length("gb") == 1)
    close = weighed.where((F.col("ga") == F.col("gb")) | (~initial & ~F.coalesce(both_common, F.lit(False)))).select("a", "b")
    first = materialize(connected_components(own.unionByName(close)), "names-linked")  # the trie join runs once, here

    # initials: one entity per family and initial, or none
    full = keys.where("kind = 'p'").join(first.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.concat_ws(" ", F.substring(given("key"), 1, 1), family("key")).alias("short"))
    single = full.groupBy("short").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("key").alias("key")).where("least = most")
    by_initial = keys.where("kind = 'i'").join(single.select(F.col("short").alias("key"), F.col("key").alias("b")), "key").select(F.col("key").alias("a"), "b")
    linked = connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(by_initial))
    grouped = materialize(main.join(linked.withColumnRenamed("node", "key"), "key", "left").select("author", "middle", F.coalesce("root", "key").alias("root")), "names-grouped")

    middles = grouped.where("middle != ''").withColumn("initial", F.substring("middle", 1, 1)).groupBy("root", "initial").agg(
        F.min(F.when(F.length("middle") > 1, F.col("middle"))).alias("least"), F.max(F.when(F.length("middle") > 1, F.col("middle"))).alias("most")
    )
    middles = middles.withColumn("several", F.coalesce(F.levenshtein("least", "most") > 2, F.lit(False)))
    parted = middles.groupBy("root").agg(F.count("*").alias("n"), F.bool_or("several").alias("several")).where("n > 1 or several").select("root", F.lit(True).alias("parted"))
    rows = grouped.withColumn("initial", F.substring("middle", 1, 1)).join(parted, "root", "left").join(middles.select("root", "initial", "several"), ["root", "initial"], "left")
    own_middle = F.when(F.col("several") & (F.length("middle") > 1), F.col("middle")).otherwise(F.col("initial"))
    return rows.select("author", F.when(F.col("parted") & (F.col("middle") != ""), F.concat_ws(" / ", "root", own_middle)).otherwise(F.col("root")).alias("entity"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """(author_a, author_b), author_a < author_b, of the strings of each entity."""
    left, right = groups.select(F.col("author").alias("author_a"), "entity"), groups.select(F.col("author").alias("author_b"), "entity")
    return left.join(right, "entity").where("author_a < author_b").select("author_a", "author_b")
