"""Each found-operator on small fixtures with dirty rows, and against brute force."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import leaks, names, neardup, overlap, repeated, residue, truncated


def word_list(t):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9']+", t or "")]


def run_set(t, k=5):
    w = word_list(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
    return " ".join(w)


def family_of_texts(seed, n, length):
    rnd = random.Random(seed)
    texts = {}
    for i in range(n):
        if i % 3 and texts:
            base = texts[rnd.choice(list(texts))]
            texts[i] = base if i % 7 == 0 else edited(rnd, base, rnd.randrange(5))
        else:
            texts[i] = " ".join(f"w{rnd.randrange(400)}" for _ in range(length))
    return texts


# ---- 1 ----------------------------------------------------------------------------------------------------------------

PAGES = [
    ("Please enable JavaScript to read a-b-c on x.example. (build q)", "script"),
    ("404 Not Found. The page /a-b could not be located on x.example.", "error"),
    ("Access denied. You don't have permission to view \"http://x/a\" on this server.", "error"),
    ("Just a moment...", "error"),
    ("null", "filler"),
    ("The mayor {{first_name}} opened the bridge.", "template"),
    ("Two [CITY TK] councils met.", "template"),
    ("Lorem ipsum dolor sit amet", "filler"),
    ("Good news here.\nTellus nulla morbi quis felis velit morbi tempus velit.", "filler"),
    ("Your text goes here. Slot 3.", "filler"),
    ("Bitte aktivieren Sie JavaScript, um a zu lesen.", "script"),
]
NEWS = [
    'Visitors saw a "404 not found" page for 815 hours, Ann said.',
    '"Access denied" was painted on the grid, where protesters met.',
    "Ann Lee, who teaches JavaScript to 745 pupils, asked the council to enable the course.",
    "Designers still paste lorem ipsum into every stadium, joked Ann.",
    "About 404 theatres were affected, according to the report.",
    'The letter began "Dear [First Name]", and the office apologised.',
    'The outage left pages reading "service unavailable", Ann told the hearing.',
    "", "   ", None,
]


def test_residue(spark):
    data = [(i, "http://h.example/x", t, "") for i, (t, _) in enumerate(PAGES)] + [(100 + i, None, t, None) for i, t in enumerate(NEWS)]
    data += [(0, "http://h.example/x", PAGES[0][0], ""), (None, "http://h", "null", ""), (200, "bad url", "Fine text.", "TODO")]
    df = spark.createDataFrame(data, "id long, url string, content string, summary string").withColumn("value", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {(r["id"], r["field_name"]): r["evidence"] for r in residue.residue(df).collect()}
    assert got == {(i, "content"): e for i, (_, e) in enumerate(PAGES)} | {(200, "summary"): "filler"}
    assert residue.residue(df.limit(0)).count() == 0


def test_residue_subtracts_recurrent_lines(spark):
    notice = "This site requires cookies to work."
    data = [(i, "http://h.example/", f"Real news number {'abcdefghijkl'[i]} today.\n{notice}", "") for i in range(12)] + [(50, "http://h.example/", notice, "")]
    df = spark.createDataFrame(data, "id long, url string, content string, summary string")
    assert [r["id"] for r in residue.residue(df).collect()] == [50]
    marked = df.withColumn("content", F.concat("content", F.lit("\nThe {{mark}} of it.")))
    assert residue.residue(marked).where("evidence = 'template'").count() == 13


# ---- 3 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "part", "bits"), [(3, 200_000, 27), (4, 200, 8), (5, 37, 12)])
def test_cross_split(spark, monkeypatch, seed, part, bits):
    monkeypatch.setattr(overlap, "FILTER_BITS", bits)
    texts = family_of_texts(seed, 50, 60)
    splits = ["train", " TRAIN_v2 ", "test", "valid", None, ""]
    data = [(i, splits[i % 6], t, 1) for i, t in texts.items()] + [(900, "train", None, 1), (901, "test", "too short for it", 1), (902, "test", "", 1), (0, "test", "superseded text", 0)]
    df = spark.createDataFrame(data, "id long, split string, primary_text string, created_at long").withColumn("run", F.lit(1)).withColumn("class", F.lit(1))
    found = overlap.cross_split_overlap(df, part_suffixes=part)
    got = {(r["a"], r["b"]) for r in overlap.overlapping_pairs(found).collect()}
    side = {i: (splits[i % 6] or "").strip().lower().startswith("train") for i in texts if splits[i % 6] is not None}
    s = {i: run_set(t) for i, t in texts.items()}
    expected = {(i, j) for i, j in itertools.combinations(side, 2) if side[i] != side[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert got == expected and expected
    links = defaultdict(int)
    for i, j in expected:
        links[i] += 1
        links[j] += 1
    records = {r["id"]: r for r in overlap.record_overlaps(found).collect()}
    assert {i: r["links"] for i, r in records.items()} == {i: links[i] for i in side}
    assert all(r["longest"] >= 5 and r["shared"] <= r["runs"] for r in records.values() if r["links"])
    report = overlap.overlap_report(df.withColumn("source_id", F.lit(1)), found)
    assert report.agg(F.sum("pairs")).first()[0] == len(expected)


@pytest.mark.parametrize("part", [10_000, 50, 7])
def test_suffix_neighbours(spark, part):
    """Every suffix with a partner on the other side is found with its longest common prefix, wherever the parts are cut."""
    import numpy as np

    rnd = np.random.default_rng(part)
    texts = {(c, c % 2): rnd.integers(1, 4, rnd.integers(6, 30)).astype(">u4") for c in range(14)}
    df = spark.createDataFrame([(c, s, len(w), w.tobytes()) for (c, s), w in texts.items()], "class long, side int, n int, words binary")
    got = {(r["class"], r["pos"]): r["lcp"] for r in overlap.shared_prefixes(df, 5, 8, part).collect()}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b), 8) and a[n] == b[n]:
            n += 1
        return n

    best = {(c, i): max(common(w[i:], v[j:]) for (_, t), v in texts.items() if t != s for j in range(len(v) - 4)) for (c, s), w in texts.items() for i in range(len(w) - 4)}
    assert got == {at: n for at, n in best.items() if n >= 5} and got


def test_cross_split_empty(spark):
    df = spark.createDataFrame([], "id long, split string, primary_text string, created_at long")
    assert overlap.overlapping_pairs(overlap.cross_split_overlap(df)).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    data = [(i, 1, f"Story {'abcdefghijkl'[i]}\nShare this {i}\n\nBY the desk\n42") for i in range(12)] + [(20 + i, 2, "Share this") for i in range(9)]
    data += [(0, 1, data[0][2]), (50, 1, None), (51, 1, ""), (None, 1, "Share this"), (52, None, "Share this")]
    df = spark.createDataFrame(data, "id long, source_id long, content string").withColumn("key", F.lit(0)).withColumn("line_no", F.lit(0))
    assert {(r["id"], r["line_no"]) for r in repeated.repeated_lines(df).collect()} == {(i, n) for i in range(12) for n in (1, 3)}
    assert {(r["length"], r["support"]) for r in repeated.prefix_span(df).collect()} == {(2, 12)}
    clean = {r["id"]: (r["content"], r["removed"]) for r in repeated.without_repeated_lines(df).collect()}
    assert clean[0] == ("Story a\n\n42", 2) and clean[50] == (None, 0) and clean[51] == ("", 0) and clean[20] == ("Share this", 0)
    assert repeated.repeated_lines(df.limit(0)).count() == 0


def test_sequences_with_gaps_and_long_runs(spark):
    """A notice of 300 lines is one element; rare lines between two elements don't part them."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    notice = [f"notice {word(i)}" for i in range(300)]
    data = [(i, 1, "\n".join([*notice, f"rare {word(i)}", "Share this", "End" if i < 10 else f"else {word(i)}"])) for i in range(12)]
    data += [(50 + i, 1, "Share this") for i in range(3)] + [(60 + i, 1, "End\nShare this") for i in range(3)]
    got = {(r["length"], r["support"]) for r in repeated.prefix_span(spark.createDataFrame(data, "id long, source_id long, content string")).collect()}
    assert got == {(300, 12), (1, 18), (1, 13), (301, 12), (2, 10), (302, 10)}


# ---- 5 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("author", "kind", "key"),
    [
        ("By Dr Anthony M. Nareeslond", "p", "anthony nareeslond"), ("Nareeslond, Anthony M.", "p", "anthony nareeslond"), ("SKOATHENT Daniel", "p", "daniel skoathent"), ("søren clolneat", "p", "soren clolneat"),
        ("P.S. Tramfaint", "i", "p tramfaint"), ("Tramfaint, P.", "i", "p tramfaint"), ("Farah Shodreand, surgeon", "p", "farah shodreand"), ("Ann Lee | Some Courier", "p", "ann lee"), ("Ann Lee in Dealmstead", "p", "ann lee"),
        ("Keiko  Glalskot ", "p", "keiko glalskot"), ("Katherine Sheejin, Staff Writer", "p", "katherine sheejin"), ("The Musgel Media Co-op Ltd", "o", "musgel media cooperative"), ("PRWS (Proststess)", "o", "#proststess ws"),
        ("Data Institute (Flejoant)", "o", "flejoant data institute"), ("Staff", None, None), ("Editorial Board", None, None), ("Ann Lee and Bob Ray", None, None), ("Ann Lee, Bob Ray", None, None), ("Ann Lee & Bob Ray", None, None), ("", None, None), (None, None, None),
    ],
)
def test_keys(author, kind, key):
    found = names.keys_of(author)
    assert (found and found[0], found and found[1][0]) == (kind, key)


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_finds_all_neighbours(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(3, 8))) + " " + "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(4, 9))) for _ in range(40)]
    keys = set(base)
    for k in base:
        i = rnd.randrange(len(k) - 1)
        keys |= {k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + "q" + k[i + 1 :], k[:i] + k[i + 1] + k[i] + k[i + 2 :]}
    keys = {k for k in keys if len(k.split(" ")) == 2 and all(k.split(" "))}
    got = {(r["a"], r["b"]) for r in names.trie_join(spark.createDataFrame([("p", k) for k in keys], "kind string, key string")).collect()}
    turned = {k: {k, " ".join(k.split(" ")[::-1])} for k in keys}
    for x, y in itertools.combinations(sorted(keys), 2):
        if len(x) >= 6 and len(y) >= 6 and (osa(x, y) <= 1 or any(osa(x, t) <= 1 for t in turned[y])):
            assert (min(x, y), max(x, y)) in {(min(p), max(p)) for p in got}, (x, y)


def test_variants(spark):
    same = ["Daniel Skoathent", "SKOATHENT Daniel", "Dan Skoathent", "D. Skoathent", "Daniel Skotahent", "Skoathent, Daniel M.", "daniel skoathent"]
    other = ["Yusuf Steahoalm", "Staff", "Ann Lee and Bob Ray", "", None, "Maria Skoahent-Lee"]
    rows = [(a,) for a in same + other + same]
    df = spark.createDataFrame(rows, "author string").withColumn("key", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = {(r["author_a"], r["author_b"]) for r in names.variant_pairs(names.variant_groups(df)).collect()}
    assert got == set(itertools.combinations(sorted(same), 2))
    assert names.variant_groups(df.limit(0)).count() == 0


def test_ambiguous_initials_stay_apart(spark):
    df = spark.createDataFrame([("Priya Klogant",), ("Patricia Klogant",), ("P. Klogant",)], "author string")
    assert names.variant_pairs(names.variant_groups(df)).count() == 0


def linked_names(spark, *authors):
    got = names.variant_pairs(names.variant_groups(spark.createDataFrame([(a,) for a in authors], "author string")))
    return {(r["author_a"], r["author_b"]) for r in got.collect()}


def test_middle_names_part(spark):
    one = ["John Adam Smith", "John A. Smith"]
    assert linked_names(spark, *one, "John Brian Smith", "John Smith") == {tuple(sorted(one))}
    assert len(linked_names(spark, "Ann M. Klogant", "Ann Klogant", "Klogant, Ann M.")) == 3
    assert linked_names(spark, "Ann Maria Klogant", "Ann Melissa Klogant") == set()
    assert len(linked_names(spark, "Ann Maria Klogant", "Ann Mraia Klogant")) == 1


def test_short_and_single_names(spark):
    assert linked_names(spark, "Bo Li", "Bo Lii", "Bo Xu", "Bo Yu", "Madonna", "Madona", "Reuters") == {("Bo Li", "Bo Lii"), ("Madona", "Madonna")}


@pytest.mark.parametrize("most", [20_000, 3])
def test_hot_shards_are_cut(spark, most):
    rnd = random.Random(9)
    keys = {f"anthony {''.join(rnd.choice('abcdef') for _ in range(5))}" for _ in range(40)}
    keys |= {k[:-1] + "z" for k in list(keys)[:10]} | {k + "x" for k in list(keys)[10:20]}
    got = {(r["a"], r["b"]) for r in names.trie_join(spark.createDataFrame([("p", k) for k in keys], "kind string, key string"), most).collect()}
    assert {(min(p), max(p)) for p in got} == {(x, y) for x, y in itertools.combinations(sorted(keys), 2) if osa(x, y) <= 1} and got


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    whole = "The council measured the bridge on Monday and everybody cheered."
    full = [(i, 1, f"{whole} The council opened the {w} on Friday and nobody came.", "") for i, w in enumerate("park pool school road gate farm mill dock".split())]
    cut = {100: "The council measured the bri", 101: f"{whole} The council", 102: f"{whole} The council opened…", 103: f"{whole} The c �", 104: f"{whole} And th [+120 chars]"}
    fine = {200: whole, 201: "Graphic: 3 farms, drawn by Ann Lee", 202: "Why mapping the pool matters to Kent", 203: "404 Not Found", 204: "", 205: None, 206: "null", 207: 'He said "no."'}
    data = full + [(i, 2, t, None) for i, t in (cut | fine).items()] + [(100, 2, cut[100], None), (None, 2, "The council mea", None), (300, None, "The council mea", None)]
    df = spark.createDataFrame(data, "id long, source_id long, content string, summary string").withColumn("value", F.lit("clash")).withColumn("line", F.lit("clash"))
    t = truncated.truncation(df)
    assert {(r["id"], r["field_name"]) for r in t.found.collect()} == {(i, "content") for i in cut}
    assert truncated.truncation(df.limit(0)).found.count() == 0


def test_hidden_limit(spark):
    rnd = random.Random(1)
    text = "The council opened the park on Monday and the mayor closed the pool on Friday. " * 5
    data = [(i, 1, "", text[rnd.randrange(40) : 300][:120]) for i in range(30)] + [(100 + i, 1, "", text[:79]) for i in range(10)]
    df = spark.createDataFrame(data, "id long, source_id long, content string, summary string")
    limits = {(r["measure"], r["size"]) for r in truncated.truncation(df).limits.collect()}
    assert ("characters", 120) in limits and ("bytes", 120) in limits


def test_headlines_are_complete_though_some_sentences_open_alike(spark):
    places = [a + b for a in "Ash Elm Oak Fir Yew".split() for b in "ham ton by dale wick".split()]
    data = [(i, 1, "Anna Lee closed joint farm in Kent after the storm.", f"Anna Lee closed joint farm in {p}") for i, p in enumerate(places[:20])]
    data += [(100, 1, "The council opened the park on Monday. " * 5, "The council opened the")]
    df = spark.createDataFrame(data, "id long, source_id long, content string, summary string")
    assert [r["id"] for r in truncated.truncation(df).found.collect()] == [100]


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def test_near_duplicates(spark):
    texts = family_of_texts(11, 90, 90)
    s = {i: run_set(t) for i, t in texts.items()}
    data = list(texts.items()) + [(0, texts[0]), (900, None), (901, ""), (902, "short text"), (None, texts[1])]
    df = spark.createDataFrame(data, "id long, content string").withColumn("class", F.lit(1)).withColumn("path", F.lit(1))
    found = neardup.near_duplicates(df, bucket=20)
    got = {(r["a"], r["b"]) for r in neardup.linked_pairs(found).collect()}
    expected = {(i, j) for i, j in itertools.combinations(s, 2) if len(s[i] & s[j]) >= 0.7 * len(s[i] | s[j])}
    assert not got - expected and len(got) >= 0.99 * len(expected) and len(expected) > 50
    links = defaultdict(int)
    for i, j in got:
        links[i] += 1
        links[j] += 1
    assert {r["id"]: r["links"] for r in neardup.grouped(found).collect()} == {i: links[i] for i in texts}
    assert neardup.linked_pairs(neardup.near_duplicates(df.limit(0))).count() == 0


# ---- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [27, 7])
def test_leaks(spark, bits):
    rnd = random.Random(2)
    item = {i: " ".join(f"w{rnd.randrange(60)}" for _ in range(30)) for i in range(8)} | {8: "too short", 9: None}
    docs = {}
    for d in range(40):
        i = rnd.randrange(8)
        w, n, at = item[i].split(), rnd.choice([11, 12, 13, 30]), rnd.randrange(15)
        docs[d] = "Intro, words! " + ", ".join(w[at : at + n]).upper() + ". The end"
    docs |= {100: None, 101: "", 102: item[0]}
    df = spark.createDataFrame(list(docs.items()) + [(102, item[0]), (None, item[0])], "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(list(item.items()), "item_id long, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it, filter_bits=bits).collect()}
    grams = lambda t: {tuple(w[j : j + 12]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for j in range(len(w) - 11)}
    expected = {(d, i) for d, t in docs.items() for i, x in item.items() if grams(t) & grams(x)}
    assert got == expected and expected
    assert leaks.leaked_items(df, it.limit(0)).count() == 0 and leaks.leaked_items(df.limit(0), it).count() == 0
