"""Text functions and answer parsers on closed cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import inference, parsing, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("author", "host", "copy", "service"),
    [
        ("Reuters", "nytimes.com", True, "reuters"),
        ("Reuters", "reuters.com", False, "reuters"),
        ("By Jane Doe, AP", "x.com", True, "ap"),
        ("Associated Press", "APNEWS.com", False, "associated press"),
        ("Agence France-Presse", None, True, "agence france-presse"),
        ("Apple Grapes", "x.com", False, None),
        ("", "x.com", False, None),
        (None, "x.com", False, None),
        ("Zoé AP", "x.com", True, "ap"),
    ],
)
def test_wire(spark, author, host, copy, service):
    a, h = F.lit(author).cast("string"), F.lit(host).cast("string")
    assert one(spark, text.is_wire_copy(a, h)) is copy
    assert one(spark, text.wire_service(a)) == service


def test_word_count(spark):
    assert one(spark, text.word_count(F.lit("This is test content. " * 100))) == 400
    assert one(spark, text.word_count(F.lit("a b\tc\n"))) == 3
    assert one(spark, text.word_count(F.lit(""))) == 0


def test_shingles(spark):
    assert one(spark, text.word_shingles(F.lit("a b c d"))) == []
    assert one(spark, text.word_shingles(F.lit("A b c d e f"))) == ["a b c d e", "b c d e f"]
    assert one(spark, text.word_shingles(F.lit("x x x x x x"))) == ["x x x x x"]


def test_token_jaccard(spark):
    j = lambda a, b: one(spark, text.token_jaccard(F.lit(a), F.lit(b)))
    assert j("", "") == 1.0 and j("a", "") == 0.0 and j("a b", "B c") == pytest.approx(1 / 3)


def test_sentences(spark):
    s = 'One two three four five. Short one. "Six seven eight nine ten?" Yes it is so long!'
    assert one(spark, text.sentences(F.lit(s))) == ["One two three four five.", '"Six seven eight nine ten?" Yes it is so long!']


def test_statutes(spark):
    s = "Mr. Smith of the U.S. amends this. The U.S.C. section shall apply. It ends."
    assert one(spark, text.statute_sentences(F.lit(s))) == ["Mr. Smith of the U.S. amends this.", "The U.S.C. section shall apply.", "It ends."]
    kinds = [one(spark, text.statute_kind(F.lit(x))) for x in ("Amends it", "Funds 3 million", "It means x", "It must", "Effective now", "None")]
    assert kinds == ["amendment", "appropriation", "definition", "requirement", "effective_date", "provision"]


def test_slug_and_names(spark):
    assert one(spark, text.slugify(F.lit("  Hello, World -- Again! "), 50)) == "hello-world-again"
    assert one(spark, text.source_name(F.lit("daily.example.com"))) == "Daily"
    assert one(spark, text.source_name(F.lit("the-sun4news.co.uk"))) == "The-Sun4News"
    assert one(spark, text.names_joined(F.array(F.lit("A"), F.lit(""), F.lit(None), F.lit("B")))) == "A, B"
    assert one(spark, text.localized(F.create_map(F.lit("deu"), F.lit("Hallo")))) == "Hallo"
    assert one(spark, text.parsed_time(F.lit("nonsense"))) is None


def test_numbers_and_dates(spark):
    assert one(spark, text.numbers_as_digits(F.lit("Seven of twenty - two"))) == "7 of 20-2"
    lines = one(spark, text.date_reference(F.lit(datetime.date(2024, 3, 8)))).split("\n")
    assert len(lines) == 21 and lines[0] == "Friday = March 01, 2024" and lines[7] == "Friday = March 08, 2024 (today)"


def test_tiers(spark):
    t = lambda a, n=4: one(spark, parsing.tiers(F.lit(a).cast("string"), F.lit(n)))
    assert t('[1,5,"high",2]') == [1, 3, 3, 2]
    assert t("[1]") == [1, 3, 3, 3]
    assert t("1\n2\n3", 3) == [1, 2, 3]
    assert t("garbage") == [3, 3, 3, 3]
    assert t(None) == [3, 3, 3, 3]
    assert t("<think>[2]</think>[1, 2, 3, 1, 2]") == [1, 2, 3, 1]


def test_strings(spark):
    s = lambda a: one(spark, parsing.strings(F.lit(a), F.lit(2)))
    assert s('["a", "b"]') == ["a", "b"]
    assert s('```json\n["a"]\n```') == ["a", ""]
    assert s('Sure: ["a", "b", "c"] there') == ["a", "b"]
    assert s("nothing") == ["", ""]


def test_labels_verdicts_selection(spark):
    assert one(spark, parsing.labels(F.lit("partially\nsupported\nno"), F.lit(4))) == ["partial_support", "support", "not_support", "not_support"]
    assert one(spark, parsing.verdicts(F.lit('["CONFIRM it", 1]'), F.lit(3))) == ["confirm", "reject", "confirm"]
    assert one(spark, parsing.selected(F.lit("take 1, 3 and 30"), F.lit(5))) == [1, 3]


def test_conflicts_themes_judge(spark):
    got = one(spark, parsing.conflicts(F.lit('[{"status":"contradict","groups":[[0],[1]]},{"status":"odd"}]'), F.lit(3)))
    assert got[0]["groups"] == [[0], [1]] and got[1] is None and got[2] is None
    assert one(spark, parsing.themes(F.lit("oops"), F.lit(3))) is None
    assert one(spark, parsing.themes(F.lit('{"themes":[{"name":"A","facts":["2",9]}]}'), F.lit(3)))[0].asDict() == {"name": "A", "facts": [1]}
    assert list(one(spark, parsing.judge_scores(F.lit('{"factuality": 9, "neutrality": 0, "coherence": "4"}')))) == [5, 1, 4, 3]
    assert list(one(spark, parsing.judge_scores(F.lit("junk")))) == [3, 3, 3, 3]


def test_facts(spark):
    got = one(spark, parsing.facts(F.lit('```json\n[{"fact":"x"},{"fact":""},{"type":"t"}]\n```')))
    assert [r.asDict() for r in got] == [{"fact": "x", "type": "unknown"}]
    assert one(spark, parsing.facts(F.lit("none"))) == []


def test_named_sources(spark):
    def f(explanation, sources):
        x = F.lit(None).cast("array<string>") if sources is None else F.array(*map(F.lit, sources))
        return one(spark, inference.named_sources(F.lit(explanation).cast("string"), x))

    assert f("Source 0 says; Members 1 and 2 deny", ["A", "B", "C"]) == "A says; B and C deny"
    assert f("Sources 0, 1, and 2", ["A", "B", "C"]).startswith("A")
    assert f("Sources 0, 1 and 2 agree", ["A", "B", "C"]) == "A, B, and C agree"
    assert f("Source 9", ["A"]) == "Source 9" and f(None, ["A"]) is None and f("Source 0", None) == "Source 0"


def test_ask(spark):
    def upper():
        def answer(prompts):
            if "boom" in prompts:
                raise ValueError("down")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "id long, prompt string").repartition(1)
    rows = {r["id"]: r for r in inference.ask(df, "prompt", upper, retries=0, batch=1).collect()}
    assert rows[1]["answer"] == "A" and rows[1]["error"] is None
    assert rows[2]["answer"] is None and rows[2]["error"] is None
    assert rows[3]["answer"] is None and rows[3]["error"] == "down"
