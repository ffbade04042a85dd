"""No pre-filter of the evidence skips a line that the patterns match."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import residue

ERRORS = [
    ["404: page not found", "503 error - not found"], ["404", "Error 500", "502 Error", "400 Bad Request", "403 Forbidden", "*** 404 ***", '"Read this" 404'], ["Page not found"],
    ["page /x could not be located"], ["We can’t find what you are looking for"], ["Access denied"], ["You don't have permission to view it"], ["Forbidden"], ["Service unavailable"],
    ["Internal server error"], ["Bad gateway"], ["Gateway time-out"], ["Error establishing a database connection"], ["Fatal error: Uncaught x"], ["Something went wrong while loading"],
    ["Too many requests"], ["Your address has been rate limited"], ["Your session has expired"], ["Not available in your region"], ["Checking your browser before entry"],
    ["Wait while we verify your browser"], ["Oops! Something went wrong.", "Ooops, page not found"], ["Something went wrong.", "Something went wrong. Please try again"],
    ["The page you requested does not exist", "The URL that you were looking for doesn’t exist."], ["This page isn't available", "This page no longer exists."], ["This site can’t be reached"], ["Verify you are human"], ["Just a moment..."], ["Down for maintenance"], ["Please wait"],
]
SCRIPTS = [
    ["Enable JavaScript"], ["JavaScript is disabled"], ["Turn on scripts"], ["noscript"], ["Scripts switched off"], ["It requires cookies"], ["Allow cookies to go on"], ["Cookies are required"],
    ["Aktivieren Sie JavaScript"], ["Activer les cookies"], ["Activar las cookies"], ["Your browser is not supported"], ["Unsupported browser"],
]
STAND_INS = [["Your text goes here"], ["test test test"], ["Dummy copy"], ["Paragraph for layout only"], ["This is a test"], ["Placeholder text"]]
FILLER = [
    "Consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Donec sed odio nulla",
    *[" ".join(residue.FILLER_WORDS[i : i + 4]) for i in range(0, len(residue.FILLER_WORDS) - 3)],
]
KINDS = [(residue.ERROR_FORMS, ERRORS, "error"), (residue.SCRIPT_DEMANDS, SCRIPTS, "script"), (residue.STAND_INS, STAND_INS, "filler")]


@pytest.mark.parametrize(("patterns", "examples", "kind"), KINDS)
def test_examples_pass_the_hints(spark, patterns, examples, kind):
    assert len(patterns) == len(examples)
    rows = spark.createDataFrame([(x, n) for n, of in enumerate(examples) for x in of], "line string, n int")
    bare = F.regexp_replace("line", residue._QUOTED, " ")
    own = F.element_at(F.array(*[bare.rlike(f"(?i){p}") for p in patterns]), F.col("n") + 1)
    for r in rows.select("line", own.alias("own"), residue._hinted(bare).alias("hinted"), residue.evidence(F.col("line")).alias("kind")).collect():
        assert r["own"], f"no example of its pattern: {r['line']}"
        assert r["hinted"] and r["kind"], r["line"]


def test_filler_of_any_words(spark):
    rows = spark.createDataFrame([(x,) for x in FILLER], "line string")
    assert [r["line"] for r in rows.where(~residue.evidence(F.col("line")).eqNullSafe("filler")).collect()] == []


def test_news_with_such_numbers_is_none(spark):
    lines = ["Some 400 people came.", "A 404 error is shown on 500 pages of the site.", "He paid 500"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(residue.evidence(F.col("line")).alias("e")).collect()
    assert [r["e"] for r in got] == [None] * 3


@pytest.mark.parametrize(
    "line", ["Error 503", "400 Bad Request", "504", "dolor sit amet, consectetur adipiscing elit", "Oops! Something went wrong.", "[Headline]", "The page you requested does not exist", "{{" + "x" * 200 + "}}", "%" + "A" * 60 + "%"]
)
def test_whole_contents(spark, line):
    df = spark.createDataFrame([(1, "http://h/", line, "")], "id long, url string, content string, summary string")
    assert residue.residue(df).count() == 1


def test_literals_are_needed():
    """Every pattern with literals of its own matches only lines that hold one; the others are always tried."""
    assert residue.needed(r"\bpage (?:not|never) found\b") in ({" found"}, {"page n"})
    assert residue.needed(r"(?:40\d|forbidden)") == {"40", "forbidden"} and residue.needed(r"\w+x?") is None
    literals, without = residue.hints(residue.SCRIPT_DEMANDS + residue.ERROR_FORMS + residue.STAND_INS)
    assert min(map(len, literals)) >= 4 and len(without) <= 2


def test_error_page_with_a_line_of_its_own_recurs(spark):
    """Its error line passes ten articles of the host; the request id beside it is no text of its own, a report is."""
    page = [(i, "http://h/", f"Service unavailable.\nRequest {'abcdefghijklmnop'[i]}f-{i}x", "") for i in range(14)]
    news = [(100 + i, "http://h/", f"The mayor of {'abcdefghijklmnop'[i]}ville opened the bridge today.\nService unavailable.", "") for i in range(14)]
    df = spark.createDataFrame(page + news, "id long, url string, content string, summary string")
    assert {r["id"] for r in residue.residue(df).collect()} == set(range(14))
