"""Core operators on small fixtures and against brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import cluster, components, facts, nested, pools, similar, topics, wire
from newsloom.sources import sinks


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


# ---- components ------------------------------------------------------------------------------------------------------


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- similarity join -------------------------------------------------------------------------------------------------


def words_of(t):
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z0-9']+", t or "")]


def sets_of(texts, k=5):
    out = {}
    for i, t in texts.items():
        w = words_of(t)
        if len(w) >= k:
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
    return " ".join(w)


def some_texts(seed, n=60, length=80):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(n):
        if i % 3 and texts:
            base = texts[rnd.choice(list(texts))]
            texts[i] = base if i % 5 == 0 else edited(rnd, base, rnd.randrange(4))
        else:
            texts[i] = " ".join(rnd.choice(vocabulary) for _ in range(length))
    return texts


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_similar_texts(spark, threshold):
    texts = some_texts(7)
    data = [(i % 2, i, t) for i, t in texts.items()] + [(0, 900, None), (0, 901, ""), (0, 902, "too short"), (None, 903, "a b c d e f")]
    found = similar.similar_texts(spark.createDataFrame(data, "g long, id long, text string"), "g", "id", "text", threshold)
    cls = {r["id"]: (r["grp"], r["class"]) for r in found.members.collect()}
    links = {(r["grp"], r["a"], r["b"]) for r in found.links.collect()}
    s = sets_of(texts)
    for i, j in itertools.combinations(s, 2):
        expected = i % 2 == j % 2 and len(s[i] & s[j]) >= threshold * len(s[i] | s[j])
        a, b = cls[i], cls[j]
        assert expected == (a == b or (a[0] == b[0] and (a[0], min(a[1], b[1]), max(a[1], b[1])) in links)), (i, j)
    assert set(cls) == set(s)


# ---- wire ------------------------------------------------------------------------------------------------------------

ARTICLES = "id long, source_host string, author string, content string, published_at timestamp, is_wire_content boolean, wire_original_id long"


def test_flag_wire(spark):
    from datetime import datetime as dt

    base = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    data = [
        (1, "a.com", "Jane", base, dt(2024, 1, 2), False, None),
        (2, "b.com", "Joe", base + " end", dt(2024, 1, 1), False, 77),
        (3, "c.com", "Reuters", other, dt(2024, 1, 1), False, None),
        (4, "d.com", "By Reuters", "quite another text with enough words here", dt(2024, 1, 3), False, None),
        (5, "reuters.com", "Reuters", "", None, False, None),
        (6, "e.com", "Ann", "a lonely text with enough words", None, None, None),
    ]
    own = spark.createDataFrame([(1, i) for i in range(1, 7)], "topic_id long, article_id long")
    got = {r["id"]: (r["is_wire_content"], r["wire_original_id"]) for r in wire.flag_wire(spark.createDataFrame(data, ARTICLES), own).collect()}
    assert got == {1: (True, 2), 2: (False, None), 3: (True, None), 4: (True, 3), 5: (False, None), 6: (False, None)}
    later = {r["id"] for r in wire.later_duplicates(spark.createDataFrame(data, ARTICLES), own).collect()}
    assert later == {1}


# ---- clustering and matching -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("vectors", "clusters"),
    [([[1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0]], [0, 0, 1, 0]), ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0, 1, 2]), ([[1, 0, 0], [0.99, 0.05, 0]], [0, 0]), ([[0, 0, 0], [0, 0, 0]], [0, 1])],
)
def test_greedy(vectors, clusters):
    assert cluster.greedy_assign(vectors, 0.85)[0] == clusters


def test_greedy_clusters(spark):
    data = [(1, 1, [1.0, 0.0], "A"), (1, 2, [1.0, 0.0], "A"), (1, 3, [0.0, 1.0], "B"), (2, 4, [1.0, 0.0], "A"), (2, 5, None, "A"), (None, 6, [1.0, 0.0], "A")]
    df = spark.createDataFrame(data, "pool long, item long, v array<float>, src string")
    got = {r["item"]: (r["cluster_id"], r["source_count"]) for r in cluster.greedy_clusters(df, "pool", "item", "v", "src").collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (1, 1), 4: (0, 1)}


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cost = rng.normal(size=(6, 6))
    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    columns = cluster.assignment(cost)
    assert sorted(columns) == list(range(6)) and sum(cost[i, j] for i, j in enumerate(columns)) == pytest.approx(best)


def test_optimal_match(spark):
    schema = "doc long, item long, v array<float>"
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], schema)
    t = spark.createDataFrame([(1, 10, [0.0, 1.0]), (3, 11, [1.0, 0.0])], schema)
    got = {(r["doc"], r["extracted"], r["truth"], r["kind"]) for r in cluster.optimal_match(e, t, "doc", "item", "v").collect()}
    assert got == {(1, 2, 10, "tp"), (1, 1, None, "fp"), (2, 3, None, "fp"), (3, None, 11, "fn")}


# ---- nested records --------------------------------------------------------------------------------------------------


def test_nested_forms(spark):
    game = {"box_score": {"PTS": {"0": "3", "7": "4"}, "AST": json.dumps({"9": "1"}), "TO": None}, "home_line": {"T": "x"}, "periods": [{"plays": [{"n": 1}, None, {"n": 2}]}, None, {"plays": {"n": 3}}]}
    bill = {"sections": json.dumps([{"num": 1, "Num": 2, "document_id": "odd", "provisions": [{"a": [[{"b": 1}], 5]}]}]), "extra": {"deep": [{"x": 1}]}}
    data = [
        (1, json.dumps(game), 1), (2, json.dumps(json.dumps(bill)), 1), (2, "{}", 0), (3, None, 1), (4, "  ", 1), (5, '{"cut": [', 1), (6, "[]", 1), (7, json.dumps([{"p": 1}, None, {"p": 2}]), 1),
        (8, json.dumps({"sections": {"num": 9}}), 1), (None, "{}", 1),
    ]
    df = spark.createDataFrame(data, "id long, reference_content string, created_at long").withColumn("NODE_PATH", F.lit("clash"))
    tables = nested.flatten(df, columnar=("box_score",))
    got = set(rows(nested.nodes(tables)))
    assert got == {
        (1, "box_score/0", ""), (1, "box_score/7", ""), (1, "box_score/9", ""), (1, "periods/0", ""), (1, "periods/2", ""), (1, "periods/0/plays/0", "periods/0"), (1, "periods/0/plays/2", "periods/0"),
        (1, "periods/2/plays/0", "periods/2"), (2, "sections/0", ""), (2, "sections/0/provisions/0", "sections/0"), (2, "sections/0/provisions/0/a/0/0", "sections/0/provisions/0"), (2, "extra/deep/0", ""),
        (7, "0", ""), (7, "2", ""), (8, "sections/0", ""),
    }
    assert set(tables["sections"].columns) >= {"Num", "num_2", "document_id_2"} or set(tables["sections"].columns) >= {"num", "Num_2", "document_id_2"}
    assert tables[""].count() == 8 and {r["node_path"] for r in tables["box_score"].where("PTS = '4'").collect()} == {"box_score/7"}


def test_nested_keeps_scalars_and_inner_arrays(spark):
    record = {"mixed": [{"k": 1}, "x", 7, None, [{"k": 2}, "y"]], "obj": "plain", "tags": ["a", "b"], "grid": [[{"n": 1}], [{"n": 2}, 3]], "box_score": {"PTS": {"0": 5}, "note": "n"}}
    other = {"obj": {"field": 4}, "tags": "single", "mixed": []}
    df = spark.createDataFrame([(1, json.dumps(record), 1), (2, json.dumps(other), 1)], "id long, reference_content string, created_at long")
    t = nested.flatten(df, columnar=("box_score",))
    full = lambda name, *c: sorted(tuple(r[x] for x in ("document_id", "node_path", "parent_path", "ordinal", *c)) for r in t[name].collect())
    assert full("mixed", "element", "k") == [(1, "mixed/0", "", 0, None, "1"), (1, "mixed/1", "", 1, "x", None), (1, "mixed/2", "", 2, "7", None), (1, "mixed/4", "", 4, None, None)]
    assert full("mixed/[]", "element", "k") == [(1, "mixed/4/0", "mixed/4", 0, None, "2"), (1, "mixed/4/1", "mixed/4", 1, "y", None)]
    assert full("tags", "element") == [(1, "tags/0", "", 0, "a"), (1, "tags/1", "", 1, "b"), (2, "tags/0", "", 0, "single")]
    assert [r[:2] for r in full("grid")] == [(1, "grid/0"), (1, "grid/1")] and full("grid/[]", "element", "n")[-1] == (1, "grid/1/1", "grid/1", 1, "3", None)
    assert {r["document_id"]: (r["obj"], r["obj.field"]) for r in t[""].select("document_id", "obj", "`obj.field`").collect()} == {1: ("plain", None), 2: (None, "4")}
    assert [r[1:] for r in full("box_score", "element", "PTS")] == [("box_score", "", None, '{"note": "n"}', None), ("box_score/0", "", 0, None, "5")]
    assert sorted(tuple(r) for r in nested.nodes(t).collect()) == [(1, "box_score/0", ""), (1, "grid/0/0", ""), (1, "grid/1/0", ""), (1, "mixed/0", ""), (1, "mixed/4/0", "")]


def test_nested_root_arrays(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, 2, [{"a": 3}]]', 1), (2, '{"a": 4}', 1)], "id long, reference_content string, created_at long")
    t = nested.flatten(df)
    assert {(r["node_path"], r["element"], r["a"]) for r in t["[]"].collect()} == {("0", None, "1"), ("1", "2", None), ("2", None, None)}
    assert sorted(tuple(r) for r in nested.nodes(t).collect()) == [(1, "0", ""), (1, "2/0", "")]


def test_nested_empty(spark):
    tables = nested.flatten(spark.createDataFrame([], "id long, reference_content string, created_at long"))
    assert nested.nodes(tables).count() == 0


def test_nested_too_many_names(spark, monkeypatch):
    assert nested.decode('"\\"[1]\\""') == [1] and nested.decode("[oops") == "[oops" and nested.read("3") is None


# ---- facts -----------------------------------------------------------------------------------------------------------


def test_player_and_game_facts(spark):
    p = spark.createDataFrame(
        [(1, "box_score/0", "Al Bo", "30", "12", "0", "N/A", "5", "9"), (1, "box_score/1", "Cy Do", "0", "9", "1", "1", "1", "1"), (1, "box_score/2", "N/A", "3", "9", "1", "1", "1", "1")],
        "document_id long, node_path string, PLAYER_NAME string, MIN string, PTS string, REB string, AST string, FGM string, FGA string",
    )
    assert {r["fact_text"] for r in facts.player_facts(p).collect()} == {"Al Bo had 12 points", "Al Bo made 5 of 9 field goals"}
    g = spark.createDataFrame([(1, "", "100", "100", "H", "Home", "V", "Vis")], "document_id long, node_path string, `home_line.PTS` string, `vis_line.PTS` string, home_city string, home_team string, away_city string, away_team string")
    assert {r["fact_text"] for r in facts.game_facts(g).collect()} == {"The H Home had 100 points", "The V Vis had 100 points", "The V Vis defeated the H Home 100-100", "The final score was 100-100"}


def test_mentions_and_stated_facts(spark):
    p = spark.createDataFrame([(1, "box_score/0", "Al Bo", "5", "12"), (1, "box_score/1", "Cy Do", "5", "7"), (1, "box_score/2", "Ed Do", "5", "2"), (1, "box_score/3", "Gu Hy", "5", "4")], "document_id long, node_path string, PLAYER_NAME string, MIN string, PTS string")
    t = spark.createDataFrame([(1, "Bo scored twelve. Do had seven. Cy Do left with 7.")], "document_id long, text string")
    m = facts.mentioned_players(p, t)
    assert {r["player"] for r in m.collect()} == {"Al Bo", "Cy Do"}
    stated = facts.stated_facts(facts.player_facts(p), t, m)
    assert {(r["player"], r["value"]) for r in stated.collect()} == {("Al Bo", 12), ("Cy Do", 7)}
    assert facts.facts_of_mentioned(facts.player_facts(p), m).count() == 2
    about = facts.text_about("bo had 3. then 4 more. cy do had 5 and bo 6. also 7.", ["Al Bo", "Cy Do"])
    assert about == {"Al Bo": "bo had 3. then 4 more. cy do had 5 and bo 6. also 7.", "Cy Do": "cy do had 5 and bo 6."}
    assert facts.text_about("5 points", ["Al Bo"]) == {"Al Bo": "5 points"} and facts.text_about("bout 5.", ["Al Bo"])["Al Bo"] == "bout 5." and facts.text_about("x", []) == {}


# ---- topics, pools, sinks --------------------------------------------------------------------------------------------


def test_topic_functions(spark):
    from datetime import datetime as dt

    t = spark.createDataFrame([(1, 4, 2, dt(2024, 1, 1, 12), dt(2023, 1, 1)), (2, 0, 0, None, dt(2023, 1, 1)), (3, 0, 0, None, dt(2024, 1, 1))], "id long, article_count long, source_count long, last_article_at timestamp, created_at timestamp")
    a = spark.createDataFrame([(10, 1, dt(2024, 1, 1, 12)), (11, 2, dt(2023, 12, 1)), (12, 1, None)], "id long, source_id long, published_at timestamp")
    c = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "topic_id long, article_id long")
    got = {r["topic_id"]: r for r in topics.trending(t, c, a, "2024-01-02 00:00:00").collect()}
    assert got[1]["recent_count"] == 1 and got[1]["trending_score"] == pytest.approx(1.25) and not got[1]["is_trending"]
    assert got[2]["trending_score"] == 0
    m = {r["topic_id"]: tuple(r)[1:3] for r in topics.topic_metrics(t, c, a).collect()}
    assert m == {1: (3, 2), 2: (0, 0), 3: (0, 0)}
    assert [r["id"] for r in topics.old_topics(t, "2024-01-20 00:00:00").collect()] == [2]
    s = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "id long, is_active boolean")
    assert rows(topics.missing(t.where("id = 1"), s, topics.covering(c, a))) == [(1, 3)]
    assert topics.ready_topics(c, a, c.select("topic_id").limit(0), 2).count() == 1 and topics.ready_topics(c, a, c.select("topic_id"), 2).count() == 0


def test_pages_and_slugs(spark):
    df = spark.range(25).withColumn("base", F.lit("x"))
    assert [topics.page(df, [F.asc("id")], n).count() for n in (1, 2, 3)] == [20, 5, 0]
    assert [r["slug"] for r in topics.suffixed_slugs(df.limit(3), "base", [F.asc("id")], 2).orderBy("id").collect()] == ["x", "x-2", "x-3"]
    clash = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x-1"), (5, "y")], "id long, base string")
    got = {r["id"]: r["slug"] for r in topics.suffixed_slugs(clash, "base", [F.asc("id")], taken=spark.createDataFrame([("y",), ("x-3",)], "slug string")).collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-4", 4: "x-1", 5: "y-1"}
    assert topics.phrase_search(df, " a ", [F.col("base")]).count() == 0 and topics.search(df, "", [F.col("base")]).count() == 25


def test_pool_functions(spark):
    members = spark.createDataFrame([(1, 1, i, s) for i, s in enumerate("ABCD")], "pool_id long, cluster_id long, member long, source string")
    conflicts = spark.createDataFrame([(1, 1, [[0, 1], [2], [9]])], "pool_id long, cluster_id long, groups array<array<int>>")
    parts = pools.split_clusters(members, conflicts)
    assert {r["member"]: r["part"] for r in parts.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    assert rows(pools.conflict_pairs(parts)) == [(1, 1, 0, 1)]
    n = spark.createDataFrame([(1, i) for i in range(1, 4)], "pool_id long, position long")
    answers = spark.createDataFrame([(1, '{"themes":[{"name":"A","facts":[1,2]},{"name":"B","facts":[2]}]}')], "pool_id long, answer string")
    assert {r["position"]: (r["theme"], r["theme_order"]) for r in pools.themed(n, answers).collect()} == {1: ("A", 1), 2: ("B", 2), 3: ("Other Details", 3)}
    r = spark.createDataFrame([(1, i, 1, i) for i in range(1, 6)], "pool_id long, id long, tier int, source_count long")
    assert {x["id"]: x["tier"] for x in pools.retiered(r, 2).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}


def test_sinks(spark):
    schema = "k long, v string"
    stored = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    new = spark.createDataFrame([(2, "c"), (3, "e"), (3, "d")], schema)
    assert rows(sinks.insert_absent(stored, new, ["k"])) == [(3, "d")]
    assert rows(sinks.upsert(stored, spark.createDataFrame([(2, "c"), (4, "x")], schema), ["k"])) == [(1, "a"), (2, "c"), (4, "x")]
    gone = spark.createDataFrame([(1,)], "id long")
    children = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "c long, parent long")
    assert rows(sinks.cascade(children, "parent", gone, "id")) == [(2, 2), (3, None)]
    assert rows(sinks.set_null(children, "parent", gone, "id")) == [(1, None), (2, 2), (3, None)]
    assert rows(sinks.replace_children(children.where("parent is not null"), spark.createDataFrame([(9, 1)], "c long, parent long"), "parent").select("c", "parent")) == [(2, 2), (9, 1)]


# ---- minhash, ordering, nesting --------------------------------------------------------------------------------------


def test_minhash(spark):
    from newsloom.operators import minhash

    assert minhash.banding(0.7) == (14, 9) and minhash.banding(0.8) == (9, 13)
    texts = some_texts(9, 80, 100)
    df = spark.createDataFrame([(1, i, t) for i, t in texts.items()] + [(1, 900, None), (1, 901, "few words")], "g long, id long, text string")
    signed = minhash.signatures(df, "id", "text")
    assert signed.count() == 80
    s, sig = sets_of(texts), {r["id"]: r["signature"] for r in signed.collect()}
    errors = [abs(sum(x == y for x, y in zip(sig[i], sig[j])) / 128 - len(s[i] & s[j]) / len(s[i] | s[j])) for i, j in itertools.combinations(range(40), 2)]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05
    edges = {tuple(r) for r in minhash.banded_edges(signed.withColumn("g", F.lit(1)), ["g"], "id").collect()}
    root = brute_components(edges)
    close = [(i, j) for i, j in itertools.combinations(s, 2) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    assert sum(root.get(i) is not None and root.get(i) == root.get(j) for i, j in close) >= 0.9 * len(close) > 0
    a = F.array(F.lit(1), F.lit(2))
    assert spark.range(1).select(minhash.estimated_jaccard(a, F.array(F.lit(1), F.lit(3)))).first()[0] == 0.5


def test_orders(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 5, "10%"), (3, 7, "9"), (4, 7, "A")], "id long, x long, t string")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(topics.ordered_by(df, "-x,id", ["x", "id"], [F.asc("id")])) == [1, 3, 4, 2]
    assert ids(topics.ordered_by(df, "secret", ["x"], [F.desc("id")])) == [4, 3, 2, 1]
    assert ids(df.orderBy(*topics.numeric_first(F.col("t")))) == [3, 2, 4, 1]


def test_nesting(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    c = spark.createDataFrame([(1, 9, "y"), (1, 3, "x")], "parent long, n long, v string")
    got = {r["id"]: [tuple(x) for x in r["kids"]] for r in topics.with_nested(p, "id", c, "parent", "kids", ["n"]).collect()}
    assert got == {1: [(3, "x"), (9, "y")], 2: []}
