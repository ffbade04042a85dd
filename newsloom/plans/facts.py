"""Queries on facts, model answers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import parsing, scoring, text
from newsloom.operators import facts, nested
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, DOC, documents
from newsloom.runtime import materialize, table

registry = Registry()
query = registry.add


def _games(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    docs = table(spark, d, "dataset_documents")
    own = documents(spark, d, "metadata", "primary_text")
    keys = ["home_city", "home_team", "away_city", "away_team"]
    meta = own.select(F.col("id").alias("document_id"), F.col("primary_text").alias("text"), *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in keys])
    return nested.flatten(docs, columnar=("box_score",)), meta


@query()
def box_score_facts(spark: SparkSession, d: str) -> DataFrame:
    tables, meta = _games(spark, d)
    games = tables[""].join(meta.drop("text"), "document_id")
    return facts.player_facts(tables["box_score"]).unionByName(facts.game_facts(games))


@query()
def mentioned_players(spark: SparkSession, d: str) -> DataFrame:
    tables, meta = _games(spark, d)
    return facts.mentioned_players(tables["box_score"], meta)


@query()
def stated_box_score_facts(spark: SparkSession, d: str) -> DataFrame:
    tables, meta = _games(spark, d)
    mentioned = materialize(facts.mentioned_players(tables["box_score"], meta), "mentioned")
    return facts.stated_facts(facts.player_facts(tables["box_score"]), meta, mentioned)


_SENT = r"""regexp_replace(regexp_replace(primary_text, '\b(Mr|Mrs|Ms|Dr|Jr|Sr|Rep|Sen|Gov)\.', '\1' || chr(1), 'g'), '\bU\.S\.', 'U' || chr(1) || 'S' || chr(1), 'g')"""


@query(rf"""WITH {DOC}, s AS (SELECT id, string_split_regex(regexp_replace({_SENT}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS l FROM doc WHERE source_id = 2),
u AS (SELECT id, generate_subscripts(l, 1) - 1 AS i, regexp_replace(replace(unnest(l), chr(1), '.'), '^\s+|\s+$', '', 'g') AS t FROM s), v AS (SELECT *, lower(t) AS w FROM u WHERE len(t) >= 10)
SELECT id AS document_id, i AS sentence_index, t AS fact_text, CASE WHEN regexp_matches(w, 'amend|strike|insert|delete|redesignate') THEN 'amendment' WHEN regexp_matches(w, 'appropriate|authoriz|million|billion|fund') THEN 'appropriation'
WHEN regexp_matches(w, 'define|means|referred to as') THEN 'definition' WHEN regexp_matches(w, 'require|shall|must|prohibit|mandate') THEN 'requirement' WHEN regexp_matches(w, 'effective|take effect|enact|upon enactment') THEN 'effective_date'
ELSE 'provision' END AS fact_type FROM v""")
def bill_sentence_types(spark: SparkSession, d: str) -> DataFrame:
    bills = documents(spark, d, "source_id", "primary_text").where("source_id = 2")
    out = facts.statute_facts(bills.select(F.col("id").alias("document_id"), F.col("primary_text").alias("text")))
    return out.withColumn("sentence_index", F.col("sentence_index").cast("long"))


@query(rf"""WITH {DOC}, l AS (SELECT id, regexp_extract(reference_content, 'label\\*": *\\*"([A-Z]+)', 1) AS label FROM doc WHERE source_id = 3)
SELECT id AS document_id, 'The text is ' || lower(label) AS fact_text, 'subjectivity' AS fact_type FROM l WHERE label <> ''""")
def label_facts(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d, "source_id").where("source_id = 3").select(F.col("id").alias("document_id"))
    labels = nested.flatten(table(spark, d, "dataset_documents"), columnar=("box_score",))[""].join(own, "document_id").select("document_id", "label")
    return facts.label_facts(labels, "subjectivity", "The text is ")


@query(f"""WITH {DOC}, d AS (SELECT *, CASE source_id WHEN 1 THEN 'rotowire' WHEN 2 THEN 'billsum' ELSE 'political_bias' END AS label FROM doc WHERE len(list_filter(regexp_split_to_array(primary_text, '[\\s\\x{{00a0}}]+'), lambda w: w <> '')) >= 20),
t AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS turn FROM d) SELECT id AS document_id, label, turn FROM t ORDER BY turn, label LIMIT 90""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """A balanced sample: 90 texts of at least 20 words, taken in turn from the three datasets."""
    from newsloom.operators.topics import round_robin

    label = F.when(F.col("source_id") == 1, "rotowire").when(F.col("source_id") == 2, "billsum").otherwise("political_bias")
    rows = documents(spark, d, "source_id", "primary_text").where(text.word_count(F.col("primary_text")) >= 20).select(F.col("id").alias("document_id"), label.alias("label"))
    return round_robin(rows, "label", [F.asc("document_id")], 90).withColumn("turn", F.col("turn").cast("long"))


def _answers(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    """An answer for each order, by its key, in one of the given forms; {k} stands for the last digit of the key."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("order_id"), F.replace(form, F.lit("{k}"), (k % 10).cast("string")).alias("answer"))


def _case(results: list[str]) -> str:
    return "CASE o_orderkey % " + str(len(results)) + " " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(results)) + " END"


_K = "(o_orderkey % 10)"
_T = f"CASE WHEN {_K} BETWEEN 1 AND 3 THEN {_K} ELSE 3 END"


@query(f"""SELECT o_orderkey AS order_id, {_case([f"concat_ws(',', {_T}, 2, 3, 3)", f"concat_ws(',', {_T}, 1, 3, 3)", "'2,1,3,3'", "'3,3,3,3'", "'1,3,3,3'"])} AS tiers FROM orders""")
def json_tiers(spark: SparkSession, d: str) -> DataFrame:
    forms = ['[{k}, 2, "high", 3, 1]', '<think>[9]</think> Tiers:\n[{k}, "1"] done', "first: 2\nthen 1\n\nnone", "nothing at all", "1) tier 1 or 2"]
    return _answers(spark, d, forms).select("order_id", F.array_join(parsing.tiers(F.col("answer"), F.lit(4)), ",").alias("tiers"))


@query(f"""SELECT o_orderkey AS order_id, {_case(["'support,partial_support,not_support'", "'support,not_support,not_support'", "'partial_support,support,not_support'", "'not_support,not_support,not_support'"])} AS labels FROM orders""")
def json_labels(spark: SparkSession, d: str) -> DataFrame:
    forms = ['["Supported", "partial", "maybe", "yes"]', 'Here: ["full", "no"] and ["yes"]', "1. Partially\n2. support\n3. not supported", "<think>support</think>"]
    return _answers(spark, d, forms).select("order_id", F.array_join(parsing.labels(F.col("answer"), F.lit(3)), ",").alias("labels"))


@query(f"""SELECT o_orderkey AS order_id, {_case([f"'a' || {_K} || '|b|'", "'x|y|z'", "'||'"])} AS merged FROM orders""")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    forms = ['```json\n["a{k}", "b"]\n```', '["x", "y", "z", "w"]', "no list"]
    return _answers(spark, d, forms).select("order_id", F.array_join(parsing.strings(F.col("answer"), F.lit(3)), "|").alias("merged"))


@query(f"""SELECT o_orderkey AS order_id, {_case(["'confirm,reject,confirm'", "'confirm,confirm,confirm'"])} AS verdicts FROM orders""")
def json_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, ['["Confirmed", "reject"]', "unsure"]).select("order_id", F.array_join(parsing.verdicts(F.col("answer"), F.lit(3)), ",").alias("verdicts"))


@query(f"""SELECT o_orderkey AS order_id, {_case(["'1,3'", "'2,4'", "''"])} AS selected FROM orders""")
def json_selected(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, ["[3, 1, 9, 3]", "I pick 4 and 2, not 12", "none"]).select("order_id", F.array_join(parsing.selected(F.col("answer"), F.lit(5)), ",").alias("selected"))


@query(f"""SELECT o_orderkey AS order_id, {_case([f"'f' || {_K} || '/stat;g/unknown'", "'h/quote'", "''"])} AS facts FROM orders""")
def json_facts(spark: SparkSession, d: str) -> DataFrame:
    forms = ['```json\n[{"fact": " f{k} ", "type": "stat"}, {"type": "x"}, {"fact": "g"}]\n```', 'So: [{"fact": "h", "type": "quote"}] ok', "sorry"]
    joined = F.array_join(F.transform(parsing.facts(F.col("answer")), lambda x: F.concat(x["fact"], F.lit("/"), x["type"])), ";")
    return _answers(spark, d, forms).select("order_id", joined.alias("facts"))


@query(f"""SELECT o_orderkey AS order_id, {_case(["'agree,contradict:2,-'", "'-,-,-'"])} AS conflicts FROM orders""")
def json_conflicts(spark: SparkSession, d: str) -> DataFrame:
    forms = ['[{"status": "agree"}, {"status": "contradict", "groups": [[0, 2], [1]], "explanation": "e"}, {"status": "contradict", "groups": [[0]]}]', "n/a"]
    show = F.transform(parsing.conflicts(F.col("answer"), F.lit(3)), lambda x: F.when(x.isNull(), "-").when(x["status"] == "agree", "agree").otherwise(F.concat(F.lit("contradict:"), F.size(x["groups"]).cast("string"))))
    return _answers(spark, d, forms).select("order_id", F.array_join(show, ",").alias("conflicts"))


@query(f"""SELECT o_orderkey AS order_id, {_case(["'Money:0,2'", "NULL"])} AS themes FROM orders""")
def json_themes(spark: SparkSession, d: str) -> DataFrame:
    forms = ['Themes {"themes": [{"name": " Money ", "facts": [1, 3, 99]}, {"name": "", "facts": [1]}, {"name": "Law", "facts": [0]}]}', '{"themes": []}']
    show = F.transform(parsing.themes(F.col("answer"), F.lit(5)), lambda x: F.concat(x["name"], F.lit(":"), F.array_join(x["facts"].cast("array<string>"), ",")))
    return _answers(spark, d, forms).select("order_id", F.array_join(show, ";").alias("themes"))


@query(f"""SELECT o_orderkey AS order_id, {_case([f"greatest(1, least(5, {_K})) || ',5,1,3'", "'3,3,3,3'"])} AS scores, {_case([f"CASE WHEN greatest(1, least(5, {_K})) + 9 >= 14 THEN 'Good' ELSE 'Fair' END", "'Fair'"])} AS rating FROM orders""")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    forms = ['<think>hm</think>{"factuality": {k}, "neutrality": 17, "coherence": -2, "completeness": "bad"}', "no score"]
    rows = _answers(spark, d, forms).select("order_id", parsing.judge_scores(F.col("answer")).alias("s"))
    each = [F.col(f"s.{c}") for c in parsing.CRITERIA]
    average = (each[0] + each[1] + each[2] + each[3]) / 4
    return rows.select("order_id", F.concat_ws(",", *each).alias("scores"), scoring.rating(average).alias("rating"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS events, count(DISTINCT user_id) AS users, CAST(round_even(sum(CAST(round_even(value * 10000, 0) AS BIGINT)) / 10000, 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    g = table(spark, d, "events").groupBy(F.unix_micros(F.date_trunc("day", ts)).alias("day_us"), "event_type")
    cents = F.bround(F.col("value") * 10000, 0).cast("long")
    return g.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.bround(F.sum(cents) / 10000, 4).alias("total"))


@query("""WITH o AS (SELECT user_id, epoch_us(ts) us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) n FROM o)
SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that end after two hours without an event."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


@query(f"""WITH {ART} SELECT id AS article_id, strftime(published_at AT TIME ZONE 'UTC', '%H:%M') AS clock, CASE WHEN 100 * coalesce(sentiment, 0) >= 70 THEN 'high' WHEN 100 * coalesce(sentiment, 0) >= 40 THEN 'mid' ELSE 'low' END AS band,
left(author, 300) AS author300, replace(replace('Read: {{text}}.', '{{text}}', title), '  ', ' ') AS prompt, printf('%.2f%%', coalesce(sentiment, 0) * 100) AS share, CASE WHEN len(content) > 500 THEN left(content, 500) || chr(10) || '[TRUNCATED]' ELSE content END AS shortened FROM art""")
def display_columns(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.plans.views import articles

    a = articles(spark, d, "published_at", "sentiment", "author", "title", "content")
    s = F.coalesce("sentiment", F.lit(0.0))
    return a.select(
        F.col("id").alias("article_id"), text.hours_minutes(F.col("published_at")).alias("clock"), scoring.color_band(s * 100).alias("band"), F.substring("author", 1, 300).alias("author300"),
        F.replace(text.render("Read: {text}.", F.col("title")), F.lit("  "), F.lit(" ")).alias("prompt"), text.percent(s, 2).alias("share"), text.shortened_prompt(F.col("content"), 500).alias("shortened"),
    )


@query("""SELECT o_orderkey AS order_id, strftime(o_orderdate::DATE - 7, '%A = %B %d, %Y') AS first_line, strftime(o_orderdate::DATE, '%A = %B %d, %Y') || ' (today)' AS today_line,
greatest(3, least(5, o_custkey // 3)) AS least_themes, least(8, greatest(greatest(3, least(5, o_custkey // 3)), o_custkey // 2)) AS most_themes FROM orders""")
def date_references(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    lines = F.split(text.date_reference(F.col("o_orderdate").cast("date")), "\n")
    low, high = scoring.theme_bounds(F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("order_id"), F.element_at(lines, 1).alias("first_line"), F.element_at(lines, 8).alias("today_line"), low.alias("least_themes"), high.alias("most_themes"))
