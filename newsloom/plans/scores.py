"""Queries on judgments, scores and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.operators import cluster, scores, topics
from newsloom.plans.registry import Registry
from newsloom.plans.views import ART, CLU, JUD, articles, clusters, judgments
from newsloom.runtime import table

registry = Registry()
query = registry.add
_CNT = """cnt AS (SELECT pool_id, article_id, count(*) FILTER (label = 'support') s, count(*) FILTER (label = 'partial_support') p, count(*) FILTER (label = 'not_support') n, count(*) t,
count(*) FILTER (label = 'support' AND vital) vs, count(*) FILTER (label = 'partial_support' AND vital) vp, count(*) FILTER (vital) vt FROM jud GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY pool_id, article_id")
_R = lambda x: f"CAST(round_even({x}, 6) AS DOUBLE)"
_SCORES = f"""{_R('CASE WHEN t = 0 THEN 1 ELSE (s + 0.5 * p) / t END')} AS coverage, {_R('CASE WHEN t = 0 THEN 0 ELSE 1 - (s + 0.5 * p) / t END')} AS omission,
{_R('CASE WHEN vt = 0 THEN 0 ELSE 1 - (vs + 0.5 * vp) / vt END')} AS vital_omission,
{_R('CASE WHEN vt * 2 + t - vt = 0 THEN 1 ELSE ((vs + 0.5 * vp) * 2 + (s - vs) + 0.5 * (p - vp)) / (vt * 2 + t - vt) END')} AS weighted_coverage"""


@query(f"WITH {JUD}, {_CNT} SELECT pool_id, article_id, s AS support, p AS partial, n AS not_support, t AS total, vs AS vital_support, vp AS vital_partial, vt AS vital_total, {_SCORES} FROM cnt")
def coverage_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.with_scores(scores.judgment_counts(judgments(spark, d), ["pool_id", "article_id"]))


@query(f"WITH {JUD}, cnt AS (SELECT pool_id, count(*) FILTER (label = 'support') s, count(*) FILTER (label = 'partial_support') p, count(*) t, count(*) FILTER (label = 'support' AND vital) vs, count(*) FILTER (label = 'partial_support' AND vital) vp, count(*) FILTER (vital) vt FROM jud GROUP BY 1) SELECT pool_id, {_SCORES} FROM cnt")
def pool_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.with_scores(scores.judgment_counts(judgments(spark, d), ["pool_id"])).select("pool_id", "coverage", "omission", "vital_omission", "weighted_coverage")


@query(f"""WITH {JUD}, n AS (SELECT pool_id, count(DISTINCT article_id) AS a FROM jud GROUP BY 1), f AS (SELECT pool_id, nugget_id, count(DISTINCT article_id % 7) AS c, list_sort(list_distinct(list(article_id % 7))) AS l FROM jud WHERE label <> 'not_support' GROUP BY ALL)
SELECT pool_id, nugget_id, c AS source_count, array_to_string(l, ',') AS sources, CASE WHEN c >= greatest(2, CAST(ceil(a * 0.25) AS BIGINT)) THEN 'vital' ELSE 'okay' END AS importance FROM f JOIN n USING (pool_id)""".replace("GROUP BY ALL", "GROUP BY pool_id, nugget_id"))
def vital_nuggets(spark: SparkSession, d: str) -> DataFrame:
    """Facts by the distinct sources (here: article_id % 7) behind them; vital from a quarter of the pool's articles on, two at least."""
    j = judgments(spark, d)
    n = j.groupBy("pool_id").agg(F.count_distinct("article_id").alias("a"))
    f = j.where("label != 'not_support'").groupBy("pool_id", "nugget_id").agg(F.array_sort(F.collect_set(F.col("article_id") % 7)).alias("l"))
    c = F.size("l").cast("long")
    return f.join(n, "pool_id").select("pool_id", "nugget_id", c.alias("source_count"), F.array_join("l", ",").alias("sources"), F.when(c >= scoring.vital_threshold(F.col("a")), "vital").otherwise("okay").alias("importance"))


@query(f"""WITH {JUD}, x AS (SELECT pool_id, nugget_id, 'S' || (article_id % 5) AS source, article_id, label FROM jud WHERE pool_id % 4 = 0),
l AS (SELECT pool_id, nugget_id, source, arg_max(label, article_id) AS label FROM x GROUP BY ALL), p AS (SELECT DISTINCT pool_id, source FROM x), n AS (SELECT DISTINCT pool_id, nugget_id FROM x)
SELECT pool_id, nugget_id, source, coalesce(label, 'no_data') AS label FROM n JOIN p USING (pool_id) LEFT JOIN l USING (pool_id, nugget_id, source)""".replace("GROUP BY ALL", "GROUP BY pool_id, nugget_id, source").replace(" WHERE pool_id % 4 = 0", ""))
def fact_matrix(spark: SparkSession, d: str) -> DataFrame:
    j = judgments(spark, d)
    sources = F.concat(F.lit("S"), (F.col("article_id") % 5).cast("string")).alias("source")
    named = j.select("article_id").distinct().select("article_id", sources)
    return scores.fact_matrix(j, named, F.col("article_id")).select("pool_id", "nugget_id", F.explode("labels").alias("source", "label"))


@query(f"""WITH {JUD}, c AS (SELECT pool_id, nugget_id // 50 AS g, nugget_id, count(DISTINCT article_id % 5) FILTER (label IN ('support', 'partial_support')) AS n FROM jud GROUP BY ALL),
k AS (SELECT pool_id, g, count(*) AS claims, min(n) AS least, max(n) AS top, sum(n) AS total FROM c GROUP BY 1, 2)
SELECT pool_id * 1000000 + g AS "group", claims, top, CASE WHEN claims >= 2 AND top / total >= 0.65 THEN 0 ELSE -1 END AS consensus_index FROM k WHERE least > 0""".replace("GROUP BY ALL", "GROUP BY pool_id, nugget_id"))
def contradiction_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a pool in blocks of 50 ids as rival claims."""
    backed = F.when(F.col("label").isin("support", "partial_support"), F.col("article_id") % 5)
    claims = judgments(spark, d).groupBy("pool_id", "nugget_id").agg(F.count_distinct(backed).alias("supporters"))
    group = F.col("pool_id") * 1000000 + F.floor(F.col("nugget_id") / 50).cast("long")
    return scores.contradiction_consensus(claims.select(group.alias("group"), F.col("nugget_id").alias("claim"), "supporters"))


_DOCS = f"""{JUD}, doc_counts AS (SELECT article_id, count(*) FILTER (label = 'support') tp, count(*) FILTER (label = 'partial_support') fp, count(*) FILTER (label = 'not_support') fn FROM jud GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END r FROM doc_counts),
fs AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END f FROM pr)"""


@query(f"""WITH {_DOCS}, a AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn, count(*) documents, avg(f) m, stddev_pop(f) s FROM fs), b AS (SELECT *, tp / (tp + fp) p, tp / (tp + fn) r FROM a)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, documents, {_R('p')} AS "precision", {_R('r')} AS recall, {_R('2 * p * r / (p + r)')} AS f1,
CAST(round_even(m, 4) AS DOUBLE) AS f1_mean, CAST(round_even(s, 4) AS DOUBLE) AS f1_std FROM b""")
def f1_micro(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("label") == x)
    counts = judgments(spark, d).groupBy("article_id").agg(is_("support").alias("tp"), is_("partial_support").alias("fp"), is_("not_support").alias("fn"))
    return scores.micro_f1(counts)


@query(f"""WITH {JUD} SELECT pool_id, count(*) AS total, {_R("count(*) FILTER (label = 'support') / count(*)")} AS recall_strict,
{_R("(count(*) FILTER (label = 'support') + 0.5 * count(*) FILTER (label = 'partial_support')) / count(*)")} AS recall_lenient,
{_R("CASE WHEN count(*) FILTER (vital) = 0 THEN 0 ELSE count(*) FILTER (vital AND label = 'support') / count(*) FILTER (vital) END")} AS vital_strict FROM jud GROUP BY 1""")
def nugget_recall(spark: SparkSession, d: str) -> DataFrame:
    c = scores.judgment_counts(judgments(spark, d), ["pool_id"])
    return c.select(
        "pool_id", "total", F.bround(scoring.ratio(F.col("support"), F.col("total")), 6).alias("recall_strict"),
        F.bround(scoring.ratio(F.col("support") + 0.5 * F.col("partial"), F.col("total")), 6).alias("recall_lenient"), F.bround(scoring.ratio(F.col("vital_support"), F.col("vital_total")), 6).alias("vital_strict"),
    )


@query(f"""WITH {JUD}, c AS (SELECT pool_id, count(*) FILTER (label = 'support') s, count(*) FILTER (label = 'partial_support') p, count(*) FILTER (label = 'not_support') n FROM jud GROUP BY 1)
SELECT pool_id, s AS tp, 0 AS fp, n + p AS fn, 1.0 AS "precision", {_R('CASE WHEN s + n + p = 0 THEN 0 ELSE s / (s + n + p) END')} AS f1 FROM c""")
def strict_run_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a judged run: no false positives, precision 1, F1 as recall; partial support counts as missed."""
    c = scores.judgment_counts(judgments(spark, d), ["pool_id"])
    fn = F.col("not_support") + F.col("partial")
    return c.select("pool_id", F.col("support").alias("tp"), F.lit(0).alias("fp"), fn.alias("fn"), F.lit(1.0).alias("precision"), F.bround(scoring.recall(F.col("support"), fn), 6).alias("f1"))


_LEAN = """an AS (SELECT *, CASE article_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS truth FROM article_analysis WHERE leaning_left IS NOT NULL AND leaning_center IS NOT NULL AND leaning_right IS NOT NULL),
g AS (SELECT unnest([0.0, 0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30])::DOUBLE AS margin), s AS (SELECT *, list_reverse_sort([leaning_left, leaning_center, leaning_right]) AS o FROM an),
pred AS (SELECT margin, truth, CASE WHEN o[1] - o[2] < margin THEN 'center' WHEN leaning_left = o[1] THEN 'left' WHEN leaning_center = o[1] THEN 'center' ELSE 'right' END AS guess FROM s, g),
k AS (SELECT margin, class, count(*) FILTER (truth = class AND guess = class) tp, count(*) FILTER (truth <> class AND guess = class) fp, count(*) FILTER (truth = class AND guess <> class) fn
 FROM pred, (SELECT unnest(['left', 'center', 'right']) AS class) GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END r FROM k),
rep AS (SELECT margin, class, tp + fn AS support, tp, CAST(round_even(p, 6) AS DOUBLE) AS p, CAST(round_even(r, 6) AS DOUBLE) AS r, CAST(round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS DOUBLE) AS f1 FROM q)"""
MARGINS = [0.0, 0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30]


def _margin_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports for all margins of a fixed grid: ten per row from a constant array."""
    truth = F.when(F.col("article_id") % 3 == 0, "left").when(F.col("article_id") % 3 == 1, "center").otherwise("right")
    rows = table(spark, d, "article_analysis").where("leaning_left is not null and leaning_center is not null and leaning_right is not null")
    rows = rows.select("leaning_left", "leaning_center", "leaning_right", truth.alias("truth"), F.explode(F.array(*map(F.lit, MARGINS))).alias("margin"))
    rows = rows.withColumn("guess", scoring.leaning(F.col("leaning_left"), F.col("leaning_center"), F.col("leaning_right"), F.col("margin")))
    return scores.classification_report(rows, "truth", "guess", ["left", "center", "right"], ["margin"])


@query(f'WITH {_LEAN} SELECT margin, class, support, tp, p AS "precision", r AS recall, f1 FROM rep')
def leaning_margin_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _margin_report(spark, d)


@query(f"WITH {_LEAN}, m AS (SELECT margin, CAST(round_even(avg(f1), 6) AS DOUBLE) AS macro FROM rep GROUP BY 1) SELECT margin, macro FROM m ORDER BY macro DESC, margin LIMIT 1")
def best_leaning_margin(spark: SparkSession, d: str) -> DataFrame:
    return scores.best_setting(_margin_report(spark, d), "margin")


@query("""WITH c AS (SELECT CASE WHEN o_totalprice >= 150000 THEN 'high' ELSE 'low' END AS truth, CASE WHEN o_orderstatus = 'O' THEN 'high' ELSE 'low' END AS guess FROM orders)
SELECT truth, count(*) FILTER (guess = 'high') AS guessed_high, count(*) FILTER (guess = 'low') AS guessed_low, CAST(round_even(count(*) FILTER (truth = guess) / count(*), 6) AS DOUBLE) AS accuracy FROM c GROUP BY 1""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.when(F.col("o_totalprice") >= 150000, "high").otherwise("low").alias("truth"), F.when(F.col("o_orderstatus") == "O", "high").otherwise("low").alias("guess"))
    p = rows.groupBy("truth").pivot("guess", ["high", "low"]).agg(F.count(F.lit(1))).na.fill(0)
    right = F.when(F.col("truth") == "high", F.col("high")).otherwise(F.col("low"))
    return p.select("truth", F.col("high").alias("guessed_high"), F.col("low").alias("guessed_low"), F.bround(right / (F.col("high") + F.col("low")), 6).alias("accuracy"))


@query(f"""WITH {ART}, {CLU}, f AS (SELECT topic_id, source_id, an.article_id, subjectivity_ratio sr, leaning_left l, leaning_center c, leaning_right r, published_at FROM clu JOIN art a ON a.id = clu.article_id JOIN article_analysis an ON an.article_id = a.id
WHERE an.status = 'complete' AND NOT is_wire_content), tone AS (SELECT topic_id, source_id, sr FROM f WHERE sr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic_id, source_id ORDER BY round_even(sr * 100, 0) DESC, article_id DESC) = 1),
fr AS (SELECT topic_id, source_id, l, c, r FROM f WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic_id, source_id ORDER BY published_at NULLS LAST, article_id DESC) = 1)
SELECT topic_id, source_id, CAST(round_even(sr * 100, 0) AS BIGINT) AS subjectivity_pct, CAST(round_even(l * 100, 0) AS BIGINT) AS left_pct, CAST(round_even(c * 100, 0) AS BIGINT) AS center_pct, CAST(round_even(r * 100, 0) AS BIGINT) AS right_pct
FROM tone FULL JOIN fr USING (topic_id, source_id)""")
def source_summary_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of several articles of a source on a topic the most subjective gives the tone and the oldest the framing: the last in each listing's order."""
    a = articles(spark, d, "source_id", "published_at", "is_wire_content").where("not is_wire_content")
    an = table(spark, d, "article_analysis").where("status = 'complete'").withColumnRenamed("article_id", "id")
    f = clusters(spark, d).select("topic_id", F.col("article_id").alias("id")).join(a, "id").join(an, "id")
    pct = scoring.pct(F.col("subjectivity_ratio"))
    tone = topics.last_wins(f.where("subjectivity_ratio is not null"), ["topic_id", "source_id"], [pct.asc(), F.asc("id")])
    framing = topics.last_wins(f.where("leaning_left is not null"), ["topic_id", "source_id"], [F.desc_nulls_first("published_at"), F.asc("id")])
    sides = [scoring.pct(F.col(f"leaning_{s}")).alias(f"{s}_pct") for s in ("left", "center", "right")]
    return tone.select("topic_id", "source_id", pct.alias("subjectivity_pct")).join(framing.select("topic_id", "source_id", *sides), ["topic_id", "source_id"], "full")


@query(f"""WITH {JUD}, {_CNT}, c AS (SELECT pool_id, 'S' || (article_id % 5) AS source, arg_min(CAST(round_even((s + 0.5 * p) / t * 100, 0) AS BIGINT), [(s + 0.5 * p) / t, article_id]) AS pct FROM cnt GROUP BY 1, 2)
SELECT pool_id, source, pct, CAST(round_even(pct - avg(pct) OVER w, 4) AS DOUBLE) AS delta, CASE WHEN abs(pct - avg(pct) OVER w) < 1 THEN 'neutral' WHEN pct > avg(pct) OVER w THEN 'positive' ELSE 'negative' END AS side FROM c WINDOW w AS (PARTITION BY pool_id)""")
def preferred_source_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each source's coverage against the mean of its pool; of several articles the one of lowest coverage counts."""
    counts = scores.judgment_counts(judgments(spark, d), ["pool_id", "article_id"])
    share = scoring.ratio(F.col("support") + 0.5 * F.col("partial"), F.col("total"))
    rows = counts.withColumn("source", F.concat(F.lit("S"), (F.col("article_id") % 5).cast("string"))).groupBy("pool_id", "source").agg(F.min_by(scoring.pct(share), F.struct(share, "article_id")).alias("pct"))
    means = rows.groupBy("pool_id").agg(F.avg("pct").alias("mean"))
    delta = F.col("pct") - F.col("mean")
    side = F.when(F.abs(delta) < 1, "neutral").when(delta > 0, "positive").otherwise("negative")
    return rows.join(means, "pool_id").select("pool_id", "source", "pct", F.bround(delta, 4).alias("delta"), side.alias("side"))


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z::DOUBLE))))"


@query(f"""WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, a AS vec_a, b AS vec_b, CAST(round_even(c, 5) AS DOUBLE) AS similarity FROM p WHERE c >= 0.3""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All similar pairs within a pool: every pair of a pool is compared, as the pool's matrix is the feature.

    Each pool's vectors are compared block by block in numpy (grouped by pool and block of rows), so no task holds more
    than two blocks of about 10,000 rows and no pair row is built for a pair that fails.
    """
    e = table(spark, d, "embeddings")
    most = e.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return _blocked_pairs(e, 0.3, max(1, -(-most // 10_000)))


def _blocked_pairs(df: DataFrame, threshold: float, blocks: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    rows = df.select("label", "vec_id", "embedding", block.alias("block")).where("label is not null and vec_id is not null and embedding is not null")
    # each row goes to the pairs of blocks that hold its block
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = pairs.select("label", "vec_id", "embedding", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        u = np.array([np.asarray(v, np.float64) for v in left["embedding"]]).reshape(len(left), -1)
        v = np.array([np.asarray(w, np.float64) for w in right["embedding"]]).reshape(len(right), -1)
        if not len(u) or not len(v):
            return pd.DataFrame({"label": [], "vec_a": [], "vec_b": [], "similarity": []})
        norms = np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        sims = np.divide(u @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
        i, j = np.nonzero(sims >= threshold)
        a, b = left["vec_id"].to_numpy()[i], right["vec_id"].to_numpy()[j]
        keep = (a < b) if x == y else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], sims[i, j][keep]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "vec_a": np.minimum(a, b), "vec_b": np.maximum(a, b), "similarity": s})

    found = keyed.groupBy("label", "x", "y").applyInPandas(compare, "label int, vec_a bigint, vec_b bigint, similarity double")
    return found.select("label", "vec_a", "vec_b", F.bround("similarity", 5).alias("similarity"))


@query(f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT a AS query_id, b AS vec_id, CAST(round_even(c, 5) AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM p QUALIFY place <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of each query; queries are the rows whose id is divisible by 100, against all rows.

    Queries go out in broadcast blocks of bounded size; each task keeps the best five per query, the best of those are kept at the end.
    """
    import numpy as np
    import pyarrow as pa

    e = table(spark, d, "embeddings").select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    wanted = e.where(F.col("vec_id") % 100 == 0)
    blocks = max(1, -(-wanted.count() // 20_000))
    out = None
    for n in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()
        ids = np.array([r[0] for r in rows], np.int64)
        vectors = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        shared = spark.sparkContext.broadcast((ids, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)))

        def nearest(batches, shared=shared):
            q, x = shared.value
            best: list = []
            for b in batches:
                b = b.sort_by("vec_id")  # the stable order below leaves equal similarities by vec_id
                own = b.column(0).to_numpy()
                v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(own), -1)
                if not len(own) or not len(q):
                    continue
                sims = x @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                sims[q[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :16]
                best.append((np.repeat(q, top.shape[1]), own[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel()))
            if best:
                a, b_, s = (np.concatenate(z) for z in zip(*best))
                keep = np.isfinite(s)
                yield pa.record_batch([pa.array(a[keep]), pa.array(b_[keep]), pa.array(s[keep])], ["query_id", "vec_id", "similarity"])

        part = e.mapInArrow(nearest, "query_id bigint, vec_id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    ranked = topics.top_per_group(out, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], 5, "place")
    return ranked.select("query_id", "vec_id", F.bround("similarity", 5).alias("similarity"), F.col("place").cast("long").alias("place"))


@query()
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent, so without SQL; tests hold it against closed cases."""
    e = table(spark, d, "embeddings").withColumn("source", F.col("vec_id") % 5)
    return cluster.greedy_clusters(e, "label", "vec_id", "embedding", "source", 0.3)


@query()
def optimal_match(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with even ids as extracted, odd ones as true; without SQL, tests compare with exhaustive search."""
    e = table(spark, d, "embeddings")
    return cluster.optimal_match(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "vec_id", "embedding", 0.2)


@query()
def semantic_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of an optimal matching over all pools, micro-averaged."""
    return scores.micro_f1(scores.match_counts(optimal_match(spark, d), "label"))
