"""Equal similarities leave the least vec_ids, in whatever order rows arrive."""

from newsloom.plans import scores as plans


def test_ties_beyond_a_batch_cut(spark, monkeypatch):
    ids = [100, *range(60, 0, -1)]
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "vec_id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(plans, "table", lambda s, d, name: rows)
    got = sorted((r["place"], r["vec_id"]) for r in plans.cosine_topk(spark, "").collect())
    assert got == [(n, n) for n in range(1, 6)]
