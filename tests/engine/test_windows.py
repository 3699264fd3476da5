import math

import pytest
from pyspark.sql import functions as F

from rankweave import plans
from rankweave.operators import vectors, weighting

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 2, 3, 5, 80])
def test_last_clicks_over_the_ends_of_lists(spark, k):
    clicks = spark.createDataFrame([(1, f"a{i}", i // 2, i) for i in range(23)] + [(2, "b", 5, 0)], "user_id long, article_id string, us long, seq long")
    asked = [(t, 1, t) for t in range(14)] + [(50, 2, 5), (51, 2, 6)]
    w = weighting.last_clicks(spark.createDataFrame(asked, "impression_id long, user_id long, us long"), clicks, k)
    got = sorted((r.impression_id, r.age, r.article_id, r.click_us, r.us, r.n_clicks) for r in w.collect())
    want = []
    for t in range(14):
        before = [i for i in range(23) if i // 2 < t]
        want += [(t, age, f"a{i}", i // 2, t, len(before)) for age, i in enumerate(reversed(before[-k:]))]
    assert got == sorted(want + [(51, 0, "b", 5, 6, 1)])


def test_user_vectors_make_no_row_per_dimension(spark):
    plan = plans.all_queries()["ann_candidates_mean"][0](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "sequence(" not in plan  # nor one per number of a window
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "article_id string, vec array<float>")
    c = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "z"), (3, "none")], "impression_id long, article_id string")
    got = {r.impression_id: r.vec for r in vectors.user_vectors(c, v, F.when(F.col("article_id") == "b", 2.0).otherwise(1.0)).collect()}
    assert got == {1: pytest.approx([0.6, 0.8]), 2: [0.0, 0.0]} and math.hypot(*got[1]) == pytest.approx(1)


def test_frame_repeats_no_window_per_feature(spark):
    """One list per impression serves all history features; the frame's cosines are those of the pairs."""
    from rankweave.operators import features
    from rankweave.plans import base

    log = base.basket_log(spark, D)
    arts, vecs, clicks = base.articles(spark, D), base.vectors(spark, D), base.clicks(log)
    f = features.frame(log, clicks, arts, vecs)
    assert f._jdf.queryExecution().optimizedPlan().toString().count("collect_list(struct(no") <= 2
    pairs = features.cosine_profiles(log, weighting.last_clicks(base.impressions(log), clicks), vecs)
    names = [c for c in pairs.columns if c.startswith("hist_cos")]
    key = lambda df: {(r.impression_id, r.article_id): [round(r[c], 9) for c in names] for r in df.collect()}
    want = key(pairs)
    assert want and key(f.where("hist_cos_last is not null").select("impression_id", "article_id", *names)) == want


def test_word_vectors_are_not_fitted_by_one_task(spark):
    from rankweave.functions import text

    docs = spark.createDataFrame([(i, ["red", "cat", f"w{i % 5}"]) for i in range(40)], "doc_id long, tokens array<string>")
    model, apply = text.word_vectors(docs, "tokens", 4)
    assert model.getOrDefault("numPartitions") > 1
    assert all(len(r.vec) == 4 for r in apply(docs).collect())
