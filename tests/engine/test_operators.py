"""Hand-computed and metamorphic tests of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import registry
from rankweave.functions.columns import tail
from rankweave.operators import bootstrap, counters, features, fusion, metrics, models, split, vectors, weighting
from rankweave.sources import adapters, sinks

M = 60_000_000


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def counter_log(spark):
    data = [(0, "A", 1), (0, "B", 0), (10, "A", 0), (10, "C", 1), (10, "A", 1), (10, "B", 1), (200, "B", 0)]
    return spark.createDataFrame([(i, a, m * M, y) for i, (m, a, y) in enumerate(data)], "impression_id long, article_id string, us long, label int").withColumn("pos", F.lit(0))


def test_counters_are_strictly_before_and_peers_do_not_see_each_other(spark):
    c = counters.exposures_and_clicks(counter_log(spark), ["impression_id", "pos"], {"cumulative": None, "1h": 1})
    got = {r.impression_id: (r.exposures_cumulative, r.clicks_cumulative, r.ctr_cumulative, r.exposures_1h) for r in c.collect()}
    assert got[0] == (0, 0, None, 0)
    assert got[2] == (1, 1, 1.0, 1) and got[4] == got[2]
    assert got[3] == (0, 0, None, 0)
    assert got[6] == (2, 1, 0.5, 0)


def test_counters_do_not_change_when_later_rows_go(spark):
    log = counter_log(spark)
    keep = ["impression_id", "pos"]
    full = counters.exposures_and_clicks(log, keep, {"cumulative": None}).where("impression_id < 6")
    cut = counters.exposures_and_clicks(log.where(F.col("us") < 200 * M), keep, {"cumulative": None})
    assert rows(full, "impression_id", "exposures_cumulative", "clicks_cumulative") == rows(cut, "impression_id", "exposures_cumulative", "clicks_cumulative")


def test_whole_log_dominates(spark):
    log = counter_log(spark)
    whole = {r.article_id: r.exposures for r in counters.whole_log(log).collect()}
    for r in counters.exposures_and_clicks(log, ["impression_id", "pos"], {"cumulative": None}).collect():
        assert whole[r.article_id] >= r.exposures_cumulative
    assert whole == {"A": 3, "B": 3, "C": 1}


def test_serving_counters_add_undated_clicks(spark):
    train = counter_log(spark)
    test = spark.createDataFrame([(9, "A", 300 * M), (9, "D", 300 * M)], "impression_id long, article_id string, us long")
    undated = spark.createDataFrame([("A",), ("D",), ("D",)], "article_id string")
    got = {r.article_id: (r.exposures, r.clicks) for r in counters.serving_counts(train, test, undated, ["impression_id"]).collect()}
    assert got == {"A": (4, 3), "D": (2, 2)}


def test_session_prior_is_null_without_session(spark):
    i = spark.createDataFrame([(1, "s", 1, 2), (2, "s", 5, 1), (3, None, 9, 1), (4, "s", 5, 1)], "impression_id long, session_id string, us long, clicks long")
    assert {r.impression_id: (r.session_impressions, r.session_clicks) for r in counters.session_prior(i).collect()} == {1: (0, 0), 2: (1, 2), 4: (1, 2), 3: (None, None)}


def test_metric_values(spark):
    r = spark.createDataFrame([(1, "a1", 0, 0, 2.0), (1, "a2", 1, 1, 3.0), (1, "a3", 2, 1, 1.0), (2, "a", 0, 0, 1.0), (2, "b", 1, 0, 2.0), (3, "a", 0, 1, 1.0), (4, "a", 0, 1, 5.0), (4, "b", 1, 0, 5.0)], "impression_id long, article_id string, pos int, label int, score double")
    got = {x.impression_id: x for x in metrics.per_impression(metrics.rank(r)).collect()}
    assert got[1].auc == 0.5 and got[1].mrr == 1.0 and got[1].ndcg10 == pytest.approx(0.91972, abs=1e-5)
    assert got[2].no_positive and got[2].auc is None and got[3].all_positive and got[3].mrr is None
    assert got[4].all_tied and got[4].auc == 0.5 and got[4].mrr == 1.0


def test_recall_and_diversity(spark):
    r = spark.createDataFrame([(1, "a3", 1, 1), (1, "a1", 2, 1), (1, "a9", 3, 0), (2, "a9", 1, 0), (2, "a5", 2, 1), (3, "a", 1, 0)], "impression_id long, article_id string, rank int, label int")
    got = {x.depth: (x.recall, x.n_scored, x.n_no_positive) for x in metrics.recall_at(r, (1, 2)).collect()}
    assert got == {1: (0.25, 2, 1), 2: (1.0, 2, 1)}
    for cats, want in (([0, 0, 1, 2], 5 / 6), ([0, 0, 0], 0), ([0, 1], 1), ([0], None), ([None, None], 0)):
        d = spark.createDataFrame([(1, i + 1, None if c is None else str(c)) for i, c in enumerate(cats)], "impression_id long, rank int, category string")
        got = metrics.diversity(d).first().diversity
        assert got is None if want is None else got == pytest.approx(want)


def test_split_boundaries_are_right_closed(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(["2020-01-01 05:00:00", "2020-01-02 00:00:00", "2020-01-03 00:00:01", "2020-01-04 10:00:00"])], "impression_id int, t string").withColumn("impression_time", F.to_timestamp_ntz("t"))
    got = {r.impression_id: r.split for r in split.assign(t, registry.Split(1, 1, 1)).collect()}
    assert got == {0: "train", 1: "train", 2: "validation", 3: "test"}
    assert split.order_faults(split.assign(t, registry.Split(1, 1, 1))).count() == 0
    bad = t.withColumn("split", F.when(F.col("impression_id") == 3, "train").otherwise("tune"))
    assert split.order_faults(bad).count() == 1


def test_window_weights(spark):
    i = spark.createDataFrame([(1, 7, 100)], "impression_id long, user_id long, us long")
    c = spark.createDataFrame([(7, "x", 10, 1, 3.0, None), (7, "y", 20, 2, None, 50.0), (7, "z", 100, 3, 1.0, 1.0)], "user_id long, article_id string, us long, seq long, read_time double, scroll double")
    w = weighting.last_clicks(i, c, 2)
    assert rows(w, "article_id", "age", "n_clicks") == [("x", 1, 2), ("y", 0, 2)]
    p = {r.article_id: r.w for r in w.select("article_id", weighting.weight("position", 0.5).alias("w")).collect()}
    assert p == {"x": 0.5, "y": 1.0}
    e = {r.article_id: r.w for r in w.select("article_id", weighting.weight("engagement").alias("w")).collect()}
    assert e["x"] == pytest.approx(math.log(4)) and e["y"] == 0
    with pytest.raises(ValueError):
        weighting.weight("nonsense")


def test_fusion_ties_and_flat_parents(spark):
    mk = lambda s: spark.createDataFrame([(1, a, i, float(x)) for i, (a, x) in enumerate(s)], "impression_id long, article_id string, pos int, score double")
    a, b = mk([("a", 9), ("b", 5), ("c", 1)]), mk([("a", 1), ("b", 3), ("c", 2)])
    order = lambda df: [r.article_id for r in df.orderBy("rank").collect()]
    assert order(fusion.reciprocal_rank(a, b)) == ["b", "a", "c"]
    flat = mk([("a", 4), ("b", 4), ("c", 4)])
    assert order(fusion.reciprocal_rank(flat, b)) == ["b", "c", "a"]
    assert order(fusion.linear(flat, flat)) == ["a", "b", "c"]


def test_cut_outside(spark):
    s = spark.createDataFrame([(1, i, x, r) for i, (x, r) in enumerate([(0.1, 1), (0.9, 3), (0.8, 2), (0.2, None)])], "impression_id long, pos int, score double, stage_rank int")
    got = {r.pos: r.score for r in fusion.cut_outside(s, 2).collect()}
    assert got[0] == 0.1 and got[2] == 0.8 and got[1] < 0.1 and got[3] < got[1]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "article_id long, vec array<double>")
    u = np.array([[1, 0], [0.6, 0.8], [0, 1]])
    want = (u @ u.T).sum() - 3
    assert vectors.anisotropy(v).first().anisotropy == pytest.approx(want / 6)
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, vec array<double>")
    assert [r.article_id for r in vectors.top_k(q, v, 2).orderBy("rank").collect()] == [1, 2]
    assert vectors.top_k(q.limit(0), v, 2).count() == 0
    centred = {r.article_id: r.vec for r in vectors.centre(v).collect()}
    assert centred[4] == [0.0, 0.0] and np.linalg.norm(centred[1]) == pytest.approx(1)
    white = {r.article_id: r.vec for r in vectors.correct(v, "abtt:1").collect()}
    assert len(white) == 4 and list(white[4]) == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.correct(v, "nonsense")


def test_bootstrap(spark):
    flat = spark.createDataFrame([(i, 0.7) for i in range(50)], "impression_id long, m double")
    r = bootstrap.interval(flat, "m", resamples=50).first()
    assert (r.n, r.lo, r.hi) == (50, pytest.approx(0.7), pytest.approx(0.7))
    mixed = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "impression_id long, m double")
    a, b = (bootstrap.interval(mixed, "m", resamples=100).first() for _ in range(2))
    assert a == b and a.lo < 0.5 < a.hi and a.hi - a.lo == pytest.approx(4 * 0.5 / 20, rel=0.5)


def test_bootstrap_weights_are_the_hashes(spark):
    keys = ["0", "17", "123456789", "", "\u00f8" * 20, "x" * 52, "x" * 53, "y" * 130]
    drawn = np.full((1203, len(keys)), -1.0)
    for r, at, weight in bootstrap.hash_weights(keys, len(drawn)):
        drawn[r, at] = weight
    rows = spark.createDataFrame([(r, i, k) for r in (0, 9, 10, 99, 100, 999, 1202) for i, k in enumerate(keys)], "r int, i int, k string")
    for x in rows.withColumn("w", bootstrap.poisson_weight(bootstrap.hash_uniform(F.col("r"), F.col("k")))).collect():
        assert drawn[x.r, x.i] == x.w


def test_bootstrap_makes_no_row_per_draw(spark):
    """The plan holds no row for each (resample, impression); groups and missing values are kept apart."""
    v = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else float(i % 3)) for i in range(60)], "impression_id long, g int, m double")
    df = bootstrap.interval(v, "m", resamples=30, by=("g",))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in df.collect()}
    for g in (0, 1):
        one = bootstrap.interval(v.where(f"g = {g}"), "m", resamples=30).first()
        assert (one.n, one.mean, one.lo, one.hi) == pytest.approx((got[g].n, got[g].mean, got[g].lo, got[g].hi)) and one.n == 24
    none = bootstrap.interval(v.where("m is null"), "m", resamples=30).first()
    assert (none.n, none.mean, none.lo, none.hi) == (0, None, None, None)


def test_features_schema_is_closed():
    features.check_columns(["impression_id", "label", "ann_score"])
    for bad in (["nonsense"], ["past_dwell", "past_dwell"], ["next_read_time"], ["x_label"]):
        with pytest.raises(ValueError):
            features.check_columns(bad)


def test_attention_learns_and_gradients_match():
    rng = np.random.default_rng(0)
    m = models.Attention(6, heads=2, size=3, query=4, seed=1)
    x, slate = rng.normal(size=(5, 6)), rng.normal(size=(4, 6))
    loss = lambda: -np.log(np.exp(m.score(x, slate) - m.score(x, slate).max())[0] / np.exp(m.score(x, slate) - m.score(x, slate).max()).sum())
    first = loss()
    for _ in range(60):
        m.step(x, slate, 0.01)
    assert loss() < first


def test_adapters(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "behaviors.tsv").write_text("1\tU1\t11/9/2019 9:05:00 AM\tN1 N2\tN3-1 N-4-0\n2\tU2\t11/9/2019 1:05:00 PM\t\tN3-0\n")
    src = registry.Source((str(tmp_path / "train" / "behaviors.tsv"),), "tsv", adapters.tsv_behaviors, adapters.TSV_BEHAVIORS)
    raw = adapters.read(spark, src)
    b = src.adapt(raw).orderBy("impression_id").collect()
    assert b[0].candidate_ids == ["N3", "N-4"] and b[0].labels == [1, 0] and b[1].impression_time.hour == 13
    assert b[0].impression_id.endswith("-1") and b[0].session_id is None
    h = {r.user_id: (r.click_history, r.n_clicks) for r in adapters.tsv_history(raw).collect()}
    assert h == {"U1": (["N1", "N2"], 2), "U2": ([], 0)}
    assert [f.name for f in adapters.tsv_behaviors(raw).schema] == [f.name for f in registry.BEHAVIORS]
    u = adapters.unlabelled(raw.withColumn("impressions", F.lit("N1 N2")))
    assert u.first().candidate_ids == ["N1", "N2"] and "labels" not in u.columns


def test_tail_of_short_arrays(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>").select(tail(F.col("a"), 2).alias("t"))
    assert [r.t for r in d.collect()] == [[2, 3], [1], []]


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 0, 1)], "impression_id long, pos int, rank int")
    lines = sinks.submission_lines(r)
    assert rows(lines, "impression_id", "line") == [(1, "1 [2,1]"), (2, "2 [1]")]
    assert sinks.check_ranks(r).count() == 0 and sinks.check_ranks(r.where("rank > 1")).count() == 1
    sinks.write_lines(lines, str(tmp_path / "out"))
    sinks.bundle(str(tmp_path / "out"), str(tmp_path / "p.zip"))
    import zipfile

    assert zipfile.ZipFile(tmp_path / "p.zip").read("prediction.txt").decode().splitlines() == ["1 [2,1]", "2 [1]"]
    led = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, seq int, v int")
    assert rows(sinks.latest(led, ["k"], "seq"), "k", "v") == [("a", 6), ("b", 7)]


def test_negative_samples_and_columns(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "c", 0), (1, "d", 0), (2, "e", 1)], "impression_id long, article_id string, label int")
    n = models.negative_samples(log, 2).collect()
    assert len(n) == 2 and {x.slot for x in n} == {1, 2} and all(x.positive == "a" for x in n)
    f = spark.createDataFrame([(1, 2, 3, 4)], "exposures_1h int, exposures_24h int, category_share int, clicks_24h int")
    assert models.feature_columns(f, ("content", "exposure"), ("24h",)) == ["category_share", "exposures_24h"]
