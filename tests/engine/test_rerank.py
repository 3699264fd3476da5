import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.functions.columns import half
from rankweave.operators import models, reports, vectors
from rankweave.operators.guards import GuardError
from rankweave.sources import sinks

RANKS = "impression_id long, article_id string, pos int, rank int"


def test_cut_moves_only_the_first_places(spark):
    first = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 2), (1, "c", 2, 3), (2, "a", 0, 1)], RANKS)
    second = spark.createDataFrame([(1, "c", 2, 1), (1, "b", 1, 2), (1, "a", 0, 3), (2, "a", 0, 1)], RANKS)
    order = lambda k: [r.article_id for r in models.cut(second, first, k).where("impression_id = 1").orderBy("rank").collect()]
    assert order(0) == ["a", "b", "c"] and order(2) == ["b", "a", "c"] and order(9) == ["c", "b", "a"]
    with pytest.raises(GuardError):
        models.cut(second.where("article_id <> 'b'"), first, 2)


def test_scores_never_double_the_frame(spark):
    frame = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "impression_id long, article_id string, pos int")
    scores = spark.createDataFrame([(1, "a", 0.5)], "impression_id long, article_id string, score double")
    assert {r.article_id: r.x for r in models.attach_scores(frame, scores, "x").collect()} == {"a": 0.5, "b": None}
    with pytest.raises(GuardError):
        models.attach_scores(frame, scores.union(scores), "x")


def test_sign_test(spark):
    rows = [("s%d" % i, "auc", "second") for i in range(8)] + [("s8", "auc", "first"), ("s9", "auc", "tie"), ("s", "mrr", "tie")]
    got = {r.metric: r for r in reports.verdicts(spark.createDataFrame(rows, "slice string, metric string, leader string")).collect()}
    assert (got["auc"].n_first, got["auc"].n_second) == (1, 8) and got["auc"].p_value == pytest.approx(2 * (1 + 9) / 2**9)
    assert got["auc"].reading == "second" and got["mrr"].p_value == 1 and got["mrr"].reading == "open"


def test_half_is_numpys(spark):
    r = np.random.default_rng(0)
    xs = [0.0, 1.0, -1.0, 2.0**-14, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 1 + 2.0**-11, 1 + 3 * 2.0**-11, 2048.5, 0.49999, 1 - 2.0**-12] + (r.normal(size=500) * 10.0 ** r.integers(-6, 4, 500)).tolist()
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for row in df.select("x", half(F.col("x")).alias("h")).collect():
        assert row.h == float(np.float16(row.x)), row


def test_danish_stems(spark):
    published = {
        "indtage": "indtag", "indtagelse": "indtag", "indtager": "indtag", "indtages": "indtag", "indtil": "indtil",
        "underste": "underst", "unders\u00f8ge": "unders\u00f8g", "unders\u00f8gelse": "unders\u00f8g", "unders\u00f8gelsen": "unders\u00f8g",
        "uundg\u00e5elig": "uundg\u00e5", "og": "og", "": "", "s": "s",
    }
    assert {w: text.danish_stem(w) for w in published} == published
    docs = spark.createDataFrame([(1, "Indtager indtages og indtil"), (2, None)], "doc_id long, text string")
    got = {r.term: r.tf for r in text.language_counts(docs, "doc_id", "text", "da").collect()}
    assert got["indtag"] == 2 and "og" not in got
    assert {r.term for r in text.language_counts(docs, "doc_id", "text", "en").collect()} == {"indtager", "indtages", "og", "indtil"}
    with pytest.raises(ValueError):
        text.language_rules("xx")


def test_time_ranges_are_apart(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_time_ranges(spark.range(20000).select((F.hash("id") % 100000).alias("us"), "id").repartition(4), path)
    got = spark.read.parquet(path)
    spans = sorted((r.lo, r.hi) for r in got.groupBy(F.input_file_name().alias("f")).agg(F.min("us").alias("lo"), F.max("us").alias("hi")).collect())
    assert got.count() == 20000 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_search_scores_are_rounded_once(spark):
    score = 0.1234564998  # 0.123456 to six places; 0.1234565 to nine, and that to six would be 0.123457
    v = spark.createDataFrame([(2, [score]), (1, [score - 1e-12]), (3, [0.1])], "article_id long, vec array<double>")
    q = spark.createDataFrame([(7, [1.0])], "query_id long, vec array<double>")
    got = vectors.top_k(q, v, 3).select("article_id", F.round("score", 6).alias("s"), "score").orderBy("rank").collect()
    assert [(r.article_id, r.s) for r in got] == [(1, 0.123456), (2, 0.123456), (3, 0.1)]  # equal to nine places: by id
    assert got[1].score == score


def test_best_keeps_no_more_than_its_rows():
    from rankweave.operators.best import Best

    r = np.random.default_rng(2)
    x, keys = np.round(r.random((6, 500)), 2), r.permutation(500)  # many ties
    best = Best(4, 6)
    for i in range(0, 500, 70):
        for lo in (0, 3):
            best.add(lo, x[lo : lo + 3, i : i + 70], keys[i : i + 70])
        assert sum(len(q) for q, *_ in best.rows()) <= 24
    got = {(q, k) for qs, ks, *_ in best.rows() for q, k in zip(qs.tolist(), ks.tolist())}
    assert got == {(q, int(keys[j])) for q in range(6) for j in np.lexsort((keys, -x[q]))[:4]}


def test_approximate_search_pairs_no_vectors(spark):
    """The plan joins no queries with cells; with one cell the search is exact."""
    r = np.random.default_rng(4)
    v = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(80)], "article_id long, vec array<double>")
    q = v.where("article_id % 8 = 0").withColumnRenamed("article_id", "query_id")
    df = vectors.ivf_top_k(q, v, 3, recall=1.0, sample=10)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.query_id, x.article_id): x.score for x in df.collect()}
    want = {(x.query_id, x.article_id): round(x.score, 9) for x in vectors.top_k(q, v, 3).collect()}
    assert got == pytest.approx(want)
    assert vectors.ivf_top_k(q.limit(0), v, 3).count() == 0
