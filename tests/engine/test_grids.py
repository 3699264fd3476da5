import pytest
from pyspark.sql import functions as F

from rankweave.operators import experiments, models, serving
from rankweave.registry import Bm25
from rankweave.sources import tables

LOG = "impression_id long, article_id string, pos int, label int"


def test_negatives_start_over_in_short_lists(spark):
    log = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 0), (2, "a", 0, 1), (3, "c", 0, 0)], LOG)
    assert [tuple(r) for r in models.negative_samples(log, 3).orderBy("slot").collect()] == [(1, "a", "b", i) for i in (1, 2, 3)]


def test_catalogue_negatives_are_different_and_never_the_click(spark):
    arts = spark.range(50).select(F.col("id").cast("string").alias("article_id"))
    assert sorted(r["index"] for r in models.dense_index(arts).collect()) == list(range(50))
    log = spark.createDataFrame([(i, str(i % 60), 0, 1) for i in range(200)], LOG)  # some clicks are not in the catalogue
    rows = models.catalogue_negatives(log, arts, 4).collect()
    assert len(rows) == 800 and all(r.negative != r.positive for r in rows)
    assert len({(r.impression_id, r.negative) for r in rows}) == 800
    assert len({r.negative for r in rows}) == 50
    few = models.catalogue_negatives(log.where("impression_id < 2"), arts.where("article_id in ('0', '1')"), 4).collect()
    assert sorted((r.positive, r.negative) for r in few) == [("0", "1")] * 4 + [("1", "0")] * 4
    assert models.catalogue_negatives(log.where("impression_id = 0"), arts.where("article_id = '0'"), 4).count() == 0


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([("a", "red cat", "one"), ("b", "red dog", None), ("c", "blue bird", "two")], "article_id string, title string, abstract string")


def test_requests_rank_by_either_retriever(spark, articles):
    r = serving.Ranker(spark, "lexical", {"articles": articles})
    got = r.rank(["a"], ["c", "b", "a"])
    assert [x for x, _ in got] == ["a", "b", "c"] and got[2][1] == 0 and set(r.timings) == {"request", "plan", "score", "answer"}
    assert r.rank([], ["c", "b"]) == [("c", 0.0), ("b", 0.0)] and r.rank(["a"], []) == []
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "article_id string, vec array<double>")
    assert [x for x, _ in serving.Ranker(spark, "semantic", {"vectors": vec}).rank(["c"], ["a", "b", "c"])] == ["c", "b", "a"]


def test_query_terms_come_from_titles_alone_if_asked(spark, articles):
    log = spark.createDataFrame([(1, "b", 0, 0), (1, "c", 1, 0)], LOG)
    window = spark.createDataFrame([(1, "c", 0)], "impression_id long, article_id string, age int")
    ctx = {"log": log, "window": window, "articles": articles}
    full, title = (dict((r.article_id, r.score) for r in experiments.lexical(ctx | {"bm25": Bm25(query_abstract=q)}).collect()) for q in (True, False))
    assert full["b"] == title["b"] == 0 and full["c"] > title["c"] > 0


def test_cells():
    assert len(experiments.profile_cells((10, 20), ("mean", "last"))) == 3
    assert len(experiments.correction_cells(("x", "y"))) == 12


def test_gap_of_a_method_to_itself_is_not_established(spark):
    log = spark.createDataFrame([(i, a, p, int(p == i % 2)) for i in range(20) for p, a in enumerate("ab")], LOG).withColumn("score", -F.col("pos").cast("double"))
    best = log.withColumn("score", F.col("label").cast("double"))
    rows = {r.arm: r for r in experiments.against(log, [("same", log), ("best", best)], resamples=50).collect()}
    assert not rows["same"].established and rows["same"].mean == 0 and rows["best"].established and rows["best"].mean == 0.5


def test_reads_of_stored_tables(spark, tmp_path, articles):
    path = f"file://{tmp_path}/f"
    spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7)], "impression_id long, article_id string, x double").write.parquet(path)
    keep = spark.createDataFrame([(2,)], "impression_id long")
    assert [tuple(r) for r in tables.read_features(spark, path, ["x"], keep).collect()] == [(0.7,)]
    with pytest.raises(ValueError):
        tables.read_features(spark, path, ["x", "nope"])
    assert tables.row_count(spark, path) == 2
    with pytest.raises(ValueError):
        tables.read_vectors(spark, path, "article_id")
    v = f"file://{tmp_path}/v"
    spark.createDataFrame([(7, [1.0, 2.0])], "id long, weird array<float>").write.parquet(v)
    assert [(r.article_id, r.vec) for r in tables.read_vectors(spark, v, "id").collect()] == [("7", [1.0, 2.0])]
