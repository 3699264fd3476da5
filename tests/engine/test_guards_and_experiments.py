import pytest
from pyspark.sql import functions as F

from rankweave import registry
from rankweave.functions import text
from rankweave.operators import experiments, guards
from rankweave.sources import render


def test_guards(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "impression_id long, article_id string")
    assert guards.not_permutations(r, r).count() == 0
    assert guards.not_permutations(r.where("article_id = 'a'"), r).collect()[0].n_different == 1
    guards.require_empty(guards.outside_corpus(r, r), "outside")
    with pytest.raises(guards.GuardError):
        guards.require_empty(guards.outside_corpus(r, r.where("article_id = 'a'")), "outside")
    assert guards.duplicate_ids(r, "impression_id").count() == 1 and guards.duplicate_ids(r, "impression_id", 1).count() == 0
    b = spark.createDataFrame([(1, ["a", "b"], [1]), (2, ["a"], [0])], "impression_id long, candidate_ids array<string>, labels array<int>")
    assert [x.impression_id for x in guards.ragged(b).collect()] == [1]
    tsv, nested = registry.DATASETS["tsv_news"], registry.DATASETS["parquet_news"]
    guards.require_scheme(nested, "engagement", 80)
    for bad in (lambda: guards.require_scheme(tsv, "time", 80), lambda: guards.require_scheme(nested, "time", 101), lambda: guards.require_split("train"), lambda: guards.window_for("max", 80, lexical=True), lambda: guards.require_mean("max"), lambda: guards.require_agreement({"a": 1}, {"a": 2}, ("a",))):
        with pytest.raises(guards.GuardError):
            bad()
    assert guards.window_for("last", 80) == 1 and guards.window_for("mean", 80) == 80


def test_sweep_resumes(spark):
    ran = []

    def run(cell):
        ran.append(cell["k"])
        return spark.createDataFrame([(float(cell["k"]),)], "value double")

    first = experiments.sweep([{"k": 1}, {"k": 2}], run).cache()
    assert sorted(r.k for r in first.collect()) == [1, 2]
    more = experiments.sweep([{"k": 1}, {"k": 2}, {"k": 3}], run, first)
    assert ran == [1, 2, 3] and more.collect()[0].k == 3


def test_score_once_and_stages(spark, tmp_path):
    row = spark.createDataFrame([("s", "v", "test", 0.5)], "stage string, variant string, split string, value double")
    path = f"file://{tmp_path}/ledger"
    experiments.record_once(row, path)
    with pytest.raises(ValueError):
        experiments.record_once(row, path)
    experiments.record_once(row, path, force=True)
    assert spark.read.parquet(path).count() == 2
    calls = []
    stages = [("a", lambda d: (calls.append("a"), spark.range(3))[1]), ("b", lambda d: (calls.append("b"), d["a"].where("id > 0"))[1])]
    for _ in range(2):
        done = experiments.run_stages(spark, f"file://{tmp_path}/run", stages)
    assert calls == ["a", "b"] and done["b"].count() == 2


def test_text_functions(spark):
    d = spark.createDataFrame([("T ", " abs "), ("T", " "), (None, None)], "t string, a string").select(text.document_text(F.col("t"), F.col("a")).alias("x"))
    assert [r.x for r in d.collect()] == ["T. abs", "T", ""]
    s = spark.createDataFrame([("walking",), ("ing",), ("nation",)], "term string").select(text.strip_suffixes(("ing", "tion"), 2)(F.col("term")).alias("x"))
    assert [r.x for r in s.collect()] == ["walk", "ing", "na"]
    v = spark.createDataFrame([("Paris",), ("cat",)], "word string")
    t = spark.createDataFrame([("Paris",), ("Cat",), ("dog",)], "word string")
    assert sorted(r.word for r in text.known_words(t, v).collect()) == ["Paris", "cat"]


def test_rendering(spark):
    d = spark.createDataFrame([("a_b", 0.5, None)], "x string, y double, z double")
    assert render.markdown(d).splitlines()[2] == "| a_b | 0.5000 | - |"
    assert "a\\_b & 0.5000" in render.latex(d) and render.fixed_width(d).splitlines()[0] == "x    y       z"
    assert render.size(1536) == "1.5 kB" and render.duration(0.0123) == "12.3 ms" and render.duration(125) == "2 m 05 s"


def test_reports_are_refused_rather_than_cut(spark):
    from rankweave.sources import render

    with pytest.raises(ValueError):
        render.markdown(spark.range(4), most=3)
    assert len(render.markdown(spark.range(3), most=3).splitlines()) == 5


def test_fusion_refuses_parents_with_other_candidates(spark):
    from rankweave.operators import fusion, guards

    a = spark.createDataFrame([(1, 1, 0, 0.5), (1, 2, 1, 0.25)], "impression_id long, article_id long, pos int, score double")
    assert fusion.linear(a, a).count() == 2
    for first, second in ((a, a.where("pos = 0")), (a.where("pos = 0"), a)):
        with pytest.raises(Exception, match="no row for impression 1, article 2"):
            fusion.linear(first, second).collect()
        with pytest.raises(guards.GuardError):
            guards.require_paired(first, second, ("impression_id", "article_id"))
    guards.require_paired(a, a)


def test_later_half_by_days(spark):
    from rankweave.operators import split

    day = 86_400_000_000
    us = [0, 0, 5, day, day + 1, day + 1, day + 2, 3 * day]
    got = split.later_half(spark.createDataFrame([(i, t) for i, t in enumerate(us)], "i long, us long"), 0.5).collect()
    cut = sorted(us)[len(us) // 2]
    assert {r.i: r.later for r in got} == {i: t >= cut for i, t in enumerate(us)}
