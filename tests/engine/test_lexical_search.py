import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import plans
from rankweave.operators import bm25, lexical_search

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words, size=r.integers(1, 30), p=np.arange(60, 0, -1) / 1830)) for _ in range(300)]
    rows = [(i, t if i % 7 else texts[0], t.split(" ")[0] + " W1  w2!" if i % 11 else "", f"s{i % 3}" if i % 13 else None) for i, t in enumerate(texts)]
    rows += [(300, "", "w1", "s0"), (301, None, None, "s1"), (302, " .. ", "unheard", "s1")]
    return spark.createDataFrame(rows, "article_id long, text string, title string, source string")


def parts(docs):
    queries = docs.where("article_id % 5 = 0 or article_id > 299").select(F.col("article_id").alias("query_id"), "title", "source")
    return queries, bm25.term_counts(queries, "query_id", "title"), bm25.term_counts(docs, "article_id", "text")


def test_search_is_the_join_on_terms(docs):
    queries, q, tf = parts(docs)
    cells = ((2.0, 0.9), (0.8, 0.5))
    got = sorted((r.cell, r.query_id, r["rank"], r.article_id, round(r.score, 10)) for r in lexical_search.top_k(queries, docs, 4, cells).collect())
    want = [(i, r.query_id, r["rank"], r.article_id, round(r.score, 10)) for i, (k1, b) in enumerate(cells) for r in bm25.top_k(q, bm25.postings(tf, docs, "article_id", k1, b), "query_id", "article_id", 4).collect()]
    assert got == sorted(want) and len(got) > 200
    assert lexical_search.top_k(queries.limit(0), docs, 4, cells).count() == 0


def test_groups_have_every_pair_once(docs):
    queries, q, tf = parts(docs)
    pairs = queries.join(docs.select("article_id", "source"), "source").select("query_id", "article_id")
    want = bm25.score_candidates(pairs, q, bm25.postings(tf, docs, "article_id", 2.0, 0.9), "query_id", "article_id")
    tidy = lambda df: sorted((r.query_id, r.article_id, round(r.score, 10)) for r in df.collect())
    assert tidy(lexical_search.score_groups(queries, docs, "source", 2.0, 0.9)) == tidy(want)


def test_postings_are_the_same(docs):
    _, _, tf = parts(docs)
    tidy = lambda df: sorted((r.term, r.article_id, round(r.weight, 12)) for r in df.collect())
    assert tidy(lexical_search.postings(docs, "article_id", "text", 2.0, 0.9)) == tidy(bm25.postings(tf, docs, "article_id", 2.0, 0.9))


@pytest.mark.parametrize("share", [0.0, 0.05, 2.0])
def test_scores_of_a_block(monkeypatch, share):
    monkeypatch.setattr(lexical_search, "DENSE_SHARE", share)
    monkeypatch.setattr(lexical_search, "PRODUCTS", 7)
    r = np.random.default_rng(1)
    a, b = r.integers(0, 3, (9, 20)) * (r.random((9, 20)) < 0.3), r.random((20, 11)) * (r.random((20, 11)) < 0.4)
    q, qt = np.nonzero(a)
    t, d = np.nonzero(b)
    assert lexical_search._scores(q, qt, a[q, qt].astype(float), 9, t, d, b[t, d], 11) == pytest.approx(a @ b)


@pytest.mark.parametrize("name", ["bm25_topk", "title_weighted_bm25", "bm25_param_grid", "bm25_candidates", "fuse_corpus_rrf"])
def test_no_pair_of_query_and_document_is_shuffled(spark, name):
    plan = plans.all_queries()[name][0](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Generate explode(filter" not in plan
