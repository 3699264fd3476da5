"""Ranking, metric, interval, fusion and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, fusion, guards, metrics, reports
from ..registry import RESAMPLES, SLICES
from ..sources import sinks
from . import base
from .base import ARTICLES, BY_PRICE, LOG, POPULARITY, sql


def _ranked(s, d):
    return metrics.rank(base.popularity(base.basket_log(s, d)))


def _second(s, d):
    log = base.basket_log(s, d)
    return metrics.rank(base.by_price(log, base.articles(s, d)))


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM popularity)"
RANKED2 = "ranked2 AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM by_price)"


def _per(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT impression_id, count(*) AS n, sum(label)::BIGINT AS n_clicked,
         CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1 THEN (sum(ar * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END AS auc,
         CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1 THEN 1.0 / min(rank) FILTER (label = 1) END::DOUBLE AS mrr,
         CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1 THEN sum(CASE WHEN rank <= 5 THEN label / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(sum(label), 5)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END AS ndcg5,
         CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1 THEN sum(CASE WHEN rank <= 10 THEN label / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(sum(label), 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END AS ndcg10,
         sum(label) = 0 AS no_positive, sum(label) = count(*) AS all_positive,
         sum(label) BETWEEN 1 AND count(*) - 1 AND min(score) = max(score) AS all_tied
  FROM (SELECT *, rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / 2.0 AS ar FROM {source})
  GROUP BY impression_id
)"""


PER = _per("per", "ranked")
FACTS = """
f0 AS (SELECT article_id, count(*) AS exposures, sum(label)::BIGINT AS clicks FROM log GROUP BY 1),
facts AS (
  SELECT article_id, exposures, clicks, -log2((clicks + 1) / (sum(clicks) OVER () + count(*) OVER ())) AS novelty,
         (row_number() OVER (ORDER BY exposures DESC, article_id) <= greatest(1, round_even(0.2 * count(*) OVER (), 0)))::INT AS is_head
  FROM f0
)"""
DIVERSITY = """
div AS (
  SELECT impression_id, CASE WHEN sum(c) > 1 THEN 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) END AS diversity FROM (
    SELECT impression_id, category, count(*) AS c FROM ranked LEFT JOIN articles USING (article_id) WHERE rank <= 10 GROUP BY 1, 2
  ) GROUP BY 1
)"""
NOVELTY = "nov AS (SELECT impression_id, avg(novelty) AS novelty FROM ranked LEFT JOIN facts USING (article_id) WHERE rank <= 10 GROUP BY 1)"
HEAD = "hs AS (SELECT impression_id, avg(is_head) FILTER (label = 1) AS head_share FROM log LEFT JOIN facts USING (article_id) GROUP BY 1)"


def rank_candidates_by_score(s, d):
    return _ranked(s, d).select("impression_id", "article_id", "pos", "score", "rank")


def submission_lines(s, d):
    return sinks.submission_lines(_ranked(s, d))


def rank_guard(s, d):
    """Ranks of which some have been set wrong: a second first place in every fiftieth impression that has two candidates."""
    wrong = (F.col("impression_id") % 50 == 3) & (F.col("rank") == 2)
    return sinks.check_ranks(_ranked(s, d).withColumn("rank", F.when(wrong, 1).otherwise(F.col("rank"))))


def unpaired_guard(s, d):
    """Candidates that only one of two rankings has, some of them planted."""
    first, second = _ranked(s, d), _second(s, d)
    return guards.unpaired(first.where("impression_id % 13 <> 4"), second.where("impression_id % 17 <> 9"), ("impression_id", "article_id", "pos"))


def auc_per_impression(s, d):
    return metrics.per_impression(_ranked(s, d)).select("impression_id", F.round("auc", 9).alias("auc"))


def mrr_ndcg(s, d):
    return metrics.per_impression(_ranked(s, d)).select("impression_id", *[F.round(c, 9).alias(c) for c in ("mrr", "ndcg5", "ndcg10")])


def degenerate_counts(s, d):
    m = metrics.per_impression(_ranked(s, d))
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("no_positive", "all_positive", "all_tied")])


def recall_at_k(s, d):
    r = metrics.recall_at(_ranked(s, d), (1, 2, 5, 10))
    return r.select("depth", F.round("recall", 9).alias("recall"), "n_scored", "n_no_positive")


def diversity(s, d):
    r = _ranked(s, d).join(base.articles(s, d).select("article_id", "category"), "article_id", "left")
    return metrics.diversity(r).select("impression_id", F.round("diversity", 9).alias("diversity"))


def novelty(s, d):
    return metrics.list_novelty(_ranked(s, d), metrics.article_facts(base.basket_log(s, d))).select("impression_id", F.round("novelty", 9).alias("novelty"))


def head_tail(s, d):
    f = metrics.article_facts(base.basket_log(s, d))
    return f.select("article_id", "exposures", "clicks", F.round("novelty", 9).alias("novelty"), "is_head")


def coverage(s, d):
    n = base.articles(s, d).agg(F.count(F.lit(1)).alias("catalogue"))
    c = metrics.coverage(_ranked(s, d).where("rank <= 3"), F.lit(1.0), 3).join(F.broadcast(n))  # one row
    return c.select("n_shown", F.round(F.col("n_shown") / F.col("catalogue"), 9).alias("coverage"))


def _metrics(s, d):
    log, ranked = base.basket_log(s, d), _ranked(s, d)
    facts = metrics.article_facts(log)
    m = metrics.per_impression(ranked)
    m = m.join(metrics.diversity(ranked.join(base.articles(s, d).select("article_id", "category"), "article_id", "left")), "impression_id", "left")
    m = m.join(metrics.list_novelty(ranked, facts), "impression_id", "left").join(metrics.head_share(log, facts), "impression_id", "left")
    return m.withColumn("n_clicks", F.col("n_clicked"))


def metric_report_sliced(s, d):
    r = metrics.sliced_report(_metrics(s, d))
    return r.select("slice", "metric", "population", "n", F.round("value", 7).alias("value"))


def bootstrap_ci(s, d):
    r = bootstrap.interval(metrics.per_impression(_ranked(s, d)), "auc", resamples=RESAMPLES)
    return r.select("n", *[F.round(c, 7).alias(c) for c in ("mean", "lo", "hi")])


def paired_delta_ci(s, d):
    r = bootstrap.paired_delta(metrics.per_impression(_ranked(s, d)), metrics.per_impression(_second(s, d)), "ndcg10", resamples=RESAMPLES)
    return r.select("n", *[F.round(c, 7).alias(c) for c in ("mean", "lo", "hi")])


def fuse_rrf(s, d):
    r = fusion.reciprocal_rank(_ranked(s, d), _second(s, d))
    return r.select("impression_id", "article_id", F.round("score", 9).alias("score"), "rank")


def fuse_linear(s, d):
    r = fusion.linear(_ranked(s, d), _second(s, d), 0.3)
    return r.select("impression_id", "article_id", F.round("score", 9).alias("score"), "rank")


def cut_outside_k(s, d):
    two = _second(s, d).select("impression_id", "article_id", "pos", F.col("rank").alias("stage_rank"))
    r = fusion.cut_outside(_ranked(s, d).join(two, ["impression_id", "article_id", "pos"]), 2)
    return r.select("impression_id", "article_id", "pos", "stage_rank", "score")


def compare_retrievers(s, d):
    """Mean metrics of both retrievers by slice of list length, as report rows side by side."""
    rows = []
    for ranked in (_ranked(s, d), _second(s, d)):
        m = metrics.per_impression(ranked).withColumn("slice", F.when(F.col("n") > 4, "long").otherwise("short"))
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("auc", "mrr", "ndcg10")]))
        g = m.select("slice", long.alias("y")).groupBy("slice", F.col("y.metric").alias("metric")).agg(F.avg("y.x").alias("value"), F.stddev_samp("y.x").alias("sd"), F.count("y.x").alias("c"))
        half = 1.96 * F.col("sd") / F.sqrt(F.col("c"))
        rows.append(g.select("slice", "metric", "value", (F.col("value") - half).alias("lo"), (F.col("value") + half).alias("hi")))
    r = reports.compare(*rows)
    return r.select("slice", "metric", *[F.round(c, 8).alias(c) for c in ("first_value", "second_value", "gap")], "leader", "disjoint")


def ledger_latest(s, d):
    """The newest order of every customer and status: an upsert ledger's current state."""
    o = base.table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return sinks.latest(o, ["o_custkey", "o_orderstatus"], "o_orderkey")


def serving_cost(s, d):
    r = base.table(s, d, "supplier").select(F.col("s_name").alias("variant"), (F.col("s_suppkey") % 8 + 1).alias("cores"), (F.abs("s_acctbal") / 100).alias("p50_ms"), (F.abs("s_acctbal") / 50).alias("p99_ms"), (F.col("s_suppkey") % 90 + 10).alias("queries_per_second"))
    c = reports.serving_cost(r)
    return c.select("variant", F.round("usd_per_1k", 12).alias("usd_per_1k"), "within_budget", F.round("usd_per_10k", 11).alias("usd_per_10k"), "cores_at_10x")


def latency_percentiles(s, d):
    r = reports.percentiles(base.table(s, d, "events"), "value", "event_type")
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def curve_axis(s, d):
    r = base.table(s, d, "part").select(F.concat_ws("@", "p_brand", F.col("p_size").cast("string")).alias("variant"), "p_partkey")
    return reports.curve_axis(r).select("p_partkey", "variant", "axis")


def best_cells(s, d):
    """The dearest part of every type: an argmax over a grid's cells."""
    p = base.table(s, d, "part").select("p_type", "p_partkey", "p_retailprice")
    return reports.best_cell(p, "p_type", "p_retailprice").where("best").select("p_type", "p_partkey", "p_retailprice")


def negative_samples(s, d):
    from ..operators.models import negative_samples as sample

    return sample(base.basket_log(s, d), 2).select("impression_id", "positive", "negative", "slot")


def _boot(source: str) -> str:
    cdf = "".join(f" WHEN u < {c!r} THEN {k}" for k, c in enumerate(bootstrap._CDF))
    return f"""
w AS (
  SELECT r, m, CASE{cdf} ELSE {len(bootstrap._CDF)} END AS w FROM (
    SELECT r, m, ('0x' || substr(md5(r || ':' || impression_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {source}, range({RESAMPLES}) t(r) WHERE m IS NOT NULL
  )
), means AS (SELECT r, sum(w * m) / sum(w)::DOUBLE AS m FROM w GROUP BY r)
SELECT (SELECT count(m) FROM {source}) AS n, round((SELECT avg(m) FROM {source}), 7) AS mean, round(quantile_cont(m, 0.025), 7) AS lo, round(quantile_cont(m, 0.975), 7) AS hi FROM means"""


def _fuse(score: str) -> str:
    return f"""
two AS (
  SELECT impression_id, article_id, pos, a.score AS s1, b.score AS s2 FROM ranked a JOIN ranked2 b USING (impression_id, article_id, pos)
), sp AS (
  SELECT *, (max(s1) OVER w > min(s1) OVER w)::INT AS k1, (max(s2) OVER w > min(s2) OVER w)::INT AS k2,
         row_number() OVER (PARTITION BY impression_id ORDER BY s1 DESC, pos) AS r1, row_number() OVER (PARTITION BY impression_id ORDER BY s2 DESC, pos) AS r2,
         coalesce((s1 - min(s1) OVER w) / nullif(max(s1) OVER w - min(s1) OVER w, 0), 0) AS n1, coalesce((s2 - min(s2) OVER w) / nullif(max(s2) OVER w - min(s2) OVER w, 0), 0) AS n2
  FROM two WINDOW w AS (PARTITION BY impression_id)
), fu AS (SELECT *, {score} AS score FROM sp)
SELECT impression_id, article_id, round(score, 9) AS score, row_number() OVER (PARTITION BY impression_id ORDER BY round(score, 9) DESC, r1) AS rank FROM fu"""


_SLICE_SQL = {"overall": "true", "cold": "n_clicks < 5", "warm": "n_clicks >= 5", "head": "head_share = 1", "tail": "head_share = 0"}
assert list(_SLICE_SQL) == list(SLICES)
_BASE = (LOG, POPULARITY, RANKED)
_TWO = (LOG, ARTICLES, POPULARITY, BY_PRICE, RANKED, RANKED2)
_SIDE = """SELECT slice, metric, avg(x) AS value, 1.96 * stddev_samp(x) / sqrt(count(x)) AS half FROM (
    SELECT CASE WHEN n > 4 THEN 'long' ELSE 'short' END AS slice, unnest(['auc', 'mrr', 'ndcg10']) AS metric, unnest([auc, mrr, ndcg10]) AS x FROM {}) GROUP BY 1, 2"""

QUERIES = {
    "rank_candidates_by_score": (rank_candidates_by_score, sql(*_BASE, body="SELECT impression_id, article_id, pos, score, rank FROM ranked")),
    "submission_lines": (submission_lines, sql(*_BASE, body="SELECT impression_id, impression_id || ' [' || string_agg(rank::VARCHAR, ',' ORDER BY pos) || ']' AS line FROM ranked GROUP BY 1")),
    "rank_guard": (rank_guard, sql(*_BASE, "planted AS (SELECT impression_id, CASE WHEN impression_id % 50 = 3 AND rank = 2 THEN 1 ELSE rank END AS rank FROM ranked)", body="SELECT impression_id, count(*) AS n, count(DISTINCT rank) AS d, min(rank) AS lo, max(rank) AS hi FROM planted GROUP BY 1 HAVING count(DISTINCT rank) <> count(*) OR min(rank) <> 1 OR max(rank) <> count(*)")),
    "unpaired_guard": (
        unpaired_guard,
        sql(LOG, body="SELECT impression_id, article_id, pos, CASE WHEN impression_id % 13 = 4 THEN 'second' ELSE 'first' END AS only_in FROM log WHERE (impression_id % 13 = 4) <> (impression_id % 17 = 9)"),
    ),
    "auc_per_impression": (auc_per_impression, sql(*_BASE, PER, body="SELECT impression_id, round(auc, 9) AS auc FROM per")),
    "mrr_ndcg": (mrr_ndcg, sql(*_BASE, PER, body="SELECT impression_id, round(mrr, 9) AS mrr, round(ndcg5, 9) AS ndcg5, round(ndcg10, 9) AS ndcg10 FROM per")),
    "degenerate_counts": (degenerate_counts, sql(*_BASE, PER, body="SELECT count(*) AS n, count(*) FILTER (no_positive) AS no_positive, count(*) FILTER (all_positive) AS all_positive, count(*) FILTER (all_tied) AS all_tied FROM per")),
    "recall_at_k": (
        recall_at_k,
        sql(
            *_BASE,
            body="""SELECT depth, round(avg(r), 9) AS recall, count(*) AS n_scored, (SELECT count(DISTINCT impression_id) FROM log) - count(*) AS n_no_positive FROM (
  SELECT depth, impression_id, avg((rank <= depth)::INT) AS r FROM (SELECT impression_id, article_id, min(rank) AS rank FROM ranked WHERE label = 1 GROUP BY 1, 2), (SELECT unnest([1, 2, 5, 10])::INT AS depth) GROUP BY 1, 2
) GROUP BY depth""",
        ),
    ),
    "diversity": (diversity, sql(*_BASE, ARTICLES, DIVERSITY, body="SELECT impression_id, round(diversity, 9) AS diversity FROM div")),
    "novelty": (novelty, sql(*_BASE, FACTS, NOVELTY, body="SELECT impression_id, round(novelty, 9) AS novelty FROM nov")),
    "head_tail": (head_tail, sql(LOG, FACTS, body="SELECT article_id, exposures, clicks, round(novelty, 9) AS novelty, is_head FROM facts")),
    "coverage": (coverage, sql(*_BASE, body="SELECT count(DISTINCT article_id) AS n_shown, round(count(DISTINCT article_id) / (SELECT count(*) FROM part), 9) AS coverage FROM ranked WHERE rank <= 3")),
    "metric_report_sliced": (
        metric_report_sliced,
        sql(
            *_BASE,
            ARTICLES,
            PER,
            FACTS,
            DIVERSITY,
            NOVELTY,
            HEAD,
            "m AS (SELECT per.*, n_clicked AS n_clicks, diversity, novelty, head_share FROM per LEFT JOIN div USING (impression_id) LEFT JOIN nov USING (impression_id) LEFT JOIN hs USING (impression_id))",
            "sl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slice, * FROM m WHERE {v}" for k, v in _SLICE_SQL.items()) + ")",
            body="SELECT slice, metric, count(*) AS population, count(x) AS n, round(avg(x), 7) AS value FROM (SELECT slice, unnest(["
            + ", ".join(f"'{m}'" for m in metrics.METRICS)
            + "]) AS metric, unnest(["
            + ", ".join(metrics.METRICS)
            + "]) AS x FROM sl) GROUP BY 1, 2",
        ),
    ),
    "bootstrap_ci": (bootstrap_ci, sql(*_BASE, PER, "v AS (SELECT impression_id, auc AS m FROM per)", _boot("v").strip().split("\nSELECT")[0], body="SELECT" + _boot("v").split("\nSELECT")[1])),
    "paired_delta_ci": (
        paired_delta_ci,
        sql(*_TWO, PER, _per("per2", "ranked2"), "v AS (SELECT impression_id, b.ndcg10 - a.ndcg10 AS m FROM per a JOIN per2 b USING (impression_id))", _boot("v").strip().split("\nSELECT")[0], body="SELECT" + _boot("v").split("\nSELECT")[1]),
    ),
    "fuse_rrf": (fuse_rrf, sql(*_TWO, _fuse("k1 / (60.0 + r1) + k2 / (60.0 + r2)").strip().split("\nSELECT")[0], body="SELECT" + _fuse("").split("\nSELECT")[1])),
    "fuse_linear": (fuse_linear, sql(*_TWO, _fuse("coalesce((0.3 * k1 * n1 + 0.7 * k2 * n2) / nullif(0.3 * k1 + 0.7 * k2, 0), 0)").strip().split("\nSELECT")[0], body="SELECT" + _fuse("").split("\nSELECT")[1])),
    "cut_outside_k": (
        cut_outside_k,
        sql(
            *_TWO,
            body="""SELECT impression_id, article_id, pos, stage_rank, CASE WHEN stage_rank > 2 THEN min(score) OVER (PARTITION BY impression_id) - row_number() OVER (PARTITION BY impression_id, stage_rank > 2 ORDER BY stage_rank, pos) ELSE score END AS score
FROM (SELECT impression_id, article_id, pos, a.score, b.rank AS stage_rank FROM ranked a JOIN ranked2 b USING (impression_id, article_id, pos))""",
        ),
    ),
    "compare_retrievers": (
        compare_retrievers,
        sql(
            *_TWO,
            PER,
            _per("per2", "ranked2"),
            f"a AS ({_SIDE.format('per')})",
            f"b AS ({_SIDE.format('per2')})",
            body="""SELECT slice, metric, round(a.value, 8) AS first_value, round(b.value, 8) AS second_value, round(b.value - a.value, 8) AS gap,
  CASE WHEN b.value > a.value THEN 'second' WHEN b.value < a.value THEN 'first' ELSE 'tie' END AS leader, a.value + a.half < b.value - b.half OR b.value + b.half < a.value - a.half AS disjoint FROM a JOIN b USING (slice, metric)""",
        ),
    ),
    "ledger_latest": (ledger_latest, "SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1"),
    "serving_cost": (
        serving_cost,
        "SELECT s_name AS variant, round(c, 12) AS usd_per_1k, abs(s_acctbal) / 50 <= 100 AS within_budget, round(c * 10, 11) AS usd_per_10k, k * 10 AS cores_at_10x FROM (SELECT *, s_suppkey % 8 + 1 AS k, (s_suppkey % 8 + 1) * 0.0425::DOUBLE / 3600 / (s_suppkey % 90 + 10) * 1000 AS c FROM supplier)",
    ),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1"),
    "curve_axis": (curve_axis, "SELECT p_partkey, p_brand || '@' || p_size AS variant, p_size::BIGINT AS axis FROM part"),
    "best_cells": (best_cells, "SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY p_retailprice = max(p_retailprice) OVER (PARTITION BY p_type)"),
    "negative_samples": (
        negative_samples,
        sql(
            LOG,
            body="""SELECT impression_id, positive, negative, unnest(generate_series(f, 2, m))::INT AS slot FROM (
  SELECT p.impression_id, p.article_id AS positive, n.article_id AS negative, count(*) OVER (PARTITION BY p.impression_id, p.article_id) AS m,
         row_number() OVER (PARTITION BY p.impression_id, p.article_id ORDER BY md5('0:' || p.impression_id || ':' || p.article_id || ':' || n.article_id)) AS f
  FROM log p JOIN log n ON n.impression_id = p.impression_id AND p.label = 1 AND n.label = 0) WHERE f <= 2""",
        ),
    ),
}
