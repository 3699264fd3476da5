"""Click weights, user vectors, similarity scoring, vector search and geometry, feature-frame queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import features, metrics, vectors, weighting
from . import base
from .base import ARTICLES, CLICKS, IMPRESSIONS, LOG, VECTORS, WINDOW, sql

EVERY = 50


def _round(value, digits: int):
    """Rounded, with one zero: a tiny negative value would become minus zero."""
    return F.round(value, digits) + F.lit(0.0)


def _window(s, d):
    log = base.basket_log(s, d)
    return log, weighting.last_clicks(base.impressions(log), base.clicks(log))


def _weights(scheme, **kw):
    def run(s, d):
        w = _window(s, d)[1].withColumn("_w", weighting.weight(scheme, **kw))
        return w.select("impression_id", "article_id", "age", _round(weighting.normalised(F.col("_w")), 9).alias("weight"))

    return run


def user_vectors(s, d):
    """One row per dimension of the normalised mean of the clicked vectors."""
    u = vectors.user_vectors(_window(s, d)[1], base.vectors(s, d))
    return u.select("impression_id", F.posexplode("vec").alias("dim", "x")).select("impression_id", "dim", _round("x", 6).alias("x"))


def ann_candidates_mean(s, d):
    log, w = _window(s, d)
    r = vectors.score_by_user(log.select("impression_id", "article_id", "pos", "label"), vectors.user_vectors(w, base.vectors(s, d)), base.vectors(s, d))
    return r.select("impression_id", "article_id", _round("score", 6).alias("score"))


def _pooled(how):
    def run(s, d):
        log, w = _window(s, d)
        v = base.vectors(s, d)
        kept = w.join(v.select("article_id"), "article_id", "left_semi").withColumn("weight", weighting.normalised(weighting.weight("position"), by="max" if how == "max" else "sum"))
        r = vectors.pool(vectors.pooled_similarity(log, kept, v), how)
        return r.select("impression_id", "article_id", _round("score", 6).alias("score"))

    return run


def ann_topk(s, d):
    v = base.vectors(s, d)
    r = vectors.top_k(v.where(F.col("article_id") % EVERY == 0).select(F.col("article_id").alias("query_id"), "vec"), v, 10)
    return r.select("query_id", "article_id", _round("score", 6).alias("score"), "rank")


def centre_vectors(s, d):
    c = vectors.centre(base.vectors(s, d))
    return c.select("article_id", F.posexplode("vec").alias("dim", "x")).select("article_id", "dim", _round("x", 6).alias("x"))


def anisotropy(s, d):
    return vectors.anisotropy(base.vectors(s, d)).select("n", _round("anisotropy", 8).alias("anisotropy"))


def unit_norm_guard(s, d):
    return vectors.not_unit(base.vectors(s, d)).select("article_id", _round("norm", 5).alias("norm"))


def quantise_int8(s, d):
    return vectors.quantise(base.vectors(s, d)).select("article_id", F.col("d").alias("dim"), "code")


def quant_recall(s, d):
    """Overlap of the first ten by exact and by quantised vectors, per query."""
    v = base.vectors(s, d)
    back = vectors.quantise(v).groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "value"))), lambda x: x["value"]).alias("vec"))
    q = v.where(F.col("article_id") % EVERY == 0).select(F.col("article_id").alias("query_id"), "vec")
    a, b = vectors.top_k(q, v, 10), vectors.top_k(q, back, 10)
    j = a.select("query_id", "article_id").join(b.select("query_id", "article_id", F.lit(1).alias("hit")), ["query_id", "article_id"], "left")
    return j.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / 10).alias("recall"))


def ivf_topk(s, d):
    v = base.vectors(s, d)
    r = vectors.ivf_top_k(v.where(F.col("article_id") % EVERY == 0).select(F.col("article_id").alias("query_id"), "vec"), v, 10)
    return r.select("query_id", "article_id", "score", "rank")


def _corrected(method):
    def run(s, d):
        c = vectors.correct(base.vectors(s, d), method)
        return c.select("article_id", F.posexplode("vec").alias("dim", "x"))

    return run


def align_vectors(s, d):
    """Which articles have a vector: the catalogue's view of the vector table."""
    a = vectors.align(base.articles(s, d).select("article_id"), base.vectors(s, d))
    return a.select("article_id", F.col("vec").isNotNull().alias("has_vector"))


def category_share(s, d):
    log, w = _window(s, d)
    r = features.category_share(log, w, base.articles(s, d), "category", "category_share")
    return r.select("impression_id", "article_id", _round("category_share", 9).alias("category_share"))


def engagement_means(s, d):
    r = features.engagement_means(_window(s, d)[1])
    return r.select("impression_id", _round("past_dwell", 8).alias("past_dwell"), _round("past_depth", 8).alias("past_depth"))


_PROFILES = {k: features.PROFILES[k] for k in ("uniform", "pos90", "t24", "engagement")}


def cosine_profiles(s, d):
    log, w = _window(s, d)
    r = features.cosine_profiles(log, w, base.vectors(s, d), _PROFILES)
    return r.select("impression_id", "article_id", *[_round(c, 6).alias(c) for c in r.columns[2:]])


def feature_frame(s, d):
    """The frame's columns that SQL spells the same way."""
    log = base.stored_log(s, d)
    f = features.frame(log, base.clicks(log), base.articles(s, d), base.vectors(s, d), {"bm25": metrics.rank(base.popularity(log))})
    keep = ("impression_id", "article_id", "pos", "label", "n_candidates", "n_clicks", "exposures_cumulative", "clicks_cumulative", "exposures_24h", "session_impressions", "session_clicks", "bm25_score", "bm25_rank")
    doubles = ("ctr_cumulative", "category_share", "subcategory_share", "past_dwell", "past_depth", "freshness_hours", "hist_cos_mean_uniform", "hist_cos_last")
    return f.select(*keep, *[_round(c, 6).alias(c) for c in doubles])


_NORM = "OVER (PARTITION BY impression_id)"


def _weight_sql(w: str) -> str:
    return sql(
        LOG,
        IMPRESSIONS,
        CLICKS,
        WINDOW,
        body=f"SELECT impression_id, article_id, age, round(CASE WHEN sum(w) {_NORM} > 0 THEN w / sum(w) {_NORM} ELSE 1.0::DOUBLE / count(*) {_NORM} END, 9) AS weight FROM (SELECT *, {w} AS w FROM hist)",
    )


_TIME = "exp(-greatest(0, (us - click_us) / 3600000000.0::DOUBLE) / 24.0)"
_ENGAGE = "ln(1 + greatest(0, coalesce(read_time, 0))) * coalesce(scroll / 100, 1)"
_HV = "hv AS (SELECT h.*, vec FROM hist h JOIN vecs USING (article_id))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_CAND = "cand AS (SELECT DISTINCT impression_id, article_id, vec AS cv FROM log JOIN vecs USING (article_id))"


def _pooled_sql(how: str) -> str:
    norm = "max(pow(0.9::DOUBLE, age))" if how == "max" else "sum(pow(0.9::DOUBLE, age))"
    agg = {"mean": "sum(w * sim)", "max": "max(w * sim)", "last": "arg_min(sim, age)"}[how]
    return sql(
        LOG,
        IMPRESSIONS,
        CLICKS,
        WINDOW,
        VECTORS,
        _HV,
        _CAND,
        body=f"SELECT impression_id, article_id, round({agg}, 6) AS score FROM (SELECT c.impression_id, c.article_id, age, w, {_DOT.format(a='cv', b='vec')} AS sim FROM cand c JOIN (SELECT *, pow(0.9::DOUBLE, age) / {norm} {_NORM} AS w FROM hv) h USING (impression_id)) GROUP BY 1, 2",
    )


_USER = """
us0 AS (SELECT impression_id, unnest(range(64)) AS dim, unnest(vec) AS x FROM hv),
us1 AS (SELECT impression_id, dim, sum(x) AS x FROM us0 GROUP BY 1, 2),
us2 AS (SELECT impression_id, dim, CASE WHEN sum(x * x) OVER (PARTITION BY impression_id) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY impression_id)) ELSE x END AS x FROM us1)"""
_SHARE = """
{n} AS (
  SELECT l.impression_id, l.article_id, CASE WHEN t.n IS NOT NULL THEN coalesce(p.n, 0) / t.n::DOUBLE END AS {n}
  FROM log l LEFT JOIN articles a USING (article_id) LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) t ON t.impression_id = l.impression_id
  LEFT JOIN (SELECT impression_id, {c}, count(*) AS n FROM hist LEFT JOIN articles USING (article_id) GROUP BY 1, 2) p ON p.impression_id = l.impression_id AND p.{c} = a.{c}
)"""


def _profile_sql() -> str:
    schemes = {"uniform": "1.0::DOUBLE", "pos90": "pow(0.9::DOUBLE, age)", "t24": _TIME, "engagement": _ENGAGE}
    raw = ", ".join(f"{e} AS w_{p}" for p, e in schemes.items())
    norm = ", ".join(f"CASE WHEN sum(w_{p}) {_NORM} > 0 THEN w_{p} / sum(w_{p}) {_NORM} ELSE 1.0::DOUBLE / count(*) {_NORM} END AS s_{p}, CASE WHEN max(w_{p}) {_NORM} > 0 THEN w_{p} / max(w_{p}) {_NORM} ELSE 1.0 END AS m_{p}" for p in schemes)
    agg = ", ".join([f"round(sum(s_{p} * sim), 6) AS hist_cos_mean_{p}" for p in schemes] + [f"round(max(m_{p} * sim), 6) AS hist_cos_max_{p}" for p in schemes])
    return sql(
        LOG,
        IMPRESSIONS,
        CLICKS,
        WINDOW,
        VECTORS,
        _HV,
        _CAND,
        f"hw AS (SELECT *, {norm} FROM (SELECT *, {raw} FROM hv))",
        body=f"SELECT impression_id, article_id, {agg}, round(arg_min(sim, age), 6) AS hist_cos_last FROM (SELECT c.article_id, h.* EXCLUDE (article_id), {_DOT.format(a='cv', b='vec')} AS sim FROM cand c JOIN hw h USING (impression_id)) GROUP BY 1, 2",
    )


_FRAME = sql(
    LOG,
    ARTICLES,
    IMPRESSIONS,
    CLICKS,
    WINDOW,
    VECTORS,
    _HV,
    _CAND,
    _SHARE.format(n="category_share", c="category"),
    _SHARE.format(n="subcategory_share", c="subcategory"),
    """
cnt AS (
  SELECT *, count(*) OVER w AS ec, coalesce(sum(label) OVER w, 0)::BIGINT AS cc, count(*) OVER d AS e24, min(us) OVER w AS first_us, count(*) OVER (PARTITION BY impression_id) AS n_candidates
  FROM log WINDOW w AS (PARTITION BY article_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (PARTITION BY article_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)
), ses AS (
  SELECT impression_id, count(*) OVER w AS si, coalesce(sum(clicks) OVER w, 0)::BIGINT AS sc FROM impressions WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), eng AS (SELECT impression_id, max(n_clicks) AS n_clicks, avg(read_time) AS dwell, avg(scroll) AS depth FROM hist GROUP BY 1),
cosn AS (
  SELECT impression_id, article_id, avg(sim) AS mean, arg_min(sim, age) AS last FROM (SELECT c.impression_id, c.article_id, age, list_sum(list_transform(list_zip(cv, vec), lambda z: z[1] * z[2])) AS sim FROM cand c JOIN hv USING (impression_id)) GROUP BY 1, 2
)""",
    body="""SELECT c.impression_id, c.article_id, pos, label, n_candidates, coalesce(n_clicks, 0) AS n_clicks, ec AS exposures_cumulative, cc AS clicks_cumulative, e24 AS exposures_24h,
  si AS session_impressions, sc AS session_clicks, cc::DOUBLE AS bm25_score, row_number() OVER (PARTITION BY c.impression_id ORDER BY cc DESC, pos) AS bm25_rank,
  round(cc / nullif(ec, 0), 6) AS ctr_cumulative, round(category_share, 6) AS category_share, round(subcategory_share, 6) AS subcategory_share, round(dwell, 6) AS past_dwell, round(depth, 6) AS past_depth,
  round((us - first_us) / 3600000000.0::DOUBLE, 6) AS freshness_hours, round(mean, 6) AS hist_cos_mean_uniform, round(last, 6) AS hist_cos_last
FROM cnt c LEFT JOIN ses USING (impression_id) LEFT JOIN eng USING (impression_id) LEFT JOIN category_share x ON x.impression_id = c.impression_id AND x.article_id = c.article_id
LEFT JOIN subcategory_share y ON y.impression_id = c.impression_id AND y.article_id = c.article_id LEFT JOIN cosn z ON z.impression_id = c.impression_id AND z.article_id = c.article_id""",
)

QUERIES = {
    "click_weights_position": (_weights("position"), _weight_sql("pow(0.9::DOUBLE, age)")),
    "click_weights_time": (_weights("time", tau_hours=24.0), _weight_sql(_TIME)),
    "click_weights_engagement": (_weights("engagement"), _weight_sql(_ENGAGE)),
    "user_vectors": (user_vectors, sql(LOG, IMPRESSIONS, CLICKS, WINDOW, VECTORS, _HV, _USER, body="SELECT impression_id, dim::INT AS dim, round(x, 6) AS x FROM us2")),
    "ann_candidates_mean": (
        ann_candidates_mean,
        sql(
            LOG,
            IMPRESSIONS,
            CLICKS,
            WINDOW,
            VECTORS,
            _HV,
            _USER,
            body="""SELECT l.impression_id, l.article_id, round(coalesce(s, 0), 6) AS score FROM log l LEFT JOIN (
  SELECT c.impression_id, c.article_id, sum(c.x * u.x) AS s FROM (SELECT impression_id, article_id, unnest(range(64)) AS dim, unnest(vec) AS x FROM log JOIN vecs USING (article_id)) c JOIN us2 u USING (impression_id, dim) GROUP BY 1, 2
) USING (impression_id, article_id)""",
        ),
    ),
    "ann_candidates_pooled": (_pooled("mean"), _pooled_sql("mean")),
    "ann_candidates_max": (_pooled("max"), _pooled_sql("max")),
    "ann_candidates_last": (_pooled("last"), _pooled_sql("last")),
    "ann_topk": (
        ann_topk,
        sql(
            VECTORS,
            body=f"""SELECT query_id, article_id, round(score, 6) AS score, rank FROM (
  SELECT a.article_id AS query_id, b.article_id, {_DOT.format(a="a.vec", b="b.vec")} AS score, row_number() OVER (PARTITION BY a.article_id ORDER BY round({_DOT.format(a="a.vec", b="b.vec")}, 9) DESC, b.article_id) AS rank
  FROM vecs a, vecs b WHERE a.article_id % {EVERY} = 0) WHERE rank <= 10""",
        ),
    ),
    "centre_vectors": (
        centre_vectors,
        sql(
            VECTORS,
            """
fl AS (SELECT article_id, unnest(range(64)) AS dim, unnest(vec) AS x FROM vecs),
ce AS (SELECT article_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM fl)""",
            body="SELECT article_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY article_id)), 6) AS x FROM ce",
        ),
    ),
    "anisotropy": (
        anisotropy,
        sql(
            VECTORS,
            "fl AS (SELECT article_id, unnest(range(64)) AS dim, unnest(list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y))))) AS x FROM vecs)",
            body="SELECT n, round((ss - n) / (n * (n - 1.0)), 8) AS anisotropy FROM (SELECT sum(s * s) AS ss FROM (SELECT dim, sum(x) AS s FROM fl GROUP BY 1)), (SELECT count(*) AS n FROM vecs)",
        ),
    ),
    "unit_norm_guard": (unit_norm_guard, sql(VECTORS, body="SELECT article_id, round(n, 5) AS norm FROM (SELECT article_id, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS n FROM vecs) WHERE n > 0 AND abs(n - 1) > 1e-5")),
    "quantise_int8": (
        quantise_int8,
        sql(
            VECTORS,
            "fl AS (SELECT article_id, unnest(range(64)) AS dim, unnest(vec) AS x FROM vecs)",
            body="SELECT article_id, dim::INT AS dim, (round_even((x - min(x) OVER w) / ((max(x) OVER w - min(x) OVER w) / 255), 0) - 128)::INT AS code FROM fl WINDOW w AS (PARTITION BY dim)",
        ),
    ),
    "quant_recall": (quant_recall, None),
    "ivf_topk": (ivf_topk, None),
    "abtt": (_corrected("abtt:1"), None),
    "whiten": (_corrected("whiten"), None),
    "align_vectors": (align_vectors, "SELECT p_partkey AS article_id, p_partkey IN (SELECT vec_id FROM embeddings) AS has_vector FROM part"),
    "category_share": (category_share, sql(LOG, ARTICLES, IMPRESSIONS, CLICKS, WINDOW, _SHARE.format(n="category_share", c="category"), body="SELECT impression_id, article_id, round(category_share, 9) AS category_share FROM category_share")),
    "engagement_means": (engagement_means, sql(LOG, IMPRESSIONS, CLICKS, WINDOW, body="SELECT impression_id, round(avg(read_time), 8) AS past_dwell, round(avg(scroll), 8) AS past_depth FROM hist GROUP BY 1")),
    "cosine_profiles": (cosine_profiles, _profile_sql()),
    "feature_frame": (feature_frame, _FRAME),
}

# the same single zero in SQL
QUERIES = {k: (f, q and re.sub(r"(, \d\)) AS (?=\w)", r"\1 + 0 AS ", q)) for k, (f, q) in QUERIES.items()}
