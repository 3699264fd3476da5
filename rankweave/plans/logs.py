"""Ingest, split, guard and counter queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counters, guards, split, weighting
from ..registry import DATASETS, Split
from ..sources import adapters
from . import base
from .base import ARTICLES, CLICKS, IMPRESSIONS, LOG, WINDOW, sql

YEAR_H = 365 * 24


def impression_long(s, d):
    return base.basket_log(s, d)


def conformed_articles(s, d):
    a = base.articles(s, d)
    return a.select(F.col("article_id").cast("string").alias("article_id"), "title", F.lit(None).cast("string").alias("abstract"), "category", "subcategory", F.lit("parts").alias("dataset"))


def dedupe_articles(s, d):
    """First line item of every part, as a keep-first dedupe."""
    return adapters.keep_first(base.table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


def labels_from_clicks(s, d):
    """Candidate and clicked arrays to labels, back to rows."""
    log = base.basket_log(s, d)
    nested = log.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id"))).alias("c"), F.collect_set(F.when(F.col("label") == 1, F.col("article_id"))).alias("clicked"))
    labels = nested.select("impression_id", F.transform("c", lambda x: x["article_id"]).alias("ids"), "clicked").withColumn("labels", adapters.click_labels(F.col("ids"), F.col("clicked")))
    return labels.select("impression_id", F.posexplode(F.arrays_zip("ids", "labels")).alias("pos", "x")).select("impression_id", "pos", F.col("x.ids").alias("article_id"), F.col("x.labels").alias("label"))


def history_tail(s, d):
    """The last clicks of every user's whole history, in order."""
    c = base.clicks(base.basket_log(s, d))
    newest = Window.partitionBy("user_id").orderBy(F.col("us").desc(), F.col("seq").desc())  # a filter on it keeps five rows a user before the shuffle
    last = c.withColumn("back", F.row_number().over(newest)).where("back <= 5")
    n = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    return last.join(n, "user_id").select("user_id", "n_clicks", (F.least("n_clicks", F.lit(5)) - F.col("back")).cast("int").alias("place"), "article_id")


def history_view(s, d):
    log = base.basket_log(s, d)
    return weighting.last_clicks(base.impressions(log), base.clicks(log)).select("impression_id", "article_id", "age", "click_us", "n_clicks")


def repeat_candidates(s, d):
    log = base.basket_log(s, d)
    return split.repeated_exposure(log, base.clicks(log))


def dangling_refs(s, d):
    """Line items whose part has no vector, with multiplicity."""
    refs = base.table(s, d, "lineitem").select(F.col("l_partkey").alias("article_id"))
    return split.dangling(refs, base.vectors(s, d))


def future_click_guard(s, d):
    log = base.basket_log(s, d)
    published = log.groupBy("article_id").agg(F.min("us").alias("published_us"))
    return split.future_clicks(base.clicks(log).select("user_id", "article_id"), published, log)


def ragged_lists(s, d):
    """Impressions whose line numbers and parts disagree in number: what a ragged guard counts."""
    line = base.table(s, d, "lineitem")
    g = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_linenumber").alias("n_numbers"))
    return g.where("n_parts <> n_lines").select(F.col("l_orderkey").alias("impression_id"), "n_lines", "n_parts", "n_numbers")


def _orders(s, d):
    return base.table(s, d, "orders").select(F.col("o_orderkey").alias("impression_id"), F.col("o_orderdate").alias("impression_time"))


def temporal_split(s, d):
    return split.assign(_orders(s, d), DATASETS["parquet_news"].split).select("impression_id", "split")


def split_report(s, d):
    r = split.report(split.assign(_orders(s, d), Split(300, 200, 100)))
    return r.select("split", "n", F.round("share", 9).alias("share"), "first_time", "last_time")


def split_order_guard(s, d):
    """A split with rows planted on the wrong side: late ones in train, early ones in test."""
    rows = split.assign(_orders(s, d), Split(300, 200, 100))
    planted = F.when(F.col("impression_id") % 97 == 5, "train").when(F.col("impression_id") % 97 == 6, "test").otherwise(F.col("split"))
    return split.order_faults(rows.withColumn("split", planted))


def ragged_guard(s, d):
    """Nested candidates and labels of which some have lost a label."""
    log = base.basket_log(s, d)
    nested = log.groupBy("impression_id").agg(F.collect_list("article_id").alias("candidate_ids"), F.collect_list("label").alias("labels"))
    planted = nested.withColumn("labels", F.when(F.col("impression_id") % 11 == 3, F.slice("labels", 2, 1_000_000)).otherwise(F.col("labels")))
    return guards.ragged(planted).select("impression_id", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"))


def stack_halves(s, d):
    return split.later_half(base.impressions(base.basket_log(s, d)).select("impression_id", "us")).select("impression_id", "later")


def causal_counters(s, d):
    log = base.basket_log(s, d)
    c = counters.exposures_and_clicks(log.withColumn("at_us", F.col("us")), ["impression_id", "pos", "at_us"], {"cumulative": None})
    seen = counters.first_seen(log)
    c = c.join(seen, "article_id").withColumn("first_seen_us", F.when(F.col("first_us") < F.col("at_us"), F.col("first_us")))
    return c.select("impression_id", "article_id", F.col("exposures_cumulative").alias("exposures"), F.col("clicks_cumulative").alias("clicks"), F.round("ctr_cumulative", 9).alias("ctr"), "first_seen_us")


def sliding_counters_365d(s, d):
    c = counters.exposures_and_clicks(base.basket_log(s, d), ["impression_id", "pos"], {"365d": YEAR_H})
    return c.select("impression_id", "article_id", F.col("exposures_365d").alias("exposures"), F.col("clicks_365d").alias("clicks"), F.round("ctr_365d", 9).alias("ctr"))


def whole_log_counters(s, d):
    return counters.whole_log(base.basket_log(s, d))


def leaky_counters(s, d):
    return counters.leaky_sliding(base.basket_log(s, d), ["impression_id", "pos"], YEAR_H).select("impression_id", "article_id", "exposures", "clicks")


def first_seen_freshness(s, d):
    log = base.basket_log(s, d)
    j = log.join(counters.first_seen(log), "article_id")
    return j.select("impression_id", "article_id", F.round(F.when(F.col("first_us") < F.col("us"), (F.col("us") - F.col("first_us")) / 3.6e9), 6).alias("freshness_hours"))


def session_prior_activity(s, d):
    return counters.session_prior(base.impressions(base.basket_log(s, d)))


def serving_counters(s, d):
    """Orders of status O are the unlabelled test log; purchases in events are undated clicks."""
    log = base.basket_log(s, d)
    undated = base.table(s, d, "events").where("event_type = 'purchase'").select((F.get_json_object("props", "$.k").cast("long") + 1).alias("article_id"))
    r = counters.serving_counts(log.where("source <> 'O'"), log.where("source = 'O'"), undated, ["impression_id", "pos"])
    return r.select("impression_id", "article_id", "exposures", "clicks")


def event_rates(s, d):
    """Clicks and views per user and day from the event stream, with the first and last time."""
    e = base.table(s, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_W = "OVER (PARTITION BY article_id ORDER BY us RANGE BETWEEN {} PRECEDING AND {})"
_YEAR = YEAR_H * 3_600_000_000


def _assign(tune: int, validation: int, test: int) -> str:
    return f"""
b AS (SELECT date_trunc('day', max(o_orderdate)) + INTERVAL 1 DAY AS e FROM orders),
sp AS (
  SELECT o_orderkey AS impression_id, o_orderdate AS impression_time,
         CASE WHEN o_orderdate > e - INTERVAL {test} DAY THEN 'test' WHEN o_orderdate > e - INTERVAL {test + validation} DAY THEN 'validation'
              WHEN o_orderdate > e - INTERVAL {test + validation + tune} DAY THEN 'tune' ELSE 'train' END AS split
  FROM orders, b
)"""


QUERIES = {
    "impression_long": (impression_long, sql(LOG, body="SELECT * FROM log")),
    "conformed_articles": (conformed_articles, sql(ARTICLES, body="SELECT article_id::VARCHAR AS article_id, title, NULL::VARCHAR AS abstract, category, subcategory, 'parts' AS dataset FROM articles")),
    "dedupe_articles": (
        dedupe_articles,
        "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1",
    ),
    "labels_from_clicks": (labels_from_clicks, sql(LOG, body="SELECT impression_id, pos, article_id, label FROM log")),
    "history_tail": (
        history_tail,
        sql(
            LOG,
            CLICKS,
            body="""SELECT user_id, n_clicks, (place - greatest(n_clicks - 5, 0) - 1)::INT AS place, article_id FROM (
  SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS place, count(*) OVER (PARTITION BY user_id) AS n_clicks FROM clicks
) WHERE place > n_clicks - 5""",
        ),
    ),
    "history_view": (history_view, sql(LOG, IMPRESSIONS, CLICKS, WINDOW, body="SELECT impression_id, article_id, age, click_us, n_clicks FROM hist")),
    "repeat_candidates": (
        repeat_candidates,
        sql(LOG, CLICKS, body="SELECT impression_id, count(*) AS n_repeated FROM log l WHERE EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = l.user_id AND c.article_id = l.article_id AND c.us < l.us) GROUP BY 1"),
    ),
    "dangling_refs": (dangling_refs, "SELECT l_partkey AS article_id, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1"),
    "future_click_guard": (
        future_click_guard,
        sql(
            LOG,
            CLICKS,
            body="""SELECT c.user_id, count(*) AS n_clicks, count(*) FILTER (p.us > e.us) AS n_future
FROM clicks c JOIN (SELECT article_id, min(us) AS us FROM log GROUP BY 1) p USING (article_id) JOIN (SELECT user_id, min(us) AS us FROM log GROUP BY 1) e ON e.user_id = c.user_id GROUP BY 1""",
        ),
    ),
    "ragged_lists": (
        ragged_lists,
        "SELECT l_orderkey AS impression_id, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_linenumber) AS n_numbers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) <> count(*)",
    ),
    "temporal_split": (temporal_split, sql(_assign(2, 3, 3), body="SELECT impression_id, split FROM sp")),
    "split_report": (
        split_report,
        sql(_assign(300, 200, 100), body="SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM sp), 9) AS share, min(impression_time) AS first_time, max(impression_time) AS last_time FROM sp GROUP BY split"),
    ),
    "split_order_guard": (split_order_guard, sql(
        _assign(300, 200, 100),
        body="""SELECT split, lo, before FROM (
  SELECT split, min(impression_time) AS lo, lag(max(impression_time)) OVER (ORDER BY list_position(['train', 'tune', 'validation', 'test'], split)) AS before
  FROM (SELECT impression_time, CASE impression_id % 97 WHEN 5 THEN 'train' WHEN 6 THEN 'test' ELSE split END AS split FROM sp) GROUP BY split
) WHERE before >= lo""",
    )),
    "ragged_guard": (ragged_guard, sql(LOG, body="SELECT impression_id, count(*) AS n_a, count(*) - 1 AS n_b FROM log WHERE impression_id % 11 = 3 GROUP BY 1")),
    "stack_halves": (
        stack_halves,
        sql(LOG, IMPRESSIONS, body="SELECT impression_id, us >= (SELECT us FROM (SELECT us, row_number() OVER (ORDER BY us) AS rn, count(*) OVER () AS n FROM impressions) WHERE rn = floor(n * 0.5) + 1) AS later FROM impressions"),
    ),
    "causal_counters": (
        causal_counters,
        sql(
            LOG,
            body=f"""SELECT impression_id, article_id, exposures, clicks, round(clicks / nullif(exposures, 0), 9) AS ctr, first_seen_us FROM (
  SELECT impression_id, article_id, count(*) {_W.format("UNBOUNDED", "1 PRECEDING")} AS exposures,
         coalesce(sum(label) {_W.format("UNBOUNDED", "1 PRECEDING")}, 0)::BIGINT AS clicks, min(us) {_W.format("UNBOUNDED", "1 PRECEDING")} AS first_seen_us
  FROM log)""",
        ),
    ),
    "sliding_counters_365d": (
        sliding_counters_365d,
        sql(
            LOG,
            body=f"""SELECT impression_id, article_id, exposures, clicks, round(clicks / nullif(exposures, 0), 9) AS ctr FROM (
  SELECT impression_id, article_id, count(*) {_W.format(_YEAR, "1 PRECEDING")} AS exposures, coalesce(sum(label) {_W.format(_YEAR, "1 PRECEDING")}, 0)::BIGINT AS clicks FROM log)""",
        ),
    ),
    "whole_log_counters": (whole_log_counters, sql(LOG, body="SELECT article_id, count(*) AS exposures, sum(label)::BIGINT AS clicks FROM log GROUP BY 1")),
    "leaky_counters": (
        leaky_counters,
        sql(
            LOG,
            body=f"""SELECT impression_id, article_id, count(*) OVER w AS exposures, coalesce(sum(label) OVER w, 0)::BIGINT AS clicks FROM log
WINDOW w AS (PARTITION BY article_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {_YEAR - 1} FOLLOWING)""",
        ),
    ),
    "first_seen_freshness": (
        first_seen_freshness,
        sql(LOG, body=f"SELECT impression_id, article_id, round((us - min(us) {_W.format('UNBOUNDED', '1 PRECEDING')}) / 3.6e9, 6) AS freshness_hours FROM log"),
    ),
    "session_prior_activity": (
        session_prior_activity,
        sql(
            LOG,
            IMPRESSIONS,
            body="""SELECT impression_id, count(*) OVER w AS session_impressions, coalesce(sum(clicks) OVER w, 0)::BIGINT AS session_clicks FROM impressions
WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        ),
    ),
    "serving_counters": (
        serving_counters,
        sql(
            LOG,
            body="""SELECT impression_id, article_id, exposures + coalesce(u, 0) AS exposures, clicks + coalesce(u, 0) AS clicks FROM (
  SELECT impression_id, article_id, source, count(*) OVER w AS exposures, coalesce(sum(CASE WHEN source <> 'O' THEN label ELSE 0 END) OVER w, 0)::BIGINT AS clicks
  FROM log WINDOW w AS (PARTITION BY article_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) LEFT JOIN (SELECT json_extract_string(props, '$.k')::BIGINT + 1 AS article_id, count(*) AS u FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (article_id)
WHERE source = 'O'""",
        ),
    ),
    "event_rates": (
        event_rates,
        "SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2",
    ),
}
