"""Ranking metrics per impression, slices and report rows. Null where a metric is undefined; nulls are skipped and
counted, never taken as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import HEAD_FRACTION, LIST_DEPTH, SLICES

METRICS = ("auc", "mrr", "ndcg5", "ndcg10", "diversity", "novelty", "head_share")


def rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """1-based rank within the impression: higher scores first, ties keep the order of arrival."""
    w = Window.partitionBy("impression_id").orderBy(F.col(score).desc_nulls_last(), F.col("pos"))
    return scored.withColumn("rank", F.row_number().over(w))


def auc(y: Column, average_rank: Column) -> Column:
    """Mann-Whitney from average ascending ranks; null unless both classes occur. Ties count one half."""
    p, n = F.sum(y), F.count(F.lit(1)) - F.sum(y)
    return F.when((p > 0) & (n > 0), (F.sum(average_rank * y) - p * (p + 1) / 2) / (p * n))


def per_impression(ranked: DataFrame, score: str = "score") -> DataFrame:
    """auc, mrr, ndcg5, ndcg10 and degenerate flags of every impression. Needs impression_id, label, rank, score."""
    w = Window.partitionBy("impression_id")
    up = w.orderBy(score)
    ties = Window.partitionBy("impression_id", score)
    y = F.col("label")
    rows = ranked.withColumn("_avg_rank", F.rank().over(up) + (F.count(F.lit(1)).over(ties) - 1) / 2)

    both = (F.sum(y) > 0) & (F.sum(y) < F.count(F.lit(1)))
    g = rows.groupBy("impression_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("long").alias("n_clicked"),
        auc(y, F.col("_avg_rank")).alias("auc"),
        F.when(both, 1.0 / F.min(F.when(y == 1, F.col("rank")))).alias("mrr"),
        F.when(both, F.sum(F.when(F.col("rank") <= 5, y / F.log2(F.col("rank") + 1.0)))).alias("_dcg5"),
        F.when(both, F.sum(F.when(F.col("rank") <= 10, y / F.log2(F.col("rank") + 1.0)))).alias("_dcg10"),
        (F.sum(y) == 0).alias("no_positive"),
        (F.sum(y) == F.count(F.lit(1))).alias("all_positive"),
        (both & (F.min(score) == F.max(score))).alias("all_tied"),
    )

    def over_ideal(k: int) -> Column:
        top = F.greatest(F.lit(1), F.least(F.col("n_clicked"), F.lit(k))).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        return F.when(~F.col("no_positive") & ~F.col("all_positive"), F.coalesce(F.col(f"_dcg{k}"), F.lit(0.0)) / ideal)

    return g.select("impression_id", "n", "n_clicked", "auc", "mrr", over_ideal(5).alias("ndcg5"), over_ideal(10).alias("ndcg10"), "no_positive", "all_positive", "all_tied")


def recall_at(ranked: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """depth, recall, n_scored, n_no_positive: mean share of an impression's distinct clicked articles within the depth."""
    clicked = ranked.where("label = 1").groupBy("impression_id", "article_id").agg(F.min("rank").alias("rank"))
    per = clicked.groupBy("impression_id").agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"r{k}") for k in depths])
    wide = per.agg(F.count(F.lit(1)).alias("n_scored"), *[F.avg(f"r{k}").alias(f"r{k}") for k in depths])
    total = ranked.agg(F.countDistinct("impression_id").alias("n_all"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.col(f"r{k}").alias("recall")) for k in depths]))
    return wide.join(F.broadcast(total)).select(rows.alias("x"), "n_scored", (F.col("n_all") - F.col("n_scored")).alias("n_no_positive")).select("x.depth", "x.recall", "n_scored", "n_no_positive")  # one row


def diversity(ranked: DataFrame, depth: int = LIST_DEPTH) -> DataFrame:
    """1 - sum c (c - 1) / (m (m - 1)) over the categories of the first ``depth``; null for lists of one. Missing
    categories are one category. Needs category."""
    top = ranked.where(F.col("rank") <= depth).groupBy("impression_id", F.coalesce("category", F.lit("")).alias("_c")).agg(F.count(F.lit(1)).alias("c"))
    g = top.groupBy("impression_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return g.select("impression_id", F.when(F.col("m") > 1, 1 - F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("diversity"))


def article_facts(log: DataFrame, fraction: float = HEAD_FRACTION) -> DataFrame:
    """Exposures, clicks, novelty and head flag of every shown article. The head is the most shown fifth, ties by id;
    its size is rounded half to even. Novelty is -log2((clicks + 1) / (all clicks + articles))."""
    g = log.groupBy("article_id").agg(F.count(F.lit(1)).alias("exposures"), F.sum("label").cast("long").alias("clicks"))
    total = g.agg(F.count(F.lit(1)).alias("_pool"), F.sum("clicks").alias("_clicks"))
    w = Window.orderBy(F.col("exposures").desc(), F.col("article_id"))  # a row per shown article: the catalogue, not the log
    rows = g.join(F.broadcast(total)).withColumn("_place", F.row_number().over(w))  # one row
    return rows.select(
        "article_id",
        "exposures",
        "clicks",
        (-F.log2((F.col("clicks") + 1) / (F.col("_clicks") + F.col("_pool")))).alias("novelty"),
        (F.col("_place") <= F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * F.col("_pool")))).cast("int").alias("is_head"),
    )


def head_share(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean head flag of an impression's clicked articles; null without clicks."""
    return log.join(facts.select("article_id", "is_head"), "article_id", "left").groupBy("impression_id").agg(F.avg(F.when(F.col("label") == 1, F.col("is_head"))).alias("head_share"))


def list_novelty(ranked: DataFrame, facts: DataFrame, depth: int = LIST_DEPTH) -> DataFrame:
    return ranked.where(F.col("rank") <= depth).join(facts.select("article_id", "novelty"), "article_id", "left").groupBy("impression_id").agg(F.avg("novelty").alias("novelty"))


def coverage(ranked: DataFrame, catalogue_size: Column | int, depth: int = LIST_DEPTH) -> DataFrame:
    """Distinct articles in the first ``depth`` of any list over the catalogue's size."""
    size = catalogue_size if isinstance(catalogue_size, Column) else F.lit(catalogue_size)
    return ranked.where(F.col("rank") <= depth).agg(F.countDistinct("article_id").alias("n_shown")).select("n_shown", (F.col("n_shown") / size).alias("coverage"))


def sliced_report(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """slice, metric, population, n, value: overlapping slices by predicate, one pass, nulls skipped and counted.
    Needs n_clicks and head_share beside the metrics."""
    present = F.filter(F.array(*[F.when(F.coalesce(p(), F.lit(False)), F.lit(s)) for s, p in SLICES.items()]), lambda x: x.isNotNull())
    rows = metrics.withColumn("slice", F.explode(present))
    g = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("population"), *[F.count(m).alias(f"n_{m}") for m in names], *[F.avg(m).alias(f"v_{m}") for m in names])
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"v_{m}").alias("value")) for m in names]))
    return g.select("slice", "population", long.alias("x")).select("slice", "x.metric", "population", "x.n", "x.value")
