"""Click weights of a history window, and the window itself without pairing a user's log with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HOUR_US
from ..registry import HISTORY_K
from .counters import counts_before


def last_clicks(impressions: DataFrame, clicks: DataFrame, k: int = HISTORY_K) -> DataFrame:
    """(impression_id, article_id, age, click_us, us, n_clicks): the user's last k clicks strictly before the
    impression, newest at age 0. Clicks are numbered per user and laid into lists of the numbers k * c + 1 to k * (c + 1) with the
    k - 1 before them; an impression meets the one list that holds its window, by equi-join, and takes its part of it. ``clicks``:
    user_id, article_id, us and a tie-breaking ``seq``."""
    w = Window.partitionBy("user_id").orderBy("us", "seq")
    rest = [c for c in clicks.columns if c not in ("user_id", "article_id", "us", "seq")]
    numbered = clicks.withColumn("no", F.row_number().over(w).cast("long"))
    chunk = F.floor((F.col("no") - 1) / F.lit(k))
    # the first of a list's k numbers lies in no window that ends in the next list; the others may
    place = F.explode(F.when(F.col("no") % k == 1 % k, F.array(chunk)).otherwise(F.array(chunk, chunk + 1)))
    lists = numbered.withColumn("_chunk", place).groupBy("user_id", "_chunk").agg(F.collect_list(F.struct("no", "article_id", F.col("us").alias("click_us"), *rest)).alias("_list"))
    n = counts_before(clicks.withColumn("n_clicks", F.lit(1).cast("long")), impressions.select("user_id", "us", "impression_id"), "user_id", ["n_clicks"], ["impression_id"])
    asked = n.where("n_clicks > 0").withColumn("_chunk", F.floor((F.col("n_clicks") - 1) / F.lit(k)))
    mine = asked.join(lists, ["user_id", "_chunk"]).withColumn("_c", F.explode("_list"))
    mine = mine.where((F.col("_c.no") <= F.col("n_clicks")) & (F.col("_c.no") > F.col("n_clicks") - k))
    return mine.select("user_id", "us", "impression_id", "n_clicks", "_c.*").withColumn("age", F.col("n_clicks") - F.col("no"))


def weight(scheme: str, decay: float = 0.9, tau_hours: float = 24.0) -> Column:
    """Unnormalised weight of a click row. ``position``: decay^age; ``time``: exp(-hours / tau), future clicks 1;
    ``engagement``: log1p(read time) times scroll, a missing scroll being neutral, a missing read time 0."""
    if scheme == "uniform":
        return F.lit(1.0)
    if scheme == "position":
        return F.pow(F.lit(decay), F.col("age"))
    if scheme == "time":
        return F.exp(-F.greatest(F.lit(0.0), (F.col("us") - F.col("click_us")) / HOUR_US) / tau_hours)
    if scheme == "engagement":
        return F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("read_time").cast("double"), F.lit(0.0)))) * F.coalesce(F.col("scroll").cast("double") / 100, F.lit(1.0))
    raise ValueError(f"unknown weighting {scheme}")


def normalised(w: Column, over: str = "impression_id", by: str = "sum") -> Column:
    """Weights at sum 1 (or largest 1, for the maximum pooling); all-zero weights become uniform. ``over``: the column
    or columns of a window."""
    p = Window.partitionBy(over)
    total = F.sum(w).over(p) if by == "sum" else F.max(w).over(p)
    even = F.lit(1.0) / F.count(F.lit(1)).over(p) if by == "sum" else F.lit(1.0)
    return F.when(total > 0, w / total).otherwise(even)
