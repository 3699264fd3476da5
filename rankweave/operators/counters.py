"""Causal counters: how often something happened strictly before an instant.

A window over a key's whole log would put a hot key into one task. Counts are prefix sums in two levels instead: within
(key, day), and over the days of a key, of which there are few. Reads at other instants (window starts, other logs) are
probe rows in the same sums, so any number of windows costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, HOUR_US


def counts_before(events: DataFrame, probes: DataFrame, key: str, sums: list[str], payload: list[str]) -> DataFrame:
    """For every probe (``key``, ``us``, ``payload`` columns) the sums of the events' ``sums`` columns strictly before
    ``us``; 0 if there are none. Peers at the same instant never see each other."""
    ev = events.select(key, "us", *sums, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in payload], F.lit(False).alias("_probe"))
    pr = probes.select(key, "us", *[F.lit(0).cast("long").alias(c) for c in sums], *payload, F.lit(True).alias("_probe"))
    both = ev.unionByName(pr).withColumn("_day", F.floor(F.col("us") / F.lit(DAY_US)))
    within = Window.partitionBy(key, "_day").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    rows = both
    for c in sums:
        rows = rows.withColumn(f"_in_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)))
    rows = rows.where("_probe")
    days = events.groupBy(key, F.floor(F.col("us") / F.lit(DAY_US)).alias("_day")).agg(*[F.sum(c).alias(f"_d_{c}") for c in sums])
    # a probe's day may hold no event: the days before it are found by the same union, on a row per day
    wanted = rows.select(key, "_day").distinct()
    over = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    ladder = days.unionByName(wanted.select(key, "_day", *[F.lit(0).cast("long").alias(f"_d_{c}") for c in sums])).groupBy(key, "_day").agg(*[F.sum(f"_d_{c}").alias(f"_d_{c}") for c in sums])
    for c in sums:
        ladder = ladder.withColumn(f"_b_{c}", F.coalesce(F.sum(f"_d_{c}").over(over), F.lit(0)))
    joined = rows.join(ladder.select(key, "_day", *[f"_b_{c}" for c in sums]), [key, "_day"])
    return joined.select(key, "us", *payload, *[(F.col(f"_in_{c}") + F.col(f"_b_{c}")).cast("long").alias(c) for c in sums])


def exposures_and_clicks(log: DataFrame, keep: list[str], windows: dict[str, int | None], key: str = "article_id") -> DataFrame:
    """Exposures and clicks of every log row's article strictly before its instant, over everything and over sliding
    windows [t - w, t) of w hours: ``exposures_<name>``, ``clicks_<name>``, ``ctr_<name>`` (null if never exposed)."""
    events = log.select(key, "us", F.lit(1).cast("long").alias("exposures"), F.col("label").cast("long").alias("clicks"))
    # every window start of a row in one pass over the log
    names = {"cumulative": None} | windows
    starts = F.array(*[F.struct(F.lit(i).cast("byte").alias("n"), F.lit(int((h or 0) * HOUR_US)).alias("back")) for i, h in enumerate(names.values())])
    probes = log.select(key, "us", *keep, F.explode(starts).alias("_s")).select(key, (F.col("us") - F.col("_s.back")).alias("us"), *keep, F.col("_s.n").alias("_window"))
    read = counts_before(events, probes, key, ["exposures", "clicks"], [*keep, "_window"])
    at = {n: [F.max(F.when(F.col("_window") == list(names).index(n), F.col(c))).alias(f"_{c}_{n}") for c in ("exposures", "clicks")] for n in {*windows, "cumulative"}}
    wide = read.groupBy(key, *keep).agg(*[x for v in at.values() for x in v])
    out: list[Column] = []
    for name, hours in windows.items():
        for c in ("exposures", "clicks"):
            value = F.col(f"_{c}_cumulative") - F.col(f"_{c}_{name}") if hours else F.col(f"_{c}_{name}")
            out.append(value.alias(f"{c}_{name}"))
    wide = wide.select(key, *keep, *out)
    return wide.select("*", *[F.try_divide(F.col(f"clicks_{n}"), F.col(f"exposures_{n}")).alias(f"ctr_{n}") for n in windows])


def first_seen(log: DataFrame, key: str = "article_id") -> DataFrame:
    """Earliest instant of every key: seen strictly before t only if it is below t."""
    return log.groupBy(key).agg(F.min("us").alias("first_us"))


def whole_log(log: DataFrame, key: str = "article_id") -> DataFrame:
    """The leaky read: counts over the whole log, whatever the instant."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("exposures"), F.sum("label").cast("long").alias("clicks"))


def leaky_sliding(log: DataFrame, keep: list[str], hours: int, key: str = "article_id") -> DataFrame:
    """The leaky sliding read [t, t + w): what comes before t + w less what comes before t."""
    events = log.select(key, "us", F.lit(1).cast("long").alias("exposures"), F.col("label").cast("long").alias("clicks"))
    ends = F.explode(F.array(F.lit(0), F.lit(1))).alias("_end")
    probes = log.select(key, "us", *keep, ends).withColumn("us", F.col("us") + F.col("_end") * F.lit(int(hours * HOUR_US)))
    read = counts_before(events, probes, key, ["exposures", "clicks"], [*keep, "_end"])
    end = lambda c: (F.max(F.when(F.col("_end") == 1, F.col(c))) - F.max(F.when(F.col("_end") == 0, F.col(c)))).alias(c)
    return read.groupBy(key, *keep).agg(end("exposures"), end("clicks"))


def session_prior(impressions: DataFrame) -> DataFrame:
    """Impressions and clicks strictly earlier in the session; null where there is no session. Sessions are short, so a
    range window per session is one small sort. Needs impression_id, session_id, us, clicks."""
    w = Window.partitionBy("session_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("session_id").isNotNull()
    return impressions.select(
        "impression_id",
        F.when(known, F.count(F.lit(1)).over(w)).alias("session_impressions"),
        F.when(known, F.coalesce(F.sum("clicks").over(w), F.lit(0)).cast("long")).alias("session_clicks"),
    )


def serving_counts(train: DataFrame, test: DataFrame, undated: DataFrame, keep: list[str], key: str = "article_id") -> DataFrame:
    """Counters at serving time: the training log, the unlabelled test log as exposures without clicks, and history
    clicks without a date, which count towards cumulative clicks and exposures only. Read for the test rows."""
    log = train.select(key, "us", "label").unionByName(test.select(key, "us", F.lit(0).alias("label")))
    events = log.select(key, "us", F.lit(1).cast("long").alias("exposures"), F.col("label").cast("long").alias("clicks"))
    read = counts_before(events, test.select(key, "us", *keep), key, ["exposures", "clicks"], keep)
    extra = undated.groupBy(key).agg(F.count(F.lit(1)).alias("_undated"))
    plus = F.coalesce("_undated", F.lit(0))
    return read.join(extra, key, "left").select(key, *keep, (F.col("exposures") + plus).alias("exposures"), (F.col("clicks") + plus).alias("clicks"))
