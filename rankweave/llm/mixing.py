"""Mixing sources to target weights by Pareto order sampling, native expressions only.

Targets are words of a source. Within a source a document's inclusion expectation grows with its size: it is ``e = min(most,
level * w)``, where ``w`` follows the number of binary digits of the size, and the source's ``level`` makes the expected words
equal to its target. A document is taken ``floor(e)`` times for certain. For the rest every document has one ticket: with a
uniform number ``u`` and its own remaining inclusion probability ``p = e - floor(e)`` its Pareto rank is
``(u / (1 - u)) / (p / (1 - p))``; the smallest ranks are taken until the source's remaining words are used up, so the size
of the sample is fixed (a document straddling the end is taken if its middle lies before it).

The order statistic is found without sorting a source in one place: words are summed in cells of the rank (a fixed number of
cells per source, summed before any shuffle), the cell in which the target falls is divided once more, and only the documents
of that last cell are ordered among themselves. What comes out is the last rank that is taken, a row per source; every
document is held against it where it lies, so no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of_row, documents, materialize, small, text_of, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and most copies of a document.
SHARE, MOST = 1.5, 2.0
#: A document's weight within its source is this plus the binary digits of its size.
BASE_WEIGHT = 16
#: Cells of a level of the search; two levels, so a last cell holds about a 16-millionth of a source.
CELLS = 4096
SEED = "mix-1"
#: A remaining probability below this counts as none.
TINY = 1e-9


def uniform(seed: str = SEED) -> Column:
    """In (0, 1), from the id (the text where it is null): 52 bits of a digest; the same in every run and engine."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_of())))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10)
    return (bits.cast("long") + 0.5) / F.lit(float(2**52))


def target_table(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size -> target. Targets share out ``share`` of all words by weight, stop at ``most`` times the
    source's size, and the excess is shared again by weight until none is above.

    Closed form: with sources ordered by cap / weight, the first k are at their caps and the rest share what is left,
    for the smallest k at which nobody is above. One row per source, ordered by code point, null last; the windows hold all
    sources in one task, which is meant for thousands of them, not for millions.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))  # a row per source only
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("turn", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("turn", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level that sources from here on would get if all before are at their caps
    w = (
        w.withColumn("total", share * F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
        .withColumn("place", F.row_number().over(Window.orderBy("turn", F.col("source").isNull(), "source")))
        .withColumn("fits", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("place", "level"))).over(everyone)["level"])
    )
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("fits"), F.col("cap"))).alias("target"))


def expectations(classes: DataFrame, most: float = MOST) -> DataFrame:
    """sid, target, digits, words -> whole, p and the source's ``rest`` (words beyond the whole copies): a row per source and
    number of binary digits, at most 64 for a source.

    The same closed form as for the targets: with the classes from the heaviest down, the first k are at ``most`` copies and
    the others have level * w, for the smallest k at which nobody is above.
    """
    down = Window.partitionBy("sid").orderBy(F.col("w").desc())
    before, onward = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    source = Window.partitionBy("sid")
    c = (
        classes.withColumn("w", F.col("digits") + BASE_WEIGHT)
        .withColumn("level", (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("w") * F.col("words")).over(onward), F.lit(0)))
        .withColumn("fits", F.max(F.when(F.col("level") * F.col("w") <= most, F.struct("w", "level"))).over(source)["level"])
        .withColumn("e", F.when(F.col("words") > 0, F.least(F.lit(most), F.coalesce(F.col("fits") * F.col("w"), F.lit(most)))).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("e") + TINY))
    )
    rest = F.greatest(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source), F.lit(0.0))
    return c.select("sid", "digits", "whole", F.when(F.col("e") - F.col("whole") > TINY, F.col("e") - F.col("whole")).otherwise(0.0).alias("p"), rest.alias("rest"))


def _crossing(cells: DataFrame) -> DataFrame:
    """Per source the first cell whose end reaches the words that are left, and the words before it."""
    w = Window.partitionBy("sid").orderBy("cell")
    return (
        cells.withColumn("upto", F.sum("words").over(w))
        .where("upto >= rest")
        .groupBy("sid")
        .agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "rest"), "cell").alias("c"))
        .select("sid", F.col("c.cell").alias("cut"), (F.col("c.rest") - F.col("c.before")).alias("rest"))
    )


def sampled(docs: DataFrame, columns: list[str], share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """row (these columns of ``docs``), doc_id, source, size, source_size, target, p, rank, copies: one row per input row."""
    counted = materialize(
        docs.select(
            whole_row(docs, columns),
            "doc_id",
            "source",
            F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
            uniform(seed).alias("u"),
            F.monotonically_increasing_id().alias("tag"),
        ).withColumn("digits", F.length(F.bin(F.col("size") + 1))),
        "mix-sizes",
    )
    by_class = materialize(counted.groupBy("source", "digits").agg(F.sum("size").alias("words")), "mix-classes")
    sources = target_table(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    sources = materialize(sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-sources")
    named = sources.withColumnRenamed("source", "_source")
    classes = by_class.join(small(named), by_class["source"].eqNullSafe(F.col("_source"))).drop("_source")
    classes = materialize(classes.select("source", "digits", "sid", "source_size", "target", "words").join(expectations(classes, most), ["sid", "digits"]), "mix-expectations")

    def joined(side: DataFrame) -> DataFrame:
        side = small(side.withColumnsRenamed({"source": "_source", "digits": "_digits"}))
        odds = F.col("u") / (1 - F.col("u"))
        rank = F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p"))))
        # rank / (1 + rank) keeps the order and lies in (0, 1); the cut is near 1/2, where cells are no fuller than on average
        at = F.col("rank") / (1 + F.col("rank")) * CELLS
        rows = counted.join(side, counted["source"].eqNullSafe(F.col("_source")) & (F.col("digits") == F.col("_digits"))).drop("_source", "_digits")
        return rows.withColumn("rank", rank).withColumn("cell", F.floor(at)).withColumn("sub", F.floor((at - F.floor(at)) * CELLS))

    tickets = joined(classes).where("rank is not null")
    first = materialize(_crossing(tickets.groupBy("sid", "rest", "cell").agg(F.sum("size").alias("words"))), "mix-cut")
    inside = tickets.drop("rest").join(small(first), "sid").where("cell = cut").select("sid", "rest", "sub", "rank", "doc_id", "size", "tag")
    inside = materialize(inside, "mix-cell")  # a 4096-th of the rows
    second = _crossing(inside.groupBy("sid", "rest", F.col("sub").alias("cell")).agg(F.sum("size").alias("words")))
    second = materialize(second.withColumnsRenamed({"cut": "cut2", "rest": "left"}), "mix-sub")
    order = F.struct("rank", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "tag")
    upto = Window.partitionBy("sid").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        inside.join(small(second), "sid")
        .where("sub = cut2")
        .withColumn("upto", F.sum("size").over(upto))
        .groupBy("sid")
        .agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("left"), order)).alias("last"))
    )
    cuts = first.select("sid", F.col("cut").alias("cut1")).join(second.select("sid", "cut2"), "sid").join(last, "sid")
    classes = materialize(classes.join(cuts, "sid", "left"), "mix-cuts")
    rows = joined(classes)
    # a source without a cut has words for every ticket
    taken = (
        F.when(F.col("rank").isNull(), F.lit(False))
        .when(F.col("cut1").isNull(), F.lit(True))
        .when(F.col("cell") != F.col("cut1"), F.col("cell") < F.col("cut1"))
        .when(F.col("sub") != F.col("cut2"), F.col("sub") < F.col("cut2"))
        .otherwise(F.coalesce(order <= F.col("last"), F.lit(False)))
    )
    copies = F.col("whole") + taken.cast("long")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", "p", "rank", copies.cast("long").alias("copies"))


def pareto_mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, p, rank: one row per input row.

    Defined results: a null text has size 0 and is not taken; a null source is a source of its own, ordered last; a row without
    an id draws its number from its text; repeated rows have equal ranks and are taken next to each other; an empty table gives
    an empty result; columns other than doc_id, text and source are ignored.
    """
    rows = sampled(docs, ["doc_id"], share, most, weights, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "p", "rank")


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``. Rows are told apart by their place, not by
    their ids, so repeated and null ids are mixed like any others."""
    rows = sampled(docs, docs.columns).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*columns_of_row(docs.columns))


SQL_OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, size, length(bin(size + 1)) AS digits,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(t))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0 * source_size::DOUBLE AS cap, 1.5 * sum(source_size) OVER ()::DOUBLE AS total,
         sum(weight) OVER () AS all_w,
         coalesce(sum(2.0 * source_size::DOUBLE) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s
), f AS (
  SELECT *, arg_min(level, place) FILTER (level <= cap / weight) OVER () AS fits
  FROM (SELECT *, (total - cap_before) / (all_w - w_before) AS level, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM l)
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * fits, cap)) AS target FROM f
), c AS (
  SELECT d.source, any_value(t.target) AS target, digits, digits + {BASE_WEIGHT} AS w, sum(size)::BIGINT AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, digits
), v AS (
  SELECT *, (target - 2.0 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / nullif(sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE, 0) AS level
  FROM c
), e AS (
  SELECT *, CASE WHEN words > 0 THEN least(2.0, coalesce(arg_max(level, w) FILTER (level * w <= 2.0) OVER (PARTITION BY source) * w, 2.0)) ELSE 0 END AS e FROM v
), g AS (
  SELECT *, floor(e + {TINY})::DOUBLE AS whole, CASE WHEN e - floor(e + {TINY}) > {TINY} THEN e - floor(e + {TINY}) ELSE 0 END AS p FROM e
), h AS (
  SELECT *, greatest(target - sum(whole * words) OVER (PARTITION BY source), 0) AS rest FROM g
), r AS (
  SELECT d.doc_id, d.size, d.source, h.whole, h.p, h.rest, h.target, CASE WHEN h.p > 0 THEN (u / (1 - u)) / (h.p / (1 - h.p)) END AS rank
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.digits = h.digits
), x AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT doc_id, size, t.source_size, x.target,
       (size * (whole + CASE WHEN p > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source
"""
