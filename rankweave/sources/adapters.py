"""Raw click logs to the unified schema: two shapes of files, labelled and unlabelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import split_words, tail
from ..registry import ARTICLES, BEHAVIORS, ENGAGEMENT_KEPT, HISTORY, Source, conform

_S = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
TSV_ARTICLES = _S("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
TSV_BEHAVIORS = _S("impression_id", "user_id", "time", "history", "impressions")
TSV_TIME = "M/d/yyyy h:mm:ss a"


def read(spark: SparkSession, source: Source) -> DataFrame:
    """All files of a source as one frame with ``file_label`` (the file's folder or name): explicit schema, no header,
    no quoting for text; column pruning and pushdown are the scan's."""
    reader = spark.read.options(**source.options)
    if source.schema is not None:
        reader = reader.schema(source.schema)
    if source.format == "tsv":
        df = reader.csv(list(source.files), sep="\t", quote="", header=False)
    else:
        df = reader.format(source.format).load(list(source.files))
    return df.withColumn("file_label", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_[^/]*)?(?:\.[^/.]+)?(?:/[^/]*\.parquet)?$", 1))


def qualified(label: Column, raw: Column) -> Column:
    """Ids repeat between files; the file's label makes them unique. A missing id stays missing."""
    return F.when(raw.isNotNull(), F.concat_ws("-", label, raw.cast("string")))


def ids_and_labels(impressions: Column) -> tuple[Column, Column]:
    """``"N3-1 N4-0"`` cut on the last dash of every token: ids and labels."""
    tokens = split_words(F.coalesce(impressions, F.lit("")))
    return F.transform(tokens, lambda x: F.regexp_extract(x, "^(.*)-", 1)), F.transform(tokens, lambda x: F.substring_index(x, "-", -1).cast("int"))


def click_labels(candidates: Column, clicked: Column) -> Column:
    """1 for candidates among the clicked ids; a repeated candidate counts each time."""
    return F.transform(candidates, lambda x: F.array_contains(clicked, x).cast("int"))


def tsv_articles(df: DataFrame) -> DataFrame:
    return conform(df.withColumn("article_id", F.col("news_id")), ARTICLES)


def tsv_behaviors(df: DataFrame) -> DataFrame:
    ids, labels = ids_and_labels(F.col("impressions"))
    return conform(
        df.withColumn("impression_id", qualified(F.col("file_label"), F.col("impression_id")))
        .withColumn("source", F.col("file_label"))
        .withColumn("impression_time", F.to_timestamp_ntz(F.col("time"), F.lit(TSV_TIME)))
        .withColumn("candidate_ids", ids)
        .withColumn("labels", labels),
        BEHAVIORS,
    )


def tsv_history(df: DataFrame) -> DataFrame:
    """The history column of the behaviour rows: one row per user and file, blank as an empty list."""
    h = df.select("user_id", F.col("file_label").alias("source"), split_words(F.coalesce("history", F.lit(""))).alias("click_history")).dropDuplicates(["user_id", "source"])
    return conform(h.withColumn("n_clicks", F.size("click_history")), HISTORY)


def nested_articles(df: DataFrame) -> DataFrame:
    return conform(
        df.withColumn("abstract", F.col("subtitle")).withColumn("category", F.col("category_str")).withColumn("subcategory", F.try_element_at("subcategory", F.lit(1)).cast("string")),
        ARTICLES,
    )


def nested_behaviors(df: DataFrame) -> DataFrame:
    return conform(
        df.withColumn("source", F.col("file_label"))
        .withColumn("session_id", qualified(F.col("file_label"), F.col("session_id")))
        .withColumn("impression_id", qualified(F.col("file_label"), F.col("impression_id")))
        .withColumn("labels", click_labels(F.col("article_ids_inview"), F.coalesce("article_ids_clicked", F.array().cast("array<int>"))))
        .withColumn("candidate_ids", F.col("article_ids_inview")),
        BEHAVIORS,
    )


def nested_history(df: DataFrame) -> DataFrame:
    """Whole click lists; the measured arrays are cut to the last ones before anything joins them."""
    ids = F.coalesce(F.col("article_id_fixed"), F.array().cast("array<int>"))
    return conform(
        df.withColumn("source", F.col("file_label"))
        .withColumn("click_history", ids)
        .withColumn("click_times", tail(F.col("impression_time_fixed"), ENGAGEMENT_KEPT))
        .withColumn("click_read_times", tail(F.col("read_time_fixed"), ENGAGEMENT_KEPT))
        .withColumn("click_scroll", tail(F.col("scroll_percentage_fixed"), ENGAGEMENT_KEPT))
        .withColumn("n_clicks", F.size(ids)),
        HISTORY,
    )


def unlabelled(df: DataFrame) -> DataFrame:
    """Test impressions: bare candidate tokens or arrays; no labels by contract."""
    if "impressions" in df.columns:
        df = df.withColumn("candidate_ids", split_words(F.coalesce("impressions", F.lit("")))).withColumn("impression_time", F.to_timestamp_ntz(F.col("time"), F.lit(TSV_TIME)))
    else:
        df = df.withColumn("candidate_ids", F.col("article_ids_inview").cast("array<string>"))
    return df.select(F.col("impression_id").cast("string"), F.col("user_id").cast("string"), "impression_time", "candidate_ids")


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in the given order: ``dropDuplicates`` alone keeps any."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def history_view(behaviors: DataFrame, history: DataFrame) -> DataFrame:
    """Every impression with its user's clicks; users without a row have none. Plain equi-join: adaptive execution
    broadcasts a small history and splits hot users of a large one."""
    joined = behaviors.join(history.select("user_id", "source", "click_history", "n_clicks"), ["user_id", "source"], "left")
    return joined.withColumn("click_history", F.coalesce("click_history", F.array().cast("array<string>"))).withColumn("n_clicks", F.coalesce("n_clicks", F.lit(0)))
