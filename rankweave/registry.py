"""What differs between datasets is data here: columns, split lengths, retrieval parameters, capabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The unified schemas; every adapter ends in one of them.
ARTICLES = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("published_time", T.TimestampNTZType()),
        T.StructField("lexical_text", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)
BEHAVIORS = T.StructType(
    [
        T.StructField("impression_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("impression_time", T.TimestampNTZType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("candidate_ids", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("split", T.StringType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("click_history", T.ArrayType(T.StringType())),
        T.StructField("click_times", T.ArrayType(T.TimestampNTZType())),
        T.StructField("click_read_times", T.ArrayType(T.FloatType())),
        T.StructField("click_scroll", T.ArrayType(T.FloatType())),
        T.StructField("n_clicks", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Bm25:
    k1: float = 2.0
    b: float = 0.9
    title_weight: int = 3
    query_abstract: bool = True


@dataclass(frozen=True)
class Fusion:
    method: str = "linear"
    alpha: float = 0.3
    k: int = 60


@dataclass(frozen=True)
class Split:
    tune_days: int = 1
    validation_days: int = 1
    test_days: int = 1


@dataclass(frozen=True)
class Source:
    """Where a raw table lies, how it is read and how it becomes the unified table (``adapt``: frame to frame)."""

    files: tuple[str, ...]
    format: str
    adapt: Callable[[DataFrame], DataFrame]
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Dataset:
    name: str
    split: Split = Split()
    bm25: Bm25 = Bm25()
    fusion: Fusion = Fusion()
    weighting: str = "uniform"
    correction: str = "centre"
    sources: dict[str, Source] = field(default_factory=dict)
    #: unified columns that the dataset really has; the others are null, never missing
    has_sessions: bool = True
    has_publish_times: bool = False
    has_engagement: bool = False
    language: str = "en"

    def with_(self, **changes) -> Dataset:
        return replace(self, **changes)


#: The two shapes of raw logs that the adapters know, with their tuned parameters.
DATASETS = {
    "tsv_news": Dataset("tsv_news", Split(1, 1, 1), Bm25(2.0, 0.9, 3), Fusion("linear", 0.3), "uniform", "centre", has_sessions=False),
    "parquet_news": Dataset("parquet_news", Split(2, 3, 3), Bm25(2.0, 0.9, 2), Fusion("linear", 0.15), "engagement", "abtt:1", has_publish_times=True, has_engagement=True, language="da"),
}

#: Parameters shared by all datasets.
HISTORY_K = 80
ENGAGEMENT_KEPT = 100
DEPTHS = (50, 100, 200)
LIST_DEPTH = 10
COLD_BELOW = 5
HEAD_FRACTION = 0.2
RESAMPLES = 1000
WINDOWS_H = {"cumulative": None, "1h": 1, "3h": 3, "24h": 24}
POOLINGS = ("mean", "max", "last")

#: Report slices: name -> predicate over an impression's ``n_clicks`` and ``head_share``.
SLICES: dict[str, Callable[[], Column]] = {
    "overall": lambda: F.lit(True),
    "cold": lambda: F.col("n_clicks") < COLD_BELOW,
    "warm": lambda: F.col("n_clicks") >= COLD_BELOW,
    "head": lambda: F.col("head_share") == 1,
    "tail": lambda: F.col("head_share") == 0,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; absent ones as nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def weighting_schemes(dataset: Dataset) -> tuple[str, ...]:
    """Click weightings that the dataset's columns can express."""
    return ("uniform", "position", *(("time", "engagement") if dataset.has_engagement else ()))
