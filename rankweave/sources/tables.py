"""Reads of the engine's own tables: projected features, vectors, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_features(spark: SparkSession, path: str, columns: list[str], keep: DataFrame | None = None, key: str = "impression_id") -> DataFrame:
    """The named columns of a stored frame; an unknown name is refused before anything is read. ``keep``: the
    impressions wanted, applied as a semi join, so only their rows leave the scan's stage."""
    frame = spark.read.parquet(path)
    if unknown := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    names = list(dict.fromkeys([key, *columns])) if keep is not None else columns
    rows = frame.select(*names)
    return rows if keep is None else rows.join(keep.select(key).distinct(), key, "left_semi").select(*columns)


def read_vectors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """article_id (string) and vec of a vector table: its key and its one array column, whatever that is called."""
    table = spark.read.parquet(path)
    arrays = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType)]
    if key not in table.columns or len(arrays) != 1:
        raise ValueError(f"a vector table has {key} and one array column, not {table.columns}")
    return table.select(F.col(key).cast("string").alias("article_id"), F.col(arrays[0]).cast("array<double>").alias("vec"))


def row_count(spark: SparkSession, path: str, kind: str = "parquet") -> int:
    """Rows of a source: from the footers of parquet files, from the lines of text files. Reads no column."""
    return spark.read.format(kind).load(path).count()
