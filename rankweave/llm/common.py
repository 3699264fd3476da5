"""Shared plumbing of the corpus operators: shared folders, bounded broadcasts, Arrow blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows a side may have to be sent to every executor (about 16 MB of ids and numbers).
BROADCAST_ROWS = 200_000

#: Most bytes of text that a Python worker looks at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and
    driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the (materialised, cheap to count) side has at most ``rows`` rows; beyond it Spark
    joins by shuffle, where adaptive execution splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding at most ``most`` bytes of ``column``, so that work arrays stay small."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(values).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def whole_row(df: DataFrame, columns: list[str] | None = None):
    """The row (or these columns) as one struct ``row``: whatever the columns are called, they meet no other name."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in (df.columns if columns is None else columns)]).alias("row")


def columns_of_row(names: list[str]) -> list:
    """The columns that ``whole_row`` packed."""
    return [F.col("row").getField(c).alias(c) for c in names]
