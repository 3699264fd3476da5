"""Exact deduplication as a stateful stream: keyed, disk-backed state without expiry, native expressions only.

A feed of ``(digest, doc_id, code points, locator)`` rows runs through Structured Streaming into RocksDB state keyed by
the SHA-256 of the normalised text. A key's state is a count, the winner's stable identifier and its content locator
(feed, file part and row), never the text. Keys never expire: with a ``state`` folder of one's own, a later call adds a
feed and goes on with all that was seen before.

Hits (digests with more than one row) are checked byte for byte against the text that the locator points to. The state
holds no text, so this is a join of the hits with the feed after the stream has run, not a comparison within the stream; a
digest shared by different texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import WHITE, columns_of_row, documents, materialize, remove, shared_dir, small, text_of, whole_row

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # many small stores: do not reserve log space ahead for each of them
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalized(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), WHITE, "")


def write_feed(docs: DataFrame, path: str, digest: Column, columns: list[str]) -> int:
    """Digest every row once and write it as the next feed below ``path``, with ``columns`` (the text among them) in a struct. ``feed``
    and ``tag`` (part and row number within it) are the content locator. Returns the feed's number."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = sum(f.getPath().getName().startswith("feed=") for f in files.listStatus(at)) if files.exists(at) else 0
    (
        docs.select(
            whole_row(docs, columns),
            "doc_id",
            F.length(text_of()).cast("long").alias("n_points"),
            normalized().alias("body"),
            F.monotonically_increasing_id().alias("tag"),
        )
        .withColumn("digest", digest)
        .drop("body")
        .write.option("compression", "zstd")
        .parquet(f"{path}/feed={number}")
    )
    return number


def feed_rows(spark: SparkSession, path: str) -> DataFrame:
    """All feeds below ``path``; the columns carried along are those of the first feed."""
    first = spark.read.parquet(f"{path}/feed=0").schema.add("feed", IntegerType())
    return spark.read.schema(first).parquet(path).withColumn("text", F.coalesce("row.text", F.lit("")))


def run_stream(spark: SparkSession, feed: str, state: str, files_per_batch: int | None = None) -> None:
    """Fold what is new in the feed into the keyed state; a second call goes on where the first ended."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(feed_rows(spark, feed).drop("text").schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # min over a struct: most code points, then smallest doc_id (nulls last), then first place
        order = F.struct(
            (-F.col("n_points")).alias("r0"),
            F.col("doc_id").isNull().alias("r1"),
            F.col("doc_id").alias("keep_id"),
            F.col("feed").alias("keep_feed"),
            F.col("tag").alias("keep_tag"),
        )
        (
            reader.parquet(feed)
            .select("digest", order.alias("ord"))
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("best"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, n, keep_id, keep_feed, keep_tag of every key, read back from the state store."""
    rows = spark.read.format("statestore").load(state)
    return rows.select(
        F.col("key.digest").alias("digest"),
        F.col("value.count").alias("n"),
        F.col("value.min.keep_id").alias("keep_id"),
        F.col("value.min.keep_feed").alias("keep_feed"),
        F.col("value.min.keep_tag").alias("keep_tag"),
    )


def grouped(docs: DataFrame, columns: list[str], digest: Column | None = None, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """row (these columns of ``docs``), doc_id, keep_id, group_size, kept, text_sha256, tag of every row of this call."""
    spark = docs.sparkSession
    root = state.rstrip("/") if state else shared_dir(spark, "dedup")
    feed, keyed = f"{root}/feeds", f"{root}/state"
    number = write_feed(docs, feed, F.sha2("body", 256) if digest is None else digest, columns)
    run_stream(spark, feed, keyed, files_per_batch)
    keys = materialize(read_state(spark, keyed), "dedup-keys")
    if not state:
        remove(spark, keyed)
    rows = feed_rows(spark, feed)

    # hits only: full bytes against those at the locator; equal texts meet in partial sums before any shuffle
    at_locator = (F.col("feed") == F.col("keep_feed")) & (F.col("tag") == F.col("keep_tag"))
    hits = small(keys.where("n > 1").select("digest", "keep_feed", "keep_tag"))
    bodies = (
        rows.select("digest", "feed", "tag", "text")
        .join(hits, "digest")
        .groupBy("digest", normalized().alias("body"))
        .agg(F.max(at_locator.cast("int")).alias("keeper"))
    )
    collided = materialize(bodies.where("keeper = 0").select("digest").distinct(), "dedup-false")

    now = F.col("feed") == number
    joined = rows.where(now).select("row", "digest", "doc_id", "feed", "tag").join(keys, "digest")
    if not collided.isEmpty():  # texts that differ under one digest: grouped by the text itself
        w = Window.partitionBy("digest", "body")
        order = w.orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), "feed", "tag")
        split = (
            rows.join(collided, "digest", "left_semi")
            .withColumn("body", normalized())
            .withColumn("n", F.count(F.lit(1)).over(w))
            .withColumn("keep_id", F.first("doc_id").over(order))
            .withColumn("keep_feed", F.first("feed").over(order))
            .withColumn("keep_tag", F.first("tag").over(order))
            .where(now)
            .select("row", "digest", "doc_id", "feed", "tag", "n", "keep_id", "keep_feed", "keep_tag")
        )
        joined = joined.join(collided, "digest", "left_anti").unionByName(split)
    return joined.select("row", "doc_id", "keep_id", F.col("n").alias("group_size"), at_locator.alias("kept"), F.col("digest").alias("text_sha256"), "tag")


def exact_groups(docs: DataFrame, digest: Column | None = None, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, tag.

    With ``state`` (a folder that driver and executors share) the groups are those of all calls with it so far; the rows are
    those of this call. A later call may name another row as the one that stays (a longer text with the same
    characters); rows of earlier calls are not given out again.

    Defined results: null text counts as empty; all empty or blank texts are one group; a repeated row counts as a
    further copy and only its first place is kept; null doc_id sorts after any other; other columns are ignored.
    ``digest`` (over ``body``) may be replaced in tests to force collisions.
    """
    return grouped(docs, ["doc_id", "text"], digest, files_per_batch, state).drop("row")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("tag")


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of each group that stays, with the columns of ``docs``. Rows are told apart by their place in the feed, not by
    their ids: of repeated rows, and of equal texts without ids, one stays."""
    return grouped(docs, docs.columns).where("kept").select(*columns_of_row(docs.columns))


SQL_OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
