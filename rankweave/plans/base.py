"""The model tables over the driver's tables, in both languages.

behaviours are orders with their parts as candidates (clicked: returned), articles are parts, vectors are embeddings by
part number, lexical documents are documents, engagement comes from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..sources.sinks import materialize


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def basket_log(spark: SparkSession, d: str) -> DataFrame:
    """impression_id, user_id, us, source, session_id, article_id, pos, label: a row per shown candidate."""
    # dealt out by order once: the grouping, the join and the window all need no other exchange
    lines = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"), F.min("l_linenumber").alias("ln"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("impression_id"),
        F.col("o_custkey").alias("user_id"),
        micros(F.col("o_orderdate")).alias("us"),
        F.col("o_orderstatus").alias("source"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")).alias("session_id"),
    )
    w = Window.partitionBy("impression_id").orderBy("ln", "article_id")
    joined = orders.join(lines.withColumnRenamed("l_orderkey", "impression_id").withColumnRenamed("l_partkey", "article_id"), "impression_id")
    return joined.withColumn("pos", F.row_number().over(w) - 1).drop("ln")


def stored_log(spark: SparkSession, d: str) -> DataFrame:
    """The basket log as a table of its own, for queries in which many branches read it."""
    return materialize(basket_log(spark, d), "log")


LOG = """
log AS (
  SELECT o_orderkey AS impression_id, o_custkey AS user_id, epoch_us(o_orderdate) AS us, o_orderstatus AS source,
         o_custkey::VARCHAR || '-' || strftime(o_orderdate, '%Y-%m') AS session_id, l_partkey AS article_id,
         (row_number() OVER (PARTITION BY o_orderkey ORDER BY ln, l_partkey) - 1)::INT AS pos, label
  FROM orders JOIN (
    SELECT l_orderkey, l_partkey, max((l_returnflag = 'R')::INT) AS label, min(l_linenumber) AS ln FROM lineitem GROUP BY 1, 2
  ) ON l_orderkey = o_orderkey
)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"), F.col("p_retailprice").alias("price"))


ARTICLES = "articles AS (SELECT p_partkey AS article_id, p_name AS title, p_type AS category, p_brand AS subcategory, p_retailprice AS price FROM part)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec"))


VECTORS = "vecs AS (SELECT vec_id AS article_id, embedding::DOUBLE[] AS vec FROM embeddings)"


def impressions(log: DataFrame) -> DataFrame:
    return log.groupBy("impression_id").agg(F.first("user_id").alias("user_id"), F.first("us").alias("us"), F.first("session_id").alias("session_id"), F.sum("label").cast("long").alias("clicks"), F.count(F.lit(1)).alias("n_candidates"))


IMPRESSIONS = """
impressions AS (
  SELECT impression_id, any_value(user_id) AS user_id, any_value(us) AS us, any_value(session_id) AS session_id,
         sum(label)::BIGINT AS clicks, count(*) AS n_candidates
  FROM log GROUP BY impression_id
)"""


def clicks(log: DataFrame) -> DataFrame:
    """The clicked candidates as a click stream; read time and scroll are made from price-free columns of the log."""
    return log.where("label = 1").select(
        "user_id",
        "article_id",
        "us",
        (F.col("impression_id") * 100 + F.col("pos")).alias("seq"),
        F.when(F.col("article_id") % 7 != 0, (F.col("impression_id") % 50).cast("double")).alias("read_time"),
        F.when(F.col("article_id") % 5 != 0, (F.col("article_id") % 101).cast("double")).alias("scroll"),
    )


CLICKS = """
clicks AS (
  SELECT user_id, article_id, us, impression_id * 100 + pos AS seq,
         CASE WHEN article_id % 7 <> 0 THEN (impression_id % 50)::DOUBLE END AS read_time,
         CASE WHEN article_id % 5 <> 0 THEN (article_id % 101)::DOUBLE END AS scroll
  FROM log WHERE label = 1
)"""


def popularity(log: DataFrame) -> DataFrame:
    """First retriever: clicks of the article strictly before the impression (many ties)."""
    from ..operators.counters import counts_before

    events = log.select("article_id", "us", F.col("label").cast("long").alias("score"))
    read = counts_before(events, log.select("article_id", "us", "impression_id", "user_id", "pos", "label"), "article_id", ["score"], ["impression_id", "user_id", "pos", "label"])
    return read.withColumn("score", F.col("score").cast("double"))


POPULARITY = """
popularity AS (
  SELECT impression_id, user_id, article_id, pos, us, label,
         coalesce(sum(label) OVER (PARTITION BY article_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS score
  FROM log
)"""


def by_price(log: DataFrame, arts: DataFrame) -> DataFrame:
    """Second retriever: dearer first."""
    return log.join(arts.select("article_id", F.col("price").alias("score")), "article_id").select("impression_id", "user_id", "article_id", "pos", "us", "label", "score")


BY_PRICE = "by_price AS (SELECT impression_id, user_id, article_id, pos, us, label, price AS score FROM log JOIN articles USING (article_id))"


def lexical_documents(spark: SparkSession, d: str) -> DataFrame:
    """article_id, title (first line), abstract (the rest)."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.substring_index(text, "\n", 1).alias("title"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("abstract"), "lang", "source")


LEXICAL = r"""
docs AS (
  SELECT doc_id AS article_id, split_part(coalesce(text, ''), chr(10), 1) AS title, regexp_replace(coalesce(text, ''), '^[^\n]*\n?', '') AS abstract, lang, source
  FROM documents
)"""


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


#: The click window of every impression: the last 80 clicks strictly before it.
WINDOW = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS no FROM clicks),
counted AS (
  SELECT i.impression_id, i.user_id, i.us, count(c.seq) AS n_clicks
  FROM impressions i LEFT JOIN clicks c ON c.user_id = i.user_id AND c.us < i.us GROUP BY ALL
),
hist AS (
  SELECT k.impression_id, k.us, k.n_clicks, n.article_id, n.us AS click_us, n.read_time, n.scroll, k.n_clicks - n.no AS age
  FROM counted k JOIN numbered n ON n.user_id = k.user_id AND n.no <= k.n_clicks AND n.no > k.n_clicks - 80
)"""
