"""Text cleaning and BM25 queries over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean, split_words
from ..operators import bm25, fusion, lexical_search
from . import base
from .base import LEXICAL, sql

K1, B = 2.0, 0.9
EVERY = 50  # the registered searches ask with every document whose id this divides, against all documents


def clean_text(s, d):
    return base.table(s, d, "documents").select("doc_id", clean(F.col("text")).alias("cleaned"))


def doc_stats(s, d):
    docs = base.table(s, d, "documents")
    words = split_words(clean(F.col("text")))
    return docs.select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


def term_stats(s, d):
    tf = bm25.term_counts(base.table(s, d, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _corpus(s, d, weight: int = 1):
    docs = base.lexical_documents(s, d)
    return docs.withColumn("text", bm25.lexical_text(F.col("title"), F.col("abstract"), weight)).select("article_id", "title", "text", "source")


def bm25_postings(s, d):
    p = lexical_search.postings(_corpus(s, d), "article_id", "text", K1, B)
    return p.select("term", "article_id", F.round("weight", 8).alias("weight"))


def _queries(docs):
    """Titles of every fiftieth document as queries."""
    return docs.where(F.col("article_id") % EVERY == 0).select(F.col("article_id").alias("query_id"), "title", "source")


def bm25_candidates(s, d):
    """Every query against the documents of its own source."""
    docs = _corpus(s, d)
    r = lexical_search.score_groups(_queries(docs), docs, "source", K1, B)
    return r.select("query_id", "article_id", F.round("score", 7).alias("score"))


def _top(s, d, weight=1, k=10, params=((K1, B),)):
    docs = _corpus(s, d, weight)
    return lexical_search.top_k(_queries(docs), docs, k, params)


def bm25_topk(s, d):
    return _top(s, d).select("query_id", "article_id", F.round("score", 7).alias("score"), "rank")


def title_weighted_bm25(s, d):
    return _top(s, d, weight=3).select("query_id", "article_id", F.round("score", 7).alias("score"), "rank")


GRID = ((1.2, 0.75), (2.0, 0.9), (0.8, 0.5))


def bm25_param_grid(s, d):
    """Mean score of the first ten for every (k1, b): all cells are scored in one pass over the corpus."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(k1).alias("k1"), F.lit(b).alias("b")) for i, (k1, b) in enumerate(GRID)])).alias("x")
    r = _top(s, d, params=GRID).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    wanted = s.range(1).select(cells).select("x.*")
    return wanted.join(r, "cell", "left").select("k1", "b", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_score", 7).alias("mean_score"))


def weighted_query_terms(s, d):
    """Query terms repeated by a weight that falls with the document's place in its source."""
    docs = _corpus(s, d)
    q = bm25.term_counts(docs.where(F.col("article_id") % EVERY == 0).select(F.col("article_id").alias("query_id"), "title"), "query_id", "title")
    return bm25.weighted_query(q, 1.0 / (1 + F.col("query_id") % 3)).select("query_id", "term", "tf")


def fuse_corpus_rrf(s, d):
    """Two lexical rankings of the corpus (plain and title-weighted) fused over their union."""
    r = fusion.corpus_reciprocal_rank([_top(s, d, k=20), _top(s, d, weight=3, k=20)], 10)
    return r.select("query_id", "article_id", F.round("score", 10).alias("score"), "rank")


_TOKENS = r"""
cl AS (SELECT *, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS c FROM src),
tok AS (SELECT article_id, unnest(string_split(c, ' ')) AS term FROM cl WHERE c <> ''),
tf AS (SELECT article_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"""
_QUERY = rf"""
qt AS (SELECT article_id AS query_id, unnest(string_split(c, ' ')) AS term FROM (SELECT article_id, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS c FROM docs WHERE article_id % {EVERY} = 0) WHERE c <> ''),
q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2)"""


def _source(weight: int) -> str:
    return f"src AS (SELECT article_id, source, trim(repeat(title || ' ', {weight}) || abstract) AS text FROM docs)"


def _postings(k1: float = K1, b: float = B, name: str = "post") -> str:
    return f"""
{name} AS (
  SELECT term, article_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / ({k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / (total / n)) + tf) AS weight
  FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term) JOIN (SELECT article_id, sum(tf) AS dl FROM tf GROUP BY 1) USING (article_id),
       (SELECT (SELECT count(*) FROM docs)::DOUBLE AS n, (SELECT sum(tf) FROM tf)::DOUBLE AS total)
)"""


def _ranked(k: int, post: str = "post") -> str:
    return f"""(SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS rank
  FROM (SELECT query_id, article_id, sum(qtf * weight) AS score FROM q JOIN {post} USING (term) GROUP BY 1, 2) QUALIFY rank <= {k})"""


_CLEAN = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"

QUERIES = {
    "clean_text": (clean_text, f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents"),
    "doc_stats": (doc_stats, f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, CASE WHEN {_CLEAN} = '' THEN [] ELSE string_split({_CLEAN}, ' ') END AS t FROM documents)"),
    "term_stats": (term_stats, sql("src AS (SELECT doc_id AS article_id, coalesce(text, '') AS text FROM documents)", _TOKENS, body="SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1")),
    "bm25_postings": (bm25_postings, sql(LEXICAL, _source(1), _TOKENS, _postings(), body="SELECT term, article_id, round(weight, 8) AS weight FROM post")),
    "bm25_candidates": (
        bm25_candidates,
        sql(
            LEXICAL,
            _source(1),
            _TOKENS,
            _QUERY,
            _postings(),
            body=f"""SELECT a.article_id AS query_id, b.article_id, round(coalesce(score, 0), 7) AS score FROM docs a JOIN docs b ON a.source = b.source AND a.article_id % {EVERY} = 0
LEFT JOIN (SELECT query_id, article_id, sum(qtf * weight) AS score FROM q JOIN post USING (term) GROUP BY 1, 2) s ON s.query_id = a.article_id AND s.article_id = b.article_id""",
        ),
    ),
    "bm25_topk": (bm25_topk, sql(LEXICAL, _source(1), _TOKENS, _QUERY, _postings(), body=f"SELECT query_id, article_id, round(score, 7) AS score, rank FROM {_ranked(10)}")),
    "title_weighted_bm25": (title_weighted_bm25, sql(LEXICAL, _source(3), _TOKENS, _QUERY, _postings(), body=f"SELECT query_id, article_id, round(score, 7) AS score, rank FROM {_ranked(10)}")),
    "bm25_param_grid": (
        bm25_param_grid,
        sql(
            LEXICAL,
            _source(1),
            _TOKENS,
            _QUERY,
            *[_postings(k1, b, f"post{i}") for i, (k1, b) in enumerate(GRID)],
            body=" UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, count(*) AS n, round(avg(score), 7) AS mean_score FROM {_ranked(10, f'post{i}')}" for i, (k1, b) in enumerate(GRID)),
        ),
    ),
    "weighted_query_terms": (weighted_query_terms, sql(LEXICAL, _QUERY, body="SELECT query_id, term, tf FROM (SELECT query_id, term, (qtf * round_even(3 * (1.0 / (1 + query_id % 3)), 0))::BIGINT AS tf FROM q) WHERE tf > 0")),
    "fuse_corpus_rrf": (
        fuse_corpus_rrf,
        f"""SELECT query_id, article_id, round(score, 10) AS score, rank FROM (
  SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, article_id) AS rank FROM (
    SELECT query_id, article_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
      SELECT query_id, article_id, rank FROM ({sql(LEXICAL, _source(1), _TOKENS, _QUERY, _postings(), body=f'SELECT * FROM {_ranked(20)}')})
      UNION ALL
      SELECT query_id, article_id, rank FROM ({sql(LEXICAL, _source(3), _TOKENS, _QUERY, _postings(), body=f'SELECT * FROM {_ranked(20)}')})
    ) GROUP BY 1, 2)) WHERE rank <= 10""",
    ),
}
