"""Quality rules: counts of a text's form, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed word uni- and bigrams are counted: one over all documents, one over trusted documents (of
good quality by their labels), mixed with the raw one so that n-grams it has not seen keep a share. A document's score is its
log-likelihood ratio divided by its number of n-grams; a trusted document is scored by a trusted model without itself. The
threshold is the score below which a fixed, small share of the trusted documents lies; every document is held against it, nothing
is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, labels, materialize, small, text_of
from .wordhash import U, WHITE, Words, mix, per_doc, range_hashes, text_buffer

BITS = 20
#: Weight of the raw shares in the trusted model, as a multiple of its own n-grams.
MIX = 1.0
#: Share of the trusted documents (of those that pass the base rules) that may score below the threshold, and the width of the steps
#: in which it is found.
QUANTILE, STEP = 0.001, 1e-4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The five counts of every text."""
    buf, offsets, n = w.buf, w.offsets, len(w.offsets) - 1
    # lines: pieces between line feeds, of which those with a word count
    feed = buf == 10
    cuts = np.flatnonzero(feed)
    starts = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    ends = np.sort(np.concatenate([offsets[1:], cuts]))
    inside = np.concatenate(([0], np.cumsum(w.inner, dtype=np.int64)))
    full = (ends > starts) & (inside[ends] > inside[starts])
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.unique(range_hashes(buf, starts, ends) ^ mix(doc.astype(np.uint64) + U(1)), return_index=True)[1]
    dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[lines], minlength=n)
    # words in windows of three that are found again
    h, at = w.grams(3)
    h = h ^ mix(w.doc[at].astype(np.uint64) + U(1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(w.hash) + 2, bool)
    for k in range(3):
        covered[at[again] + k] = True
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_doc(w.inner & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": per_doc(_SYMBOL[buf], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(w.doc[covered[: len(w.hash)]], minlength=n),
    }


def buckets(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and pair of words."""
    pairs, at = w.grams(2)
    return (np.concatenate([w.hash, pairs]) >> U(64 - bits)).astype(np.int64), np.concatenate([w.doc, w.doc[at]])


def _marked(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, text, trusted: every document labelled good is trusted."""
    good = labelled.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    text = docs.select("doc_id", text_of().alias("text"))
    return text.join(small(good), F.col("doc_id") == F.col("_good"), "left").select("doc_id", "text", F.col("_good").isNotNull().alias("trusted"))


class Ratio:
    """Counts of every bucket over all and over trusted documents, and scores from them."""

    def __init__(self, raw: np.ndarray, good: np.ndarray, mix: float = MIX):
        self.good, self.total, self.mix = good, float(good.sum()), mix
        self.share = (raw + 1) / (raw.sum() + len(raw))
        self.none = not raw.sum() or not good.sum()  # nothing trusted: no ratio, every document scores 0
        self.bits = int(len(raw)).bit_length() - 1

    def scores(self, bucket: np.ndarray, doc: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        n = np.bincount(doc, minlength=len(trusted))
        if self.none:
            return np.zeros(len(trusted))
        key, c = np.unique((doc << self.bits) | bucket, return_counts=True)
        doc, bucket = key >> self.bits, key & ((1 << self.bits) - 1)
        own = np.where(trusted[doc], c, 0)
        size = self.total * self.mix
        ratio = np.log((self.good[bucket] - own + size * self.share[bucket]) / (self.total - np.where(trusted, n, 0)[doc] + size)) - np.log(self.share[bucket])
        return np.bincount(doc, c * ratio, minlength=len(trusted)) / np.maximum(n, 1)


def fit_ratio(docs: DataFrame, labelled: DataFrame, bits: int = BITS, mix: float = MIX) -> Ratio:
    """Both counts cover all their documents; a task sends the sums of the buckets it has met, 2**bits at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in blocks(batches):
            bucket, doc = buckets(Words(*text_buffer(b.column("text"))), bits)
            np.add.at(raw, bucket, 1)
            np.add.at(good, bucket[b.column("trusted").to_numpy(zero_copy_only=False)[doc]], 1)
        used = np.flatnonzero(raw)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(good[part])], names=["bucket", "raw", "good"])

    sums = _marked(docs, labelled).mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in sums.toArrow().to_batches():  # 2**bits rows at most
        at = np.asarray(r.column(0))
        raw[at], good[at] = np.asarray(r.column(1)), np.asarray(r.column(2))
    return Ratio(raw, good, mix)


def scored(docs: DataFrame, labelled: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, the base counts, base_failed, llr, trusted: one row per input row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratio)  # two numbers for each of the 2**bits buckets

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            w = Words(*text_buffer(b.column("text")))
            base = base_counts(w)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            llr = shipped.value.scores(*buckets(w, shipped.value.bits), b.column("trusted").to_numpy(zero_copy_only=False))
            columns = [b.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(llr), b.column("trusted")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "llr", "trusted"])

    kinds = ", ".join(f"{k} long" for k in BASE)
    return _marked(docs, labelled).mapInArrow(judge, f"doc_id long, {kinds}, base_failed boolean, llr double, trusted boolean")


def threshold_of(rows: DataFrame, quantile: float = QUANTILE) -> float:
    """The lower end of the step of scores in which the trusted documents' quantile lies; without any, nothing is below it."""
    steps = rows.where("trusted and not base_failed").groupBy(F.floor(F.col("llr") / STEP).alias("step")).count().collect()  # as many as steps
    before, total = 0, sum(r["count"] for r in steps)
    for r in sorted(steps, key=lambda r: r["step"]):
        before += r["count"]
        if before > quantile * total:
            return r["step"] * STEP
    return float("-inf")


def quality_rules(docs: DataFrame, labelled: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base counts, base_failed, llr, kept: one row per input row.

    Defined results: null text counts as empty, has no words and fails; repeated rows get equal results; without
    trusted documents every ratio is 0 and nothing is dropped for it; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = materialize(scored(docs, labelled, fit_ratio(docs, labelled)), "quality-scores")  # numbers only
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold_of(rows, quantile)))
    return rows.select("doc_id", *BASE, "base_failed", "llr", kept.alias("kept"))


SQL_BASE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS tag, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t
), l AS (
  SELECT tag, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT tag, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY tag
), g AS (
  SELECT tag, i, count(*) OVER (PARTITION BY tag, a, b, c) AS n
  FROM (SELECT tag, unnest(range(len(w) - 2)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM w WHERE len(w) >= 3)
), r AS (
  SELECT tag, count(DISTINCT place) AS n_repeat_words FROM (SELECT tag, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY tag
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN l USING (tag) LEFT JOIN r USING (tag)
"""


def op10_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_llr_quality(spark, sf_dir).select("doc_id", *BASE, "base_failed")
