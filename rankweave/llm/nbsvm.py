"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators of word and word-shape n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model over
the scaled, length-normalised vectors is fitted by dual coordinate descent, and its margin is turned into a probability
by a logistic curve fitted on sample rows that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, labels, text_of
from .wordhash import U, Words, grams, mix, text_buffer, unique_rows

BITS = 18
#: Most labelled documents that the model is fitted on, half of them for each class (smallest hashes of the ids first).
SAMPLE = 4_000
#: Passes of the dual coordinate descent, and its cost parameter.
PASSES, COST = 12, 1.0
#: Added to every count.
ALPHA = 1.0

# bits of a byte's shape: lower, upper, digit, usual marks, other ASCII, other scripts
_SHAPE = np.full(256, 16, np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 4, 32
_SHAPE[list(b".,;:!?'\"()-")] = 8
_SHAPE[[32, 9, 10, 11, 12, 13]] = 0


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs: words, word pairs, and runs of one to three word shapes. A shape is the kinds
    of characters in a word, and whether it repeats the word before or the one before that."""
    parts = [(w.hash, np.arange(len(w.hash))), w.grams(2)]
    if len(w.hash):
        shape = np.bitwise_or.reduceat(_SHAPE[w.buf], w.start).astype(np.uint64)
        for back, flag in ((1, 64), (2, 128)):
            if len(w.hash) > back:
                same = (w.hash[back:] == w.hash[:-back]) & (w.doc[back:] == w.doc[:-back])
                shape[back:] |= same.astype(np.uint64) * U(flag)
        shape = mix(shape + U(977))
        parts += [grams(shape, w.doc, k) for k in (1, 2, 3)]
    doc = np.concatenate([w.doc[at] for _, at in parts])
    bucket = np.concatenate([mix(h + U(k)) >> U(64 - bits) for k, (h, _) in enumerate(parts)])
    return unique_rows(doc, bucket, bits)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that a row belongs to."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def bounded_sample(docs: DataFrame, labelled: DataFrame, label: str, keep: Column, most: int, extract, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature lists and labels of at most ``most`` labelled rows, up to half for each class, the same in every run."""
    ids: dict[int, int] = {}
    usable = labelled.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label))
    for y in (0, 1):
        part = usable.where(F.col(label) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        ids |= {r.doc_id: y for r in part.select("doc_id").collect()}
    if not ids:
        return [], np.zeros(0, int)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            doc, bucket = extract(Words(*text_buffer(b.column("text"))))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "f"])

    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", text_of().alias("text"))  # at most SAMPLE ids
    table = rows.mapInArrow(run, "doc_id long, f array<int>").toArrow()
    got = sorted(zip(table["doc_id"].to_pylist(), (np.asarray(x.values, dtype=np.int64) for x in table["f"])), key=lambda x: (x[0], len(x[1])))
    return [f for _, f in got], np.array([ids[i] for i, _ in got], int)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dims: int) -> np.ndarray:
    counts = [np.full(dims, ALPHA), np.full(dims, ALPHA)]
    for f, c in zip(rows, y):
        counts[c][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, passes: int = PASSES, cost: float = COST) -> np.ndarray:
    """Weights of min 1/2 |w|^2 + C sum max(0, 1 - y w.x), x the scaled unit vectors with a constant in the last place."""
    w = np.zeros(len(r) + 1)
    xs = [r[f] / max(np.linalg.norm(r[f]), 1e-12) for f in rows]
    alpha, sign, rng = np.zeros(len(rows)), 2 * y - 1, np.random.default_rng(1)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            f, x, s = rows[i], xs[i], sign[i]
            step = (1 - s * (w[f] @ x + w[-1])) / (x @ x + 1)
            new = min(max(alpha[i] + step, 0.0), cost)
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * s * x
                w[-1] += (new - alpha[i]) * s
                alpha[i] = new
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps with a small ridge; smoothed targets keep it finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * margin).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Per bucket the ratio and its product with the hinge weight; the constant; the curve."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, share: float, bits: int = BITS):
        self.constant = None
        if len(set(y.tolist())) < 2:  # nothing to tell apart: every score is the share of the class
            self.constant = float(y[0]) if len(y) else 0.5
            return
        part = np.arange(len(y)) % 5 == 4
        if len(set(y[part].tolist())) < 2:
            part[:] = False
        fit = [f for f, out in zip(rows, part) if not out]
        self.ratio = log_count_ratio(fit, y[~part], 1 << bits)
        w = dual_coordinate_descent(fit, y[~part], self.ratio)
        self.weight, self.bias = w[:-1] * self.ratio, w[-1]
        seen = part if part.any() else ~part
        held = [f for f, out in zip(rows, seen) if out]
        margin = np.array([self.weight[f].sum() / max(np.linalg.norm(self.ratio[f]), 1e-12) + self.bias for f in held])
        # the sample has the classes in other shares than the rows
        prior = np.where(y[seen] == 1, share / max(y[seen].mean(), 1e-9), (1 - share) / max(1 - y[seen].mean(), 1e-9))
        self.curve = logistic_curve(margin, y[seen], prior)

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        length = np.sqrt(np.bincount(doc, self.ratio[bucket] ** 2, minlength=n))
        margin = np.bincount(doc, self.weight[bucket], minlength=n) / np.maximum(length, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def fit(docs: DataFrame, labelled: DataFrame, keep: Column, label: str = "quality", most: int = SAMPLE) -> Model:
    rows, y = bounded_sample(docs, labelled, label, keep, most, features, BITS)
    share = labelled.where(keep & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return Model(rows, y, 0.5 if share is None else min(max(share, 0.01), 0.99))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per input row, from the text alone. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = model.scores(*features(Words(*text_buffer(b.column("text")))), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labelled: DataFrame, folds: int = 3, out: int = 1, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Labels are learned only from rows of the other folds. Defined results: null, empty and blank texts have no features
    and get the score of the constant alone; repeated rows get equal scores; a null id is in no fold (not held out);
    without labels of both classes every score is constant; other columns are ignored.
    """
    model = fit(docs, labelled, fold("doc_id", folds) != out)
    held = F.coalesce(fold("doc_id", folds) == out, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def keep_good(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns of ``docs``: scored and filtered in one pass, so no
    join brings the texts together again."""
    model = fit(docs, labelled, fold("doc_id", 3) != 1)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # by place: whatever the columns are called
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit("")).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = model.scores(*features(Words(*text_buffer(b.column("text")))), b.num_rows)
            yield b.filter(pa.array(s >= 0.5)).drop_columns(["text"])

    return inner.select("*", text).mapInArrow(run, inner.schema).toDF(*docs.columns)
