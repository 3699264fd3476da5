"""Toxicity classifier with counterfactual regularisation.

A logistic model over hashed word, word-pair and word-beginning indicators. The sample's texts that mention an identity, and texts
of which one sentence is said again with a neutral mention set into it (a term of one of four languages; term, sentence and place
are drawn by a hash, and the text keeps its label: naming a group is no sign of toxicity), are rows of the fit like the others.
For each of them the mention is swapped for another of its kind, and a penalty on the squared difference of the two scores (the logits) joins the
loss, so that a score does not hang on which group is named. Buckets of identity terms, and of the word pairs that such terms make
in the sample, always have a weight of their own, so the penalty acts on what it is about.

The sample's rows are cut down to the buckets that can carry weight before they come to the driver: first counts per bucket,
then the rows' own lists.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, labels, materialize, text_of
from .nbsvm import fold
from .wordhash import LOWER, NOT_LETTER, U, Words, mix, range_hashes, text_buffer, unique_rows

BITS = 18
#: Most labelled documents that the model is fitted on, half of them for each class (smallest hashes of the ids first). Each gives
#: one row, and one more with a mention.
SAMPLE = 8_000
#: Weight of the squared score changes under swaps, and of the squared weights.
SWAP, RIDGE = 1.0, 1e-4
ROUNDS = 100
#: Least G statistic of a bucket that carries weight, and least rows with a mention for a word pair to carry weight without it.
LEAST_ASSOCIATION, LEAST_ROWS = 20.0, 3
#: Lengths in bytes of the word beginnings that count.
HEADS = (5, 6, 8)

#: Terms of one kind may take each other's place.
IDENTITIES = (
    # English
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
    # French
    ("femmes", "hommes", "filles", "gar\u00e7ons"),
    ("musulmans", "chr\u00e9tiens", "juifs", "bouddhistes", "ath\u00e9es"),
    ("homosexuels", "lesbiennes", "bisexuels"),
    ("immigr\u00e9s", "r\u00e9fugi\u00e9s", "\u00e9trangers"),
    ("noirs", "blancs", "asiatiques", "africains"),
    # German
    ("frauen", "m\u00e4nner", "m\u00e4dchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle"),
    ("einwanderer", "fl\u00fcchtlinge", "ausl\u00e4nder"),
    ("schwarze", "wei\u00dfe", "asiaten", "afrikaner"),
    # Spanish
    ("mujeres", "hombres", "ni\u00f1as", "ni\u00f1os"),
    ("musulmanes", "cristianos", "jud\u00edos", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("negros", "blancos", "asi\u00e1ticos", "africanos"),
)
NEUTRAL = ("my neighbours are {}", "many {} people live here", "she met a group of {} friends")
_GROUP = {t: g for g in IDENTITIES for t in g}
_TERMS = [t for g in IDENTITIES for t in g]
_NEXT = {t: g[(g.index(t) + 1) % len(g)] for t, g in _GROUP.items()}
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def swap_identities(text: str) -> str:
    """Every identity term replaced by the next of its kind."""
    return _WORD.sub(lambda m: _NEXT.get(m[0].lower(), m[0]), text)


def names_identity(text: str) -> bool:
    return not _GROUP.keys().isdisjoint(_WORD.findall(text.lower()))


def mention(text: str, draw: int) -> str:
    """One of the text's sentences with an identity term set in front of one of its words; ``draw`` chooses term, sentence and word."""
    term, draw = _TERMS[draw % len(_TERMS)], draw // len(_TERMS)
    found = [m[0] for m in _SENTENCE.finditer(text) if m[0].strip()]
    if not found:
        return term
    s, draw = found[draw % len(found)], draw // len(found)
    words = list(re.finditer(r"\S+", s))
    at = words[draw % len(words)].start()
    return f"{s[:at]}{term} {s[at:]}"


def words_of(column: pa.Array) -> Words:
    raw, offsets = text_buffer(column)
    return Words(LOWER[raw], offsets, NOT_LETTER)


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of words, word pairs and word beginnings."""
    parts = [(w.hash, w.doc)]
    pairs, at = w.grams(2)
    parts.append((pairs, w.doc[at]))
    for n in HEADS:
        long = np.flatnonzero(w.end - w.start > n)
        parts.append((range_hashes(w.buf, w.start[long], w.start[long] + n), w.doc[long]))
    bucket = np.concatenate([mix(h + U(31 * k)) >> U(64 - bits) for k, (h, _) in enumerate(parts)])
    return unique_rows(np.concatenate([d for _, d in parts]), bucket, bits)


def feature_list(text: str) -> np.ndarray:
    return features(words_of(pa.array([text])))[1]


@functools.lru_cache(1)
def identity_buckets() -> np.ndarray:
    """Buckets of the terms themselves and of their beginnings."""
    return np.unique(np.concatenate([feature_list(t) for t in _TERMS]))


def neutral_rows() -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Plain sentences about every identity, class 0, and the swaps among them."""
    rows = [feature_list(t.format(i)) for i in _TERMS for t in NEUTRAL]
    return rows, [(feature_list(t.format(a)), feature_list(t.format(b))) for t in NEUTRAL for g in IDENTITIES for a, b in zip(g, g[1:])]


class Model:
    """Weights per bucket and a constant. ``pairs`` are a row's features and those after the swap; ``use`` the buckets that may
    carry weight (by default those associated with the class, the identities' and those of their word pairs)."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, share: float, pairs: list[tuple[np.ndarray, np.ndarray]], swap: float = SWAP, ridge: float = RIDGE, use: np.ndarray | None = None):
        self.w, self.b = np.zeros(1 << BITS), 0.0
        if len(set(y.tolist())) < 2:
            self.b = 30.0 * (2 * y[0] - 1) if len(y) else 0.0
            return
        if use is None:
            use = carriers(*bucket_counts(rows, y), np.bincount((y == 1).astype(int), minlength=2), pair_counts(pairs))
        neutral, more = neutral_rows()
        rows, y, pairs = rows + neutral, np.concatenate([y, np.zeros(len(neutral), int)]), pairs + more
        place = np.full(1 << BITS, -1)
        place[use] = np.arange(len(use))
        loss = Loss([place[f][place[f] >= 0] for f in rows], y, share, [tuple(p[p >= 0] for p in (place[np.setdiff1d(f, g)], place[np.setdiff1d(g, f)])) for f, g in pairs], len(use), swap, ridge)
        v = minimize(loss, np.append(np.zeros(len(use)), np.log(share / (1 - share))))
        self.w[use], self.b = v[:-1], v[-1]

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, self.w[bucket], minlength=n) + self.b, -30, 30)))


class Loss:
    """Value and gradient of the weighted logistic loss plus ``swap`` times the mean squared score change of the pairs (buckets
    only before, buckets only after the swap) plus the ridge; the last place of ``v`` is the constant."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, share: float, pairs: list[tuple[np.ndarray, np.ndarray]], dims: int, swap: float, ridge: float):
        self.y, self.swap, self.ridge, self.dims = y, swap, ridge, dims
        self.row, self.col = _flat(rows)
        gone, new = _flat([p[0] for p in pairs]), _flat([p[1] for p in pairs])
        self.pair, self.bucket = np.concatenate([gone[0], new[0]]), np.concatenate([gone[1], new[1]])
        self.sign = np.concatenate([np.ones(len(gone[0])), -np.ones(len(new[0]))])
        self.n, self.m = len(rows), max(len(pairs), 1)
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        self.weight = weight / weight.sum()

    def changes(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, self.sign * w[self.bucket], minlength=self.m)

    def __call__(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = v[:-1], np.bincount(self.row, v[:-1][self.col], minlength=self.n) + v[-1]
        g, change = self.weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y), self.changes(w)
        grad = np.bincount(self.col, g[self.row], minlength=self.dims) + self.ridge * w
        grad += 2 * self.swap / self.m * np.bincount(self.bucket, self.sign * change[self.pair], minlength=self.dims)
        value = (self.weight * (np.logaddexp(0, z) - self.y * z)).sum() + self.ridge / 2 * w @ w + self.swap / self.m * (change @ change)
        return value, np.append(grad, g.sum())


def bucket_counts(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of either class have each bucket."""
    return tuple(np.bincount(_flat([f for f, c in zip(rows, y) if c == k])[1], minlength=1 << BITS) for k in (0, 1))


def pair_counts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """In how many pairs each bucket differs."""
    return np.bincount(_flat([np.setxor1d(f, g) for f, g in pairs])[1], minlength=1 << BITS)


def association(seen: tuple[np.ndarray, np.ndarray], total: np.ndarray) -> np.ndarray:
    """G statistic of every bucket's presence against the class."""
    out, n = np.zeros(1 << BITS), max(int(total.sum()), 1)
    share = (seen[0] + seen[1]) / n
    for c in (0, 1):
        for got, expected in ((seen[c], total[c] * share), (total[c] - seen[c], total[c] * (1 - share))):
            out += 2 * got * np.log(np.where(got > 0, got / np.maximum(expected, 1e-12), 1.0))
    return out


def carriers(seen0: np.ndarray, seen1: np.ndarray, total: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """The buckets that carry weight: those that depend on the class beyond chance, the identities' own, and those in which swaps
    of several rows differ (the identities' word pairs)."""
    keep = (association((seen0, seen1), total) > LEAST_ASSOCIATION) | (differs >= LEAST_ROWS)
    keep[identity_buckets()] = True
    return np.flatnonzero(keep)


def minimize(loss, v: np.ndarray, rounds: int = ROUNDS, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking, for a smooth convex loss returning (value, gradient)."""
    value, grad = loss(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            kept.append(a := (s @ q) / (s @ y))
            q -= a * y
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        size, slope = (1.0 if steps else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))), -(grad @ q)
        while True:
            new, new_grad = loss(v - size * q)
            if new <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = -size * q, new_grad - grad
        done = value - new < 1e-7 * max(abs(value), 1e-3)
        v, value, grad = v + s, new, new_grad
        if done:
            break
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
    return v


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of lists of values."""
    return np.repeat(np.arange(len(rows)), [len(f) for f in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)


def sample_rows(docs: DataFrame, labelled: DataFrame, keep: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, y, f, g: the sampled texts' features (g null), and once more with a mention (g: after the swap)."""
    spark = docs.sparkSession
    usable = labelled.where(keep & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids: list[tuple[int, int]] = []
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        ids += [(r.doc_id, y) for r in part.select("doc_id").collect()]
    chosen = spark.createDataFrame(ids, "_id long, _y int")  # ``most`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts = b.column("text").to_pylist()
            real = np.array([names_identity(t) for t in texts], bool)
            said = ["" if r else mention(t, zlib.crc32(t.encode())) for t, r in zip(texts, real)]
            # the text; the sentence said again; the swapped text, or the swapped sentence
            own, again, other = (
                np.split(bucket, np.searchsorted(doc, np.arange(1, b.num_rows)))
                for doc, bucket in (features(words_of(pa.array(c, pa.large_string()))) for c in (texts, said, [swap_identities(t if r else s) for t, s, r in zip(texts, said, real)]))
            )
            whole = [o if r else np.union1d(o, x) for o, x, r in zip(own, again, real)]
            swapped = [x if r else np.union1d(o, x) for o, x, r in zip(own, other, real)]
            lists = [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in (own, whole, swapped)]
            for f, g in ((lists[0], pa.nulls(b.num_rows, pa.list_(pa.int32()))), (lists[1], lists[2])):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), f, g], names=["doc_id", "y", "f", "g"])

    texts = docs.select("doc_id", text_of().alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_y").alias("y"), "text")
    return materialize(rows.mapInArrow(run, "doc_id long, y int, f array<int>, g array<int>"), "toxicity-sample")


def fit(docs: DataFrame, labelled: DataFrame, keep: Column, most: int = SAMPLE, swap: float = SWAP) -> Model:
    rows = sample_rows(docs, labelled, keep, most)
    # two lists of sums per bucket, then only the buckets that carry weight
    seen, differs, total = [np.zeros(1 << BITS, np.int64) for _ in (0, 1)], np.zeros(1 << BITS, np.int64), np.zeros(2, np.int64)
    differing = F.concat(F.array_except("f", "g"), F.array_except("g", "f"))
    counts = rows.select("y", F.explode("f").alias("b")).groupBy("y", "b").count()
    for r in counts.where(f"count >= {LEAST_ROWS}").toArrow().to_batches():  # 2**BITS rows of each class at most; rarer ones cannot pass
        y, b, n = (np.asarray(r.column(i)) for i in range(3))
        for c in (0, 1):
            seen[c][b[y == c]] = n[y == c]
    for r in rows.where("g is not null").select(F.explode(differing).alias("b")).groupBy("b").count().where(f"count >= {LEAST_ROWS}").toArrow().to_batches():
        differs[np.asarray(r.column(0))] = np.asarray(r.column(1))
    for r in rows.groupBy("y").count().collect():
        total[r["y"]] = r["count"]
    use = carriers(*seen, total, differs)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [pa.array([None if x is None else np.intersect1d(x, use).astype(np.int32) for x in b.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("f", "g")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *lists], names=["doc_id", "y", "f", "g"])

    table = rows.mapInArrow(slim, "doc_id long, y int, f array<int>, g array<int>").toArrow()
    got = sorted(table.to_pylist(), key=lambda r: (r["doc_id"], r["g"] is not None, r["f"], r["g"] or []))
    lists = [np.array(r["f"], np.int64) for r in got]
    pairs = [(f, np.array(r["g"], np.int64)) for f, r in zip(lists, got) if r["g"] is not None]
    share = labelled.where(keep & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    share = 0.5 if share is None else min(max(share, 0.01), 0.99)
    return Model(lists, np.array([r["y"] for r in got], int), share, pairs, swap, use=use)


def toxicity_scores(docs: DataFrame, labelled: DataFrame, folds: int = 4, out: int = 2, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Labels are learned only from rows of the other folds. Defined results: null, empty and blank texts have no features
    and get the constant's score; repeated rows get equal scores; a null id is in no fold (not held out); without labels
    of both classes every score is constant; other columns are ignored.
    """
    model = fit(docs, labelled, fold("doc_id", folds) != out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = model.scores(*features(words_of(b.column("text"))), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", folds) == out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))
