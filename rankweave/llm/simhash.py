"""SimHash near-duplicates through a forest of vantage-point trees.

Texts become fingerprints; equal fingerprints collapse to one point, so copies are never paired. Points at most ``RADIUS``
bits apart (of 64) are found exactly:

* A tree partitions points by Hamming distance to vantage points (at most the median: left, else right). On a search
  with radius r a branch is pruned if the triangle bound ``|d(q, v) - mu| > r`` rules it out, else both sides are
  visited: a query goes to every shard whose border its ball overlaps, a member lies in exactly one.
* Distances of random bits crowd around the median, so with r = 2 over whole fingerprints nearly half of all queries would go
  down both sides at every level, and even r = 1 over half of the bits makes the visits grow as a power of the points. Two
  points at most 2 bits apart agree on two of four quarters of 16 bits at least, so each of the six trees of ``BANDS`` measures
  two quarters, where radius 0 suffices: a ball lies on one side of every border, and a point visits six shards at any size.
  Where points agree in their band (a dense cluster), a node measures all bits with r = 2 instead; there balls do overlap borders.
* A tree is grown on a bounded sample; leaves that hold more than a shard's worth are dealt out further by the band's value,
  which loses nothing, since a tree has to find only those pairs that agree on its band.
* Inside a shard, candidates are looked up in the sorted band and checked on all bits; for points with very many candidates
  the 2,080 flips of the whole fingerprint are looked up instead, so that a dense cluster costs time in proportion to its
  points. Only a spanning forest of the pairs leaves the shard.

Components of the shards' forests are joined by alternating large-star and small-star steps on tables.

``keep_one`` is the pipeline's stage: texts whose sets of 5-word runs have a Jaccard similarity of 0.8 or more. At most 15 % of such
texts' fingerprint bits differ on average, which no radius of a few bits reaches, and a ball so wide prunes nothing in a tree. So the
stage has its own forest: fingerprints of 512 bits, and trees that each measure a few of them at radius 0 - just as many as give shards
of a bounded size. A text visits one shard of each tree, and there every pair is compared on all bits: the trees need not agree on
what is near, only bring a near pair together once (``MISS``). What leaves a shard are its clusters, a row for each text, no pairs.

Exact steps follow. Runs that no other candidate has cannot be shared, so with c the other and own the lone runs of x and y the
similarity is at most min(c) / (own of x + own of y + max(c)); and with the other runs dealt to counters, the runs that only one of the
two has are at least own of x + own of y + the sum of the counters' differences. Full sets decide. A cluster is first worked off by
leaders - every text against a few texts of its clusters - and only texts that are still in different components are paired, those with
many lone runs only with those that have few enough, so a large group of near copies costs time in proportion to its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, columns_of_row, documents, materialize, small, text_of, whole_row
from .wordhash import LOWER, U, Words, mix, text_buffer

RADIUS, BAND_RADIUS = 2, 0
SHINGLE = 3
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Two of four quarters of the bits.
BANDS = tuple(np.uint64((0xFFFF << 16 * i) | (0xFFFF << 16 * j)) for i, j in combinations(range(4), 2))
#: Points aimed at in a shard, least and most leaves of a tree (leaves beyond them are dealt out by value), and the most points that
#: a forest is fitted on.
SHARD, LEAST_SHARDS, MOST_SHARDS, SAMPLE = 50_000, 16, 1024, 200_000
_FLIPS = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)], dtype=np.uint64)


# ---- fingerprints


def fingerprint(text: str | bytes | None, chunk: int = 50_000) -> int:
    """The unsigned fingerprint of one text; a long text is hashed in pieces."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # bytes: A-Z and these six only
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), chunk):
        hs = np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + chunk], ends[i : i + chunk])], dtype="<u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        fp = [fingerprint(t.as_buffer().to_pybytes()) for t in b.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null text counts as empty (fingerprint 0)."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- the forest


class Tree:
    """One vantage-point tree in arrays; a child below zero is the shard ``-child - 1``."""

    def __init__(self, sample: np.ndarray, band: np.uint64, shards: int, whole: bool = True):
        self.masks = (band, FULL) if whole else (band,)
        self.vp: list[int] = []
        self.mask: list[int] = []
        self.mu: list[int] = []
        self.child: list[list[int]] = []
        self.shards = 0
        least = max(1, len(sample) // shards)
        self.root = self._grow(sample, least, int(np.ceil(np.log2(max(2, shards)))) + 4)
        self.vp, self.mask = np.array(self.vp, np.uint64), np.array(self.mask, np.uint64)
        self.mu, self.child = np.array(self.mu, np.int16), np.array(self.child, np.int32).reshape(-1, 2)

    def _grow(self, points: np.ndarray, least: int, depth: int) -> int:
        if len(points) > least and depth > 0:
            for mask in self.masks:
                for v in points[[0, len(points) // 3, 2 * len(points) // 3]]:
                    d = np.bitwise_count((points ^ v) & mask)
                    mu = int(np.median(d))
                    left = d <= mu
                    if 0.25 <= left.mean() <= 0.75:
                        node = len(self.vp)
                        self.vp.append(int(v))
                        self.mask.append(int(mask))
                        self.mu.append(mu)
                        self.child.append([0, 0])
                        self.child[node] = [self._grow(points[left], least, depth - 1), self._grow(points[~left], least, depth - 1)]
                        return node
        self.shards += 1
        return -self.shards

    def visit(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index, shard, home) of every shard that each point's ball reaches; home where the point itself lies."""
        at, node, home = np.arange(len(points)), np.full(len(points), self.root, np.int32), np.ones(len(points), bool)
        while True:
            done = node < 0
            if done.any():
                yield at[done], -node[done] - 1, home[done]
                at, node, home = at[~done], node[~done], home[~done]
            if not len(at):
                return
            d = np.bitwise_count((points[at] ^ self.vp[node]) & self.mask[node]).astype(np.int16)
            r, mu = np.where(self.mask[node] == FULL, RADIUS, BAND_RADIUS).astype(np.int16), self.mu[node]
            go = [d - r <= mu, d + r > mu]  # the triangle bounds
            own = [d <= mu, d > mu]
            at, home, node = (
                np.concatenate([at[g] for g in go]),
                np.concatenate([(home & o)[g] for g, o in zip(go, own)]),
                np.concatenate([self.child[node[g], k] for k, g in enumerate(go)]),
            )


def build_forest(sample: np.ndarray, n: int) -> list[Tree]:
    shards = min(max(LEAST_SHARDS, -(-n // SHARD)), MOST_SHARDS)
    return [Tree(sample, band, shards) for band in BANDS]


def splits(tree: Tree, sample: np.ndarray, n: int, most: int | None = None) -> np.ndarray:
    """Into how many parts the members of each leaf are dealt out by their band's value, from the sample's share of ``n`` points."""
    held = np.zeros(tree.shards, np.int64)
    for _, shard, _ in tree.visit(sample):
        held += np.bincount(shard, minlength=tree.shards)
    return np.maximum(1, np.ceil(held * (n / max(len(sample), 1)) / (most or SHARD))).astype(np.int64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs into the labels; a label is the smallest index of its set."""
    while True:
        la, lb = label[a], label[b]
        far = la != lb
        if not far.any():
            return label
        a, b, la, lb = a[far], b[far], la[far], lb[far]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def shard_forest(members: np.ndarray, queries: np.ndarray, band: np.uint64, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) of a spanning forest of all pairs member < query at most RADIUS bits apart."""
    points = np.unique(np.concatenate([members, queries]))
    members, queries = np.unique(members), np.unique(queries)
    label, key = np.arange(len(points)), members & band
    order = np.argsort(key, kind="stable")
    key, members = key[order], members[order]
    lo, hi = np.searchsorted(key, queries & band, "left"), np.searchsorted(key, queries & band, "right")
    dense = hi - lo > 4 * len(_FLIPS)

    def take(q: np.ndarray, m: np.ndarray) -> None:
        nonlocal label
        ok = (m < q) & (np.bitwise_count(q ^ m) <= RADIUS)
        if ok.any():
            label = _merge(label, np.searchsorted(points, q[ok]), np.searchsorted(points, m[ok]))

    todo = np.flatnonzero((hi > lo) & ~dense)
    ends = np.cumsum((hi - lo)[todo])
    start = 0
    while start < len(todo):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block, "right")))
        part = todo[start:stop]
        n = (hi - lo)[part]
        first = np.repeat(lo[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        take(np.repeat(queries[part], n), members[first + np.arange(n.sum())])
        start = stop
    if dense.any():
        ordered, many = np.sort(members), queries[dense]
        for f in _FLIPS:
            at = np.minimum(np.searchsorted(ordered, many ^ f), len(ordered) - 1)
            hit = ordered[at] == many ^ f
            take(many[hit], ordered[at[hit]])
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def near_pairs_forest(points: DataFrame) -> DataFrame:
    """a, b: edges among the distinct ``fp`` of a written table, spanning every component of the near pairs."""
    n = points.count()
    keep = min(1.0, SAMPLE / max(n, 1))
    sample = points if keep == 1.0 else points.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(keep * 1_000_000))
    sample = np.sort(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64))  # bounded: SAMPLE
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    forest = build_forest(sample, n) if n else []
    parts = [splits(t, sample, n) for t in forest]
    starts = [np.concatenate(([0], np.cumsum(p)[:-1])) for p in parts]
    first = np.cumsum([0] + [int(p.sum()) for p in parts])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            for k, tree in enumerate(forest):
                value = mix((fp & BANDS[k]) + np.uint64(k + 1))
                for at, leaf, home in tree.visit(fp):
                    shard = first[k] + starts[k][leaf] + (value[at] % parts[k][leaf].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        band = BANDS[int(np.searchsorted(first, key[0], "right")) - 1]
        a, b = shard_forest(fp[pdf["home"].to_numpy()], fp, band)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.mapInArrow(visits, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(search, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """v, root (smallest vertex of its component) of every vertex with an edge that is not a root itself. Every round is written to the
    shared folder; hubs are pre-aggregated, and their edges may be split by adaptive execution."""
    edges = materialize(edges.where("a <> b").distinct(), "cc-edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = down.join(least, "a")
        edges = materialize(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-round")
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("child")))
        ends = ends.groupBy("v").agg(F.sum("child").alias("children"), F.min("child").alias("root"))
        if not ends.where("children > 1 or (children = 1 and root = 0)").limit(1).count():  # stars: each vertex hangs on a root, once
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    raise RuntimeError("components: no fixed point")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, fp: one row per input row.

    Defined results: null, empty and blank texts have fingerprint zero and link like any other; repeated rows are in
    one component; a component's id is its smallest doc_id that is not null, null if there is none; an empty table
    gives an empty result; other columns are ignored.
    """
    marked = materialize(fingerprints(docs), "simhash")
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-points")
    roots = components(near_pairs_forest(points.select("fp")))
    grouped = points.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = materialize(grouped.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


# ---- the pipeline's stage: wide fingerprints


#: Words of a run and least Jaccard similarity of the stage.
RUN, SIMILARITY = 5, 0.8
#: 64-bit words of its fingerprints. At similarity s at most arccos(2 s / (1 + s)) / pi of the bits differ, on average (at 0.8: 78 of
#: 512, with a standard deviation of 8; unrelated texts: 256, with one of 11); pairs beyond FAR deviations more are ruled out.
WIDE, FAR = 8, 6
#: Texts aimed at in a shard of the stage, least and most leaves of a tree, bits of its band beyond the logarithm of the leaves, and the
#: chance at which as many trees as are grown may all miss a pair at the least similarity; the most texts that they are fitted on.
STAGE_SHARD, STAGE_LEAST, STAGE_MOST, SPARE_BITS, MISS, STAGE_SAMPLE = 5_000, 4, 1 << 14, 1, 1e-5, 20_000
#: Texts of a shard that all others are held against first, and pairs that a task holds at a time.
PIVOTS, PAIRS = 16, 200_000
#: Rows of keys that a task searches together (a key's rows always are).
BUCKET = 50_000
#: Leaders of a key in a round. All remaining pairs of the keys are checked once they are at most so many per row of a key, or after
#: so many rounds. Leaders are texts with the smallest share of own runs, the nearest to what a group's texts were copied from.
LEADERS, PAIRS_PER_ROW, LEADER_ROUNDS = 8, 4, 1
#: Counters that a text's shared runs are dealt to.
COUNTERS = 64
_WORDS = [f"f{j}" for j in range(WIDE)]


def run_sets(column: pa.Array, k: int = RUN) -> list[np.ndarray]:
    """The distinct hashes of every text's runs of k words, ascending; a shorter text is one run, one without words the run 0."""
    buf, offsets = text_buffer(column)
    w = Words(LOWER[buf], offsets)
    h, at = w.grams(k)
    cuts = np.searchsorted(w.doc[at], np.arange(len(offsets)))
    out = []
    for d in range(len(offsets) - 1):
        if cuts[d + 1] > cuts[d]:
            out.append(np.unique(h[cuts[d] : cuts[d + 1]]))
            continue
        run = np.zeros(1, np.uint64)
        for i in range(w.first[d], w.first[d + 1]):
            run = mix(run * U(3) + w.hash[i : i + 1] + U(1))
        out.append(run)
    return out


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, WIDE): a bit is 1 if it is set in over half of the text's runs (in just half: if it is in the smallest run); every word
    hashes the runs anew. Eight bits are counted in the bytes of one number, in pieces of at most 255 runs."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts, pieces = np.cumsum(sizes) - sizes, -(-sizes // 255)
    first, doc = np.cumsum(pieces) - pieces, np.repeat(np.arange(len(sets)), pieces)
    cuts = starts[doc] + 255 * (np.arange(len(doc)) - first[doc])
    out = np.empty((len(sets), WIDE), np.uint64)
    for j in range(WIDE):
        h = mix(flat + U(7919 * (j + 1)))
        ones = np.empty((len(sets), 8, 8), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((h >> U(k)) & U(0x0101010101010101), cuts)
            ones[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        tie = np.unpackbits(h[starts].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[:, j] = np.packbits(2 * ones.reshape(-1, 64) + tie > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _marks(rows: DataFrame) -> DataFrame:
    """tag, n (distinct runs), f0.. (the fingerprint's words): a row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = run_sets(b.column("text"))
            f = wide_fingerprints(sets)
            columns = [b.column("tag"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(f[:, j].view(np.int64)) for j in range(WIDE))]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "n", *_WORDS])

    words = ", ".join(f"{w} long" for w in _WORDS)
    return rows.select("tag", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(run, f"tag long, n long, {words}")


# ---- the stage's forest


def differing(similarity: float) -> float:
    """The share of bits that differ, on average, at most: equal sizes give sets of a similarity the smallest cosine."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def radius(similarity: float) -> int:
    p, m = differing(similarity), 64 * WIDE
    return int(np.ceil(m * p + FAR * np.sqrt(m * p * (1 - p))))


def stage_bands(n: int, similarity: float) -> tuple[int, list[np.ndarray]]:
    """The least leaves of a tree and, for every tree, the places of the bits that it measures. Twice as many texts take a
    bit more, so the number of trees grows as the texts to the power of 0.24."""
    shards = min(max(STAGE_LEAST, -(-n // STAGE_SHARD)), STAGE_MOST)
    bits = int(np.ceil(np.log2(shards))) + SPARE_BITS
    hit = min((1 - differing(similarity)) ** bits, 1 - 1e-9)
    r = np.random.default_rng(5)
    return shards, [np.sort(r.permutation(64 * WIDE)[:bits]) for _ in range(int(np.ceil(np.log(MISS) / np.log1p(-hit))))]


def _words(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(w)).view(np.uint64) for w in _WORDS], axis=1)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(len(words), 8 * WIDE), axis=1, bitorder="little")


def band_points(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits), 8), np.uint8)
    packed = np.packbits(bits[:, places], axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")[:, 0]


def clusters(fp: np.ndarray, most: int, word: int, limit: int) -> np.ndarray:
    """The least row of every row's cluster: rows at most ``most`` bits apart are in one. A pair is looked at if a word of it differs in
    at most ``limit`` bits. Rows near a pivot are in its cluster, and two rows of the largest of these clusters are not compared, so a
    dense group costs time in proportion to its rows."""
    label, first = np.arange(len(fp)), np.ascontiguousarray(fp[:, word])

    def near(i, j):
        return np.bitwise_count(fp[i] ^ fp[j]).sum(-1) <= most

    for i in np.unique(np.linspace(0, len(fp) - 1, PIVOTS).astype(np.int64)).tolist():
        j = np.flatnonzero(near(i, slice(None)))
        label = _merge(label, np.full(len(j), i), j)
    inside = label == np.bincount(label).argmax()
    order = np.concatenate((np.flatnonzero(~inside), np.flatnonzero(inside)))
    ordered, rest = first[order], len(fp) - int(inside.sum())
    step = max(1, PAIRS // max(1, len(fp)))
    for a in range(0, rest, step):
        b = min(a + step, rest)
        i, j = np.nonzero(np.bitwise_count(ordered[a:b, None] ^ ordered[None, a:]) <= limit)
        later = i < j
        i, j = order[a + i[later]], order[a + j[later]]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        ok = near(i, j)
        label = _merge(label, i[ok], j[ok])
    return label


def forest_members(marks: DataFrame, n: int, similarity: float) -> DataFrame:
    """key, tag: a key is a cluster of texts in a shard of a tree. A text visits one shard of each tree (its band is measured at
    radius 0); every pair of a shard within the radius on all bits is in one cluster, and only texts with a neighbour leave it."""
    shards, chosen = stage_bands(n, similarity)
    band = U((1 << len(chosen[0])) - 1)
    keep = min(1.0, STAGE_SAMPLE / max(n, 1))
    some = marks if keep == 1.0 else marks.where(F.pmod(F.xxhash64("tag"), F.lit(1_000_000)) < int(keep * 1_000_000))
    sample = _bits(np.array([list(r) for r in some.select(*_WORDS).collect()], np.int64).reshape(-1, WIDE).view(np.uint64))  # bounded: STAGE_SAMPLE
    fitted = [band_points(sample, places) for places in chosen]
    forest = [Tree(points, band, shards, whole=False) for points in fitted]
    parts = [splits(t, points, n, STAGE_SHARD) for t, points in zip(forest, fitted)]
    starts = [np.concatenate(([0], np.cumsum(p)[:-1])) for p in parts]
    first = np.cumsum([0] + [int(p.sum()) for p in parts])
    p, most = differing(similarity), radius(similarity)
    limit = int(np.ceil(64 * p + 4 * np.sqrt(64 * p * (1 - p))))  # of a word, another one in the next tree

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags, words = np.asarray(b.column("tag")), _words(b)
            bits = _bits(words)
            for k, tree in enumerate(forest):
                value = band_points(bits, chosen[k])
                dealt = mix(value + U(k + 1))
                shard = np.empty(len(value), np.int64)
                for at, leaf, _ in tree.visit(value):
                    shard[at] = first[k] + starts[k][leaf] + (dealt[at] % parts[k][leaf].astype(np.uint64)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                begin, size = _groups(shard[order])
                sent = [order[x : x + s] for x, s in zip(begin.tolist(), size.tolist())]  # a row holds what a batch sends to a shard
                columns = [pa.array(shard[order][begin]), pa.array([tags[x].tobytes() for x in sent], pa.binary()), pa.array([words[x].tobytes() for x in sent], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "tags", "words"])

    def search(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        tags = np.frombuffer(b"".join(table.column("tags").to_pylist()), np.int64)
        fp = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(-1, WIDE)
        label = clusters(fp, most, (int(np.searchsorted(first, shard, "right")) - 1) % WIDE, limit)
        met = np.bincount(label, minlength=len(label))[label] > 1
        key = mix(mix(tags[label[met]].view(np.uint64)) + U(shard + 1))
        return pa.table({"key": key.view(np.int64), "tag": tags[met]})

    return marks.select("tag", *_WORDS).mapInArrow(visits, "shard long, tags binary, words binary").groupBy("shard").applyInArrow(search, "key long, tag long")


def _spans(first: np.ndarray, count: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, partner) for the partners first .. first + count - 1 of every row, about ``most`` pairs at a time."""
    most = most or PAIRS
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        n = count[start:stop]
        yield np.repeat(np.arange(start, stop), n), np.repeat(first[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = stop


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of every run of equal keys."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return starts, np.diff(np.append(starts, len(key)))


class Bounds:
    """The rows of some keys, ordered as asked, and which of their pairs the exact bounds leave."""

    def __init__(self, table: pa.Table, similarity: float, order):
        x = {c: np.asarray(table.column(c)) for c in ("key", "tag", "n", "own", "comp")}
        held = table.column("held").combine_chunks()
        held = (held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held).flatten()
        at = order(x)
        self.key, self.tag, self.n, self.own, self.comp = (x[c][at] for c in ("key", "tag", "n", "own", "comp"))
        self.held, self.fp = np.asarray(held).reshape(-1, COUNTERS)[at].astype(np.int16), _words(table)[at]
        self.similarity, self.most = similarity, radius(similarity)

    def left(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, n, own = self.similarity, self.n, self.own
        ok = self.comp[i] != self.comp[j]
        i, j = i[ok], j[ok]
        owns, rest_i, rest_j = own[i] + own[j], n[i] - own[i], n[j] - own[j]
        ok = np.minimum(rest_i, rest_j) >= s * (owns + np.maximum(rest_i, rest_j)) - 1e-9
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(-1) <= self.most
        i, j = i[ok], j[ok]
        apart = np.abs(self.held[i] - self.held[j]).sum(-1, dtype=np.int64)  # runs of only one of the two, with owns, at least
        ok = (1 + s) * (own[i] + own[j] + apart) <= (1 - s) * (n[i] + n[j]) + 1e-9
        return i[ok], j[ok]


def held_against(table: pa.Table, similarity: float, turn: int) -> pa.Table:
    """t, seat, share, o: every text of some keys and the leaders of its key that the bounds leave; of each seat, the text with the
    smallest share of own runs leads."""
    b = Bounds(table, similarity, lambda x: np.lexsort((x["tag"], x["own"] / x["n"], x["key"])))
    seat, (starts, sizes) = (mix(b.tag.view(np.uint64) + U(turn + 1)) % U(LEADERS)).astype(np.int64), _groups(b.key)
    group = np.repeat(np.arange(len(starts)), sizes)
    lead = np.sort(np.unique(group * LEADERS + seat, return_index=True)[1])
    first = np.searchsorted(group[lead], np.arange(len(starts) + 1))
    out: tuple[list, list, list, list] = [], [], [], []
    for i, j in _spans(first[group], np.diff(first)[group]):
        i, j = b.left(i, lead[j])
        for column, x in zip(out, (b.tag[i], seat[j], b.own[j] / b.n[j], b.tag[j])):
            column.append(x)
    return pa.table({c: np.concatenate(x) for c, x in zip(("t", "seat", "share", "o"), out)})


def remaining_pairs(table: pa.Table, similarity: float) -> pa.Table:
    """a, b: the pairs of some keys' texts in different components that the bounds leave. With slack = (1 - s) n - (1 + s) own a pair's
    slacks must not sum below zero: rows go by falling slack, and a text meets only the first ones that make up for its own. Two texts of a
    key's largest component are never met."""

    kept: dict[str, np.ndarray] = {}

    def order(x):
        slack = np.floor(1000 * ((1 - similarity) * x["n"] - (1 + similarity) * x["own"])).astype(np.int64) + 1
        by = np.lexsort((x["comp"], x["key"]))
        runs = np.flatnonzero(np.concatenate(([True], (np.diff(x["key"][by]) != 0) | (np.diff(x["comp"][by]) != 0))))
        sizes = np.diff(np.append(runs, len(by)))
        largest = np.lexsort((runs, -sizes, x["key"][by][runs]))  # the first of a key is its largest component
        largest = largest[_groups(x["key"][by][runs][largest])[0]]
        main = np.zeros(len(runs), bool)
        main[largest] = True
        inside = np.empty(len(by), bool)
        inside[by] = np.repeat(main, sizes)
        at = np.lexsort((x["tag"], -slack, inside, x["key"]))
        kept["slack"], kept["main"] = slack[at], inside[at]
        return at

    b = Bounds(table, similarity, order)
    slack, main = kept["slack"], kept["main"]
    starts, counts = _groups(b.key)
    part = 2 * np.repeat(np.arange(len(starts)), counts) + main  # a key's others, then its largest component
    sizes = np.bincount(part, minlength=2 * len(starts))
    place = (part << 36) - slack  # ascending
    start = np.cumsum(sizes) - sizes
    others = np.flatnonzero(~main)
    found: list[np.ndarray] = []
    for which in (0, 1):
        p = part[others] + which
        reach = np.searchsorted(place, (p << 36) + slack[others], "right") - start[p]
        count = np.clip(reach, 0, sizes[p] if which else others - start[p])
        for i, j in _spans(start[p], count):
            i, j = b.left(others[i], j)
            if len(i):
                x, y = b.tag[i], b.tag[j]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _runs(rows: DataFrame) -> DataFrame:
    """tag, runs (the distinct runs of every text), held (how many of them each of COUNTERS counters has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = run_sets(b.column("text"))
            flat, sizes = np.concatenate(sets).view(np.int64), np.array([len(x) for x in sets])
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            cell = np.repeat(np.arange(len(sets)) * COUNTERS, sizes) + flat % COUNTERS
            held = pa.array(np.bincount(cell, minlength=len(sets) * COUNTERS).astype(np.int32))
            steps = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COUNTERS)
            columns = [b.column("tag"), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(steps, held)]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "runs", "held"])

    return rows.select("tag", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(run, "tag long, runs array<long>, held array<int>")


def _similar(pairs: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose full sets are as similar as that."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("tag")).distinct(), "near-needed")
    sets = materialize(runs.join(small(needed), "tag", "left_semi"), "near-sets")
    side = lambda k: sets.select(F.col("tag").alias(k), F.col("runs").alias(f"r{k}"))
    both = F.size(F.array_intersect("ra", "rb"))
    near = both >= similarity * (F.size("ra") + F.size("rb") - both) - 1e-9
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def similar_components(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """v, root (smallest tag of its component) of every row that is similar to another and not the root; ``rows`` is a written
    table of row (with its text) and tag."""
    marks = materialize(_marks(rows), "near-marks")
    met = materialize(forest_members(marks, marks.count(), similarity), "near-keys")
    met = materialize(met.join(marks, "tag").select("key", "tag", "n", *_WORDS), "near-met")
    runs = materialize(_runs(rows.join(small(met.select("tag").distinct()), "tag", "left_semi")), "near-runs")
    # runs that no other of these texts has are in no intersection: own of a text's n runs
    lone = runs.select("tag", F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("c"), F.min("tag").alias("tag")).where("c = 1")
    cell = F.pmod("run", F.lit(COUNTERS))
    lone = lone.groupBy("tag").agg(F.count(F.lit(1)).alias("own"), F.array(*[F.count(F.when(cell == k, 1)) for k in range(COUNTERS)]).alias("_own"))
    rest = F.transform(F.coalesce(F.zip_with("held", "_own", lambda a, b: a - b), "held"), lambda a: F.least(a, F.lit(127)).cast("byte"))
    counted = runs.select("tag", "held").join(lone, "tag", "left").select("tag", F.coalesce("own", F.lit(0)).alias("own"), rest.alias("held"))
    left = met.join(counted, "tag")
    left = materialize(left.where(F.col("n") - F.col("own") >= similarity * F.col("n") - 1e-9), "near-shared")
    shared = materialize(left.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("s")).where("s > 1"), "near-open")
    turn, roots = 0, None
    edges = left.select(F.col("tag").alias("a"), F.col("tag").alias("b")).limit(0)
    while True:
        if roots is None:  # every text is a component of its own
            mine, open_keys = left.withColumn("comp", F.col("tag")), shared.withColumn("ss", F.col("s"))
        else:
            mine = left.join(small(roots), F.col("tag") == F.col("v"), "left").withColumn("comp", F.coalesce("root", "tag")).drop("v", "root")
            held = mine.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
            sizes = held.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
            open_keys = materialize(sizes.where("s * s > ss"), "near-open")
        count, many = open_keys.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2)).first()
        if not count:
            return left.select(F.col("tag").alias("v"), F.col("tag").alias("root")).limit(0) if roots is None else roots
        last = many <= PAIRS_PER_ROW * count or turn == LEADER_ROUNDS
        mine = mine.join(small(open_keys.select("key")), "key")
        mine = mine.select("key", "tag", "n", "own", "held", "comp", *_WORDS).groupBy(F.pmod("key", F.lit(max(1, -(-int(count) // BUCKET)))))
        if last:
            pairs = mine.applyInArrow(lambda table: remaining_pairs(table, similarity), "a long, b long")
        else:  # of the leaders that its keys have for a seat a text is held against one: the texts of a group have the same
            against = mine.applyInArrow(lambda table: held_against(table, similarity, turn), "t long, seat long, share double, o long")
            pairs = against.groupBy("t", "seat").agg(F.min_by("o", F.struct("share", "o")).alias("o")).select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"))
        pairs = materialize(pairs.distinct(), "near-pairs")
        edges = materialize(edges.unionByName(_similar(pairs, runs, similarity)), "near-edges")
        roots = components(edges)
        if last:
            return roots
        turn += 1


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component (its smallest id; a null id only if there is no other), with the columns of ``docs``. Rows are
    told apart by their place, not by their ids, so repeated rows and rows without ids are near copies like any others; texts
    without words are copies of each other."""
    rows = materialize(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("tag")), "near-rows")
    moved = similar_components(rows, similarity)
    members = materialize(moved.unionByName(moved.select(F.col("root").alias("v"), "root").distinct()), "near-members")
    named = rows.select("tag", F.col("row.doc_id").alias("doc_id")).join(small(members), F.col("tag") == F.col("v"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    kept = named.groupBy("root").agg(F.min(order)["tag"].alias("tag")).select("tag")
    gone = materialize(members.select(F.col("v").alias("tag")).join(small(kept), "tag", "left_anti"), "near-gone")
    return rows.join(small(gone), "tag", "left_anti").select(*columns_of_row(docs.columns))
