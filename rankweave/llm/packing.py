"""Packing documents into sequences by linear grouping.

All that the plan needs is how many items there are of each length, at most ``capacity`` numbers, whatever the size of
the corpus. From these the driver lays out the sequences:

1. Lengths above ``SMALL`` are sorted and cut into at most ``GROUPS`` groups of equal cardinality, and every group's lengths
   are rounded up to its largest.
2. On these few sizes the least number of sequences is a linear programme over configurations (which sizes share a sequence,
   and how often). It is solved by column generation: a simplex step on the configurations so far, then a knapsack over the
   dual prices for the configuration that is worth most, until none is worth more than a sequence. Whole parts are used.
3. Actual documents replace the rounded sizes, and what rounding had left free is used again at once: the last slot of a
   sequence takes the longest document that its actual room holds. Sequences with the same actual lengths form a class.
4. What the whole parts left over, and the small lengths, go, longest first, into the fullest class that still has room
   for them (best fit), then into new ones.

A class is a run of sequences, and what it takes of a length is a run of that length's items, so the plan is a table of
runs ``(length, first item, sequence, offset)``. Items are numbered within their length by counting in their own task and
adding the counts of the tasks before; no group is gathered or sorted in one place.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, documents, materialize, small, text_of

CAPACITY = 2048
#: Longest length that counts as small, and groups of the larger ones.
SMALL, GROUPS = 256, 100
TOKENIZER = "byte_bpe_50k.json"


# ---- tokens


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the vocabulary file that ``tokenizers`` reads.

    The ids are those of ``tokenizers``; the same vocabulary is run by the quicker merge loop of ``tiktoken`` (a token's
    id is its merge rank in these files) after both agree on a probe. Texts with a special token's string go through
    ``tokenizers`` itself, which gives that string its own id.
    """

    PROBE = "It's 12 o'clock,  we'll see: ¿qué?\n\n Über\tçà... 2,048 \u4e2d\u6587 "

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        known, byte_of = {t["id"] for t in spec["added_tokens"]}, _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in known}
        self.quick = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.agree = self.quick.encode_ordinary(self.PROBE) == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.agree or any(s in text for s in self.special):
            return self.raw(text)
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def items(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row per piece of at most ``capacity`` tokens: a document's ids, then ``end``; cut so that only the first piece
    may be shorter. ``task`` and ``place`` number the pieces of one length."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, tail = encoder(path).encode, TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for b in blocks(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text) + tail
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    length = stop - start
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), seen[length])):
                        column.append(value)
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)] + [pa.array([task] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, ITEMS)


# ---- the plan


def _worth_most(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the sequence whose prices add up to most (an unbounded knapsack)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    for g, s in enumerate(sizes):
        if prices[g] > 1e-12:
            for _ in range(capacity // s):
                new = value[:-s] + prices[g]
                better = new > value[s:] + 1e-12
                if not better.any():
                    break
                value[s:][better], pick[s:][better] = new[better], g
    at, used = int(np.argmax(value)), np.zeros(len(sizes))
    while pick[at] >= 0:
        used[pick[at]] += 1
        at -= sizes[pick[at]]
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int, gap: float = 1e-4) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(how often each size is in a sequence, how many such sequences) of the linear programme's best solution, and its value.
    It ends once the value is within ``gap`` of the bound that the dual prices prove."""
    m = len(sizes)
    need, columns = np.array(counts, float), [np.eye(m)[g] * (capacity // s) for g, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes]) if m else np.zeros((0, 0))
    times = inverse @ need
    while m:
        prices = inverse.sum(axis=0)
        new = _worth_most(sizes, prices, capacity)
        worth = float(prices @ new)
        if worth <= 1 + 1e-9 or times.sum() * (1 - 1 / worth) <= gap * times.sum():
            break
        step = inverse @ new
        rise = np.flatnonzero(step > 1e-9)
        ratio = times[rise] / step[rise]
        out = int(rise[np.argmin(ratio)])
        most = max(float(ratio.min()), 0.0)
        times = np.maximum(times - most * step, 0.0)
        times[out] = most
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = new
    return [(c, float(t)) for c, t in zip(columns, times) if t > 1e-9], float(times.sum())


def linear_groups(lengths: list[int], counts: list[int], groups: int) -> tuple[list[int], list[int], list[list[list[int]]]]:
    """Groups of (nearly) equal cardinality of descending lengths: rounded size, cardinality, and [length, count] runs."""
    per = max(1, -(-sum(counts) // groups))
    sizes: list[int] = []
    cards: list[int] = []
    runs: list[list[list[int]]] = []
    for n, c in zip(lengths, counts):
        while c:
            if not cards or cards[-1] == per:
                sizes.append(n)
                cards.append(0)
                runs.append([])
            take = min(c, per - cards[-1])
            cards[-1] += take
            runs[-1].append([n, take])
            c -= take
    # groups of one size are one size
    merged: dict[int, int] = {}
    for i, s in enumerate(sizes):
        if s in merged:
            j = merged[s]
            cards[j] += cards[i]
            runs[j] += runs[i]
            cards[i] = 0
        else:
            merged[s] = i
    keep = [i for i, c in enumerate(cards) if c]
    return [sizes[i] for i in keep], [cards[i] for i in keep], [runs[i] for i in keep]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small_most: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first item, items, first sequence, offset) and the number of sequences. Depends on the numbers of
    the lengths only; its size is bounded by capacity and groups."""
    cursor: dict[int, int] = defaultdict(int)
    classes: list[tuple[int, list[tuple[int, int, int]]]] = []  # sequences, (length, first item, offset) of each slot

    def take(n: int, times: int) -> int:
        first = cursor[n]
        cursor[n] += times
        return first

    large = sorted((n for n in histogram if n > small_most), reverse=True)
    sizes, cards, runs = linear_groups(large, [histogram[n] for n in large], groups)
    left = {n: histogram[n] for n in histogram}
    there = np.zeros(capacity + 1, bool)
    there[large] = True
    group_of = {n: g for g, r in enumerate(runs) for n, _ in r}
    lowest = [min(n for n, _ in r) for r in runs]

    def longest(most: int) -> int:
        """The longest large length that is left, at most ``most``; 0 if there is none."""
        found = np.flatnonzero(there[small_most + 1 : most + 1])
        return int(found[-1]) + small_most + 1 if len(found) else 0

    # the fullest configurations first: the sizes that few sequences need stay for the rest
    plan_of, _ = configurations(sizes, cards, capacity)
    for used, times in sorted(plan_of, key=lambda c: (-float(c[0] @ np.array(sizes)), tuple(c[0]))):
        todo = int(times + 1e-6)
        slots = [g for g in range(len(sizes)) for _ in range(int(used[g]))]
        while todo:
            taken: dict[int, int] = defaultdict(int)
            content, room = [], capacity
            for k, g in enumerate(slots):
                # within its group, or shorter where the group is used up; the last slot takes what fits best
                most = room if k == len(slots) - 1 else min(sizes[g], room)
                n = longest(most)
                if not n:
                    break
                content.append(n)
                room -= n
                taken[n] += 1
                if left[n] == taken[n]:
                    there[n] = False
            if not content:
                break
            run = min(todo, min(left[n] // c for n, c in taken.items()))
            offset, row = 0, []
            for n in content:
                row.append((n, take(n, run), offset))
                offset += n
            classes.append((run, row))
            for n, c in taken.items():
                left[n] -= c * run
                there[n] = left[n] > 0
            todo -= run
    # best fit of what is left, by classes with equal room
    room: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = defaultdict(list)
    for times, content in classes:
        room[capacity - sum(n for n, _, _ in content)].append((times, content))
    free = np.zeros(capacity + 1, bool)
    for r, found in room.items():
        free[r] = bool(found)
    for n in sorted((n for n in left if left[n]), reverse=True):
        need = left[n]
        while need:
            fits = np.flatnonzero(free[n:])
            if len(fits):
                r = int(fits[0]) + n
                times, content = room[r].pop()
                free[r] = bool(room[r])
                if times > need:
                    room[r].append((times - need, [(a, b + need, o) for a, b, o in content]))
                    free[r] = True
                    times = need
            else:  # new sequences, each filled with this length
                each = min(need, capacity // n)
                times, r, content = need // each, capacity, []
                for k in range(each - 1):
                    content.append((n, take(n, times), k * n))
                need -= times * (each - 1)
                r -= n * (each - 1)
            room[r - n].append((times, [*content, (n, take(n, times), capacity - r)]))
            free[r - n] = True
            need -= times
    rows, sequence = [], 0
    for found in room.values():
        for times, content in found:
            rows += [(n, first, times, sequence, offset) for n, first, offset in content]
            sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequence


def lookup(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items by their length and number."""
    key = (table[:, 0] << 48) | table[:, 1]
    at = np.searchsorted(key, (length << 48) | rank, "right") - 1
    return table[at, 3] + rank - table[at, 1], table[at, 4]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Defined results: a null or empty text is the closing id alone; repeated rows are packed each for itself; a null
    doc_id is carried along; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(items(docs, path, capacity), "pack-items")
    counts = materialize(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(small(materialize(bases, "pack-bases")), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    shipped = spark.sparkContext.broadcast(table)  # bounded by capacity and groups

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = lookup(shipped.value, length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
