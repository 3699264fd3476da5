"""Words, lines and n-grams of many texts at once: numpy over the Arrow buffers, no Python object per word.

A range of bytes is hashed by a polynomial over random byte values modulo 2**64, from running sums, and finished by a
mixing step; two different words of a text share a hash with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_PI = U(pow(int(_P), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_CHUNK = 1 << 20
_pow: list[np.ndarray] = []

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of other scripts.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _CHUNK + 1)
        made = [np.concatenate(([U(1)], np.cumprod(np.full(size - 1, p, np.uint64)))) for p in (_P, _PI)]
        if size > 4 * _CHUNK:  # for one huge word; not kept
            return made[0], made[1]
        _pow[:] = made
    return _pow[0], _pow[1]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every range; ranges are in order and do not overlap. Work arrays cover a chunk of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _CHUNK, "right")))
        power, inverse = _powers(int(ends[j - 1] - a) + 1)
        seg = buf[a : ends[j - 1]]
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTES[seg] * power[: len(seg)], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] ^ (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of a block of texts: ``hash``, ``start``, ``end`` per word; ``first`` (n + 1 word numbers) and ``doc``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.buf, self.offsets = buf, offsets
        inner = ~separators[buf]
        self.inner = inner
        n = len(buf)
        left, right = np.empty(n, bool), np.empty(n, bool)
        if n:
            left[0] = right[-1] = True
            left[1:], right[:-1] = ~inner[:-1], ~inner[1:]
            left[offsets[:-1][offsets[:-1] < n]] = True
            right[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(inner & left)
        self.end = np.flatnonzero(inner & right) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = range_hashes(buf, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the first word) of every run of k words of one text."""
        return grams(self.hash, self.doc, k)


def grams(values: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = values[:n]
    for i in range(1, k):
        h = mix(h * U(3) + values[i : n + i])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return h[at], at


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column without nulls, from its own buffers."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between the offsets."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def unique_rows(doc: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs in order; value has at most ``bits`` bits."""
    key = np.unique((doc.astype(np.uint64) << U(bits)) | value.astype(np.uint64))
    return (key >> U(bits)).astype(np.int64), (key & U((1 << bits) - 1)).astype(np.int64)
