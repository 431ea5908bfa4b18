"""Words of whole Arrow batches as numpy arrays.

A word is a run of ASCII digits, ASCII letters and bytes of 0x80 and more, after
A-Z are lower-cased. In UTF-8 that is a property of single bytes, so a batch is
cut by a table lookup over its text buffer; no row is visited in Python. Hashes
are polynomials modulo 2**64 taken from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_TABLE = np.zeros(256, np.uint8)
_TABLE[48:58] = np.arange(48, 58)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of some rows: ``lo:hi`` are byte bounds in ``buf``, ``row`` the row of each word."""

    buf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray
    n_rows: int
    n_words: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = _power(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(self.buf * up[: len(self.buf)], out=total[1:])
        return mix((total[self.hi] - total[self.lo]) * down[self.lo] + (self.hi - self.lo).astype(np.uint64))

    def text(self, i: int, j: int) -> str:
        """Words i to j (exclusive) with single spaces."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.lo[i:j], self.hi[i:j], strict=True)).decode("utf-8", "replace")


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, and the index of the first word of each; none crosses rows."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    g = np.full(len(at), k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
    return mix(g), at


def words(texts: pa.Array, boundary: np.ndarray | None = None) -> Words:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    buf = _TABLE[raw]
    n = len(buf)
    on = np.zeros(n + 2, bool)
    on[1:-1] = buf != 0
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    lo = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    hi = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    edge = np.searchsorted(lo, off)
    count = np.diff(edge)
    return Words(buf, lo, hi, np.repeat(np.arange(len(count)), count), len(count), count, edge[:-1])


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``CHUNK_BYTES`` of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(size):
        if i > start and total + s > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if batch.num_rows > start:
        yield batch.slice(start)
