"""Vectorised text primitives shared by the operators that run on Arrow batches.

Everything works on the UTF-8 bytes of a batch of texts laid end to end, so
splitting into words, hashing and sliding windows are NumPy passes and no
Python object is made per word. Hashes are 64 bits: a polynomial in an odd
base modulo 2**64 (Rabin-Karp), finished by a bit mixer. Words are mixed
before windows are hashed over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
PIECE = 1 << 20


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that white space separates: all but space, tab, \n, \v, \f, \r.
SPACED = ~_table([(0x09, 0x0D), (0x20, 0x20)])
#: Bytes of words once A-Z are lower-cased: digits, a-z and every non-ASCII byte.
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Byte values with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            seq = np.full(size, base, dtype=U64)
            seq[0] = 1
            _powers[name] = np.cumprod(seq, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; empty if there are fewer than n."""
    total = len(values) - n + 1
    if total <= 0:
        return np.empty(0, dtype=U64)
    out = np.empty(total, dtype=U64)
    for lo in range(0, total, PIECE):
        hi = min(total, lo + PIECE)
        up, down = powers(hi - lo + n - 1)
        sums = np.zeros(hi - lo + n, dtype=U64)
        np.cumsum(values[lo : hi + n - 1] * up, out=sums[1:])
        out[lo:hi] = (sums[n:] - sums[:-n]) * down[: hi - lo]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < w:
        values = np.minimum(values[: len(values) - (w - have)], values[w - have :])
    return values


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest hash of each w consecutive ones.

    The 43 high bits decide; ties go to the leftmost, so equal content gets
    equal relative positions.
    """
    total = len(hashes) - w + 1
    if total <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.empty(total, dtype=np.int64)
    low = U64((1 << 21) - 1)
    for lo in range(0, total, PIECE):
        hi = min(total, lo + PIECE)
        part = hashes[lo : hi + w - 1]
        packed = (part & ~low) | np.arange(len(part), dtype=U64)
        out[lo:hi] = (sliding_min(packed, w) & low).astype(np.int64) + lo
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return raw, offs - offs[0]


class Words:
    """Words of a batch of texts: document index, byte start, byte end and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool) -> None:
        self.data = LOWER[data] if fold else data
        self.offsets = offsets
        inside = table[self.data]
        before, after = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            out, i = np.empty(len(self), dtype=U64), 0
            while i < len(self):
                j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, side="right")))
                lo, hi = int(self.start[i]), int(self.end[j - 1])
                up, down = powers(hi - lo)
                sums = np.zeros(hi - lo + 1, dtype=U64)
                np.cumsum(_BYTE[self.data[lo:hi]] * up, out=sums[1:])
                s, e = self.start[i:j] - lo, self.end[i:j] - lo
                out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
                i = j
            self._hash = mix(out)
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each n consecutive words of one text."""
        hashes = rolling(self.hash, n)
        if not len(hashes):
            return np.empty(0, dtype=np.int64), hashes
        at = np.flatnonzero(self.doc[: len(hashes)] == self.doc[n - 1 :])
        return at, hashes[at]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def cover(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Which of size places some interval [start, start + length) covers."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, size), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    steps = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most limit text bytes, or of one row."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of up to limit text bytes, or of one row, from the rows of all batches in order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for part in slices(whole, column, limit):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + own > limit:
                yield _merged(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield _merged(held)


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def text_key(text: Column) -> Column:
    """Rows of equal text get the same key; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
