"""Words, lines and shingles of a column of texts as numpy arrays, a bounded slice of rows at a time.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, so its bytes are those of the pattern
``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are 64 bits: a polynomial over a mixed value per byte,
taken from prefix sums, so that the hash of any stretch of text costs two look-ups.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 2 * 1024 * 1024

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.arange(256, dtype=np.uint8)
_LOWER = _KEEP.copy()
_LOWER[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits (the finalizer of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_powers: dict[U64, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, SLICE_BYTES + 1), U64)
        np.multiply.accumulate(np.full(len(known) - 1, base, U64), out=known[1:])
        if len(known) <= 4 * SLICE_BYTES:  # one very long text does not stay in memory
            _powers[base] = known
    return known[:n]


@dataclass
class Slice:
    """Rows ``first .. last - 1`` of a column: their bytes, and where each row begins and ends."""

    first: int
    last: int
    data: np.ndarray
    ends: np.ndarray  # last - first + 1 offsets into data

    def text(self, i: int) -> bytes:
        return self.data[self.ends[i]: self.ends[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of rows of at most ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield Slice(first, last, data[ends[first]: ends[last]], ends[first: last + 1] - ends[first])
        first = last


def regrouped(batches: Iterator[pa.RecordBatch], at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text in column ``at`` (or one row): they
    depend on the rows alone, not on how Spark batched them or on the other columns."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends, low, base = np.cumsum(lengths, dtype=np.int64), 0, 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, base + limit - size, "right"))
            if high <= low and not held:
                high = low + 1
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(ends[high - 1]) - base
                base, low = int(ends[high - 1]), high
            if low < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``starts .. ends - 1`` of the text whose ``prefix_sums`` are given."""
    raw = (sums[ends] - sums[starts]) * powers(_BACK, len(sums))[starts]
    return mix(raw + (ends - starts).astype(U64))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    table = _BYTE[_LOWER] if lower else _BYTE
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # word number at which each row begins, one more than rows


def words_of(part: Slice, lower: bool = False, sums: np.ndarray | None = None) -> Words:
    """The words of every row of a slice in order, with a hash each."""
    n = len(part.data)
    edge = np.zeros(n + 1, bool)
    edge[part.ends] = True
    space = SPACE[part.data]
    before = edge[:n].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    sums = prefix_sums(part.data, lower) if sums is None else sums
    return Words(starts, ends, stretch_hashes(sums, starts, ends), np.searchsorted(starts, part.ends))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring values (``len(values) - width + 1`` of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(width), U64)
    for i in range(width):
        out = out * _BASE + values[i: i + n]
    return mix(out)


def shingle_sets(part: Slice, width: int = 5) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A row with fewer words gives its whole sequence as one; a row without words an empty set."""
    words = words_of(part, lower=True)
    windows = window_hashes(words.hashes, width)
    for low, high in zip(words.bounds[:-1], words.bounds[1:]):
        if high - low >= width:
            yield np.unique(windows[low: high - width + 1])
        else:
            yield window_hashes(words.hashes[low:high], high - low) if high > low else np.zeros(0, U64)


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)
