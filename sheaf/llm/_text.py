"""Arrow and numpy helpers that the corpus operators share.

Texts are handled as UTF-8 bytes straight from Arrow's buffers. A null text has no bytes. A batch
is cut into chunks of a few MB, so that temporary arrays stay small whatever the batch holds; one
document is never cut, so a chunk is as large as its longest document at least.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
#: Random 64-bit values of the bytes, and of the white space bytes 0.
BYTE_KEYS = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_KEYS = np.where(SPACE, U64(0), BYTE_KEYS)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system. Python workers go from stage to stage, and would keep what the hungriest one took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Texts:
    """The texts of consecutive rows: data, and where each starts and ends in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.lens = data, bounds, np.diff(bounds)

    def __len__(self) -> int:
        return len(self.lens)

    def one(self, i: int) -> np.ndarray:
        return self.data[self.bounds[i] : self.bounds[i + 1]]


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string or binary column, nulls as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(raw, bounds - bounds[0])


def chunks(batch: pa.RecordBatch, most_bytes: int = 4 << 20, most_rows: int = 20_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of most_bytes of text and most_rows at most, but of one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    release()
    ends = np.cumsum(texts_of(column).lens)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, before + most_bytes, side="right"))
        to = min(max(to, at + 1), at + most_rows)
        yield batch.slice(at, to - at)
        at = to
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, .. modulo 2**64, n of them at least."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        kept = np.full(size, base % 2**64, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = kept
    return kept[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts.

    start and end are places in the texts' data, doc the text of each word, first[i] the number of
    words in texts before text i.
    """

    def __init__(self, texts: Texts):
        data, bounds = texts.data, texts.bounds
        inside = ~SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = bounds[:-1][texts.lens > 0]
        opens[heads] = inside[heads]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        tails = bounds[1:][texts.lens > 0] - 1
        closes[tails] = inside[tails]
        self.texts = texts
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, lower: bool = False, base: int = int(ODD)) -> np.ndarray:
        """64-bit hashes of the words; lower: with A-Z as a-z."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        keys = WORD_KEYS
        if lower:
            keys = keys.copy()
            keys[65:91] = keys[97:123]
        lo, hi = self.start[0], self.end[-1]
        data = self.texts.data[lo:hi]
        begin = self.start - lo
        spans = np.diff(np.append(begin, hi - lo))
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), spans)
        longest = int((self.end - self.start).max())
        np.minimum(place, longest, out=place)  # white space after a word has key 0
        values = keys[data]
        values *= powers(base, longest + 1)[place]
        return mix(np.add.reduceat(values, begin) + (self.end - self.start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash for each k consecutive hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse(base), n - k + 1))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for a start s."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
