"""Bitmaps of bounded size that tell which rows may matter, so that fewer are shuffled.

A set bit may stand for several values; what passes is joined or compared exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, mix

#: Bits of a slice, 64 KB.
SLICE_BITS = 19
SLICES = pa.schema([("slice", pa.int32()), ("places", pa.binary())])


def bits_for(count: int, each: int = 12, most: int = 28) -> int:
    """A bitmap of `each` bits a value, 2 ** most (32 MB) at most; beyond that it lets more through."""
    return int(min(max(SLICE_BITS, int(max(1, count) * each).bit_length()), most))


def sparse(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """The places of hashes in a bitmap, by slice."""
    place = np.unique((hashes >> U64(64 - bits)).astype(np.uint32))
    which = place >> np.uint32(SLICE_BITS)
    heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(place) else np.zeros(0, int)
    parts = np.split(place & np.uint32((1 << SLICE_BITS) - 1), heads[1:]) if len(place) else []
    return pa.RecordBatch.from_arrays([pa.array(which[heads].astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], schema=SLICES)


def _join_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice. Rows come sorted by slice, so one is held at a time."""
    now, flags = None, None
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != now:
                if now is not None:
                    yield _packed(now, flags)
                now, flags = k, np.zeros(1 << SLICE_BITS, bool)
            flags[np.frombuffer(raw.as_buffer(), np.uint32)] = True
    if now is not None:
        yield _packed(now, flags)


def _packed(k: int, flags: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], schema=SLICES)


def bitmap(slices: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of sparse() rows (slice, places), on the driver: 2 ** bits / 8 bytes."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_join_slices, "slice int, places binary").collect():
        at = r["slice"] << (SLICE_BITS - 3)
        out[at : at + (1 << (SLICE_BITS - 3))] |= np.frombuffer(r["places"], np.uint8)
    return out


def maybe(found: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U64(64 - bits)
    return (found[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0


def _bitmap_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    bits = bits_for(ids.count(), most=26)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield sparse(mix(batch.column(0).to_numpy().view(np.uint64)), bits)

    return bitmap(ids.mapInArrow(places, "slice int, places binary"), bits), bits


def _passed(docs: DataFrame, found: np.ndarray, bits: int, wanted: bool) -> DataFrame:
    column = docs.columns.index("doc_id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ok = maybe(found, bits, mix(ids.fill_null(0).cast(pa.int64()).to_numpy().view(np.uint64))) & ~null
            ok = ok == wanted
            if ok.any():
                yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id), and perhaps some others."""
    return _passed(docs, *_bitmap_of(ids), wanted=True)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (doc_id). Only rows that may be in them are shuffled."""
    found, bits = _bitmap_of(ids)
    unsure = _passed(docs, found, bits, wanted=True).join(ids, "doc_id", "left_anti").select(docs.columns)
    return _passed(docs, found, bits, wanted=False).unionByName(unsure)


def by_key(slices: DataFrame) -> DataFrame:
    return slices.where(F.col("slice").isNotNull()).select("slice", "places")
