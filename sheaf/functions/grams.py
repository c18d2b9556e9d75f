"""Sets of character n-grams of many texts at once, as Arrow batch functions.

Interpreted lambdas over string arrays cost several times as much in the JVM. The n-grams of some hundred
texts are sorted together as numbers: a text's place in the high bits, a hash of the n-gram in the others.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

ROWS_BITS = 8  # texts sorted together; the other 56 bits tell n-grams apart
_DIGITS = re.compile(r"(?<!\d)\d{1,4}(?!\d)")
U64 = np.uint64


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def char_sets(texts: Sequence[str], n: int) -> np.ndarray:
    """The distinct n-grams of 2 ** ROWS_BITS stripped texts at most, sorted by text. A shorter text is its one n-gram."""
    cut = [t.strip() for t in texts]
    lens = np.array([len(t) for t in cut], np.int64)
    points = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32).astype(np.uint64)
    count = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    owner = np.repeat(np.arange(len(cut)), count)
    at = np.arange(count.sum()) + np.repeat(np.cumsum(lens) - lens - (np.cumsum(count) - count), count)
    left = np.repeat(np.cumsum(lens), count) - at
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = left > k
        h = (h ^ np.where(inside, points[np.minimum(at + k, max(len(points) - 1, 0))] + U64(1), U64(0)) if len(points) else h) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    h = (h * U64(0xBF58476D1CE4E5B9)) >> U64(ROWS_BITS)
    keys = np.sort(owner.astype(np.uint64) << U64(64 - ROWS_BITS) | h)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _sizes(keys: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount((keys >> U64(64 - ROWS_BITS)).astype(np.int64), minlength=rows)


def set_jaccard(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """From the sizes of two sets and of what they share; 1 for two empty ones."""
    union = a + b - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def gram_jaccard(prev: Sequence[str], curr: Sequence[str], n: int) -> np.ndarray:
    out = []
    for at in range(0, len(curr), 1 << ROWS_BITS):
        to = min(at + (1 << ROWS_BITS), len(curr))
        x, y = char_sets(prev[at:to], n), char_sets(curr[at:to], n)
        all_keys = np.sort(np.concatenate([x, y]))
        both = _sizes(all_keys[1:][all_keys[1:] == all_keys[:-1]], to - at)
        out.append(set_jaccard(_sizes(x, to - at), _sizes(y, to - at), both))
    return np.concatenate(out) if out else np.zeros(0)


def _word_jaccard(prev: Sequence[str], curr: Sequence[str]) -> np.ndarray:
    sets = [(set(a[:300].lower().split()), set(b[:300].lower().split())) for a, b in zip(prev, curr)]
    return set_jaccard(*(np.array(x, np.int64) for x in zip(*((len(a), len(b), len(a & b)) for a, b in sets)))) if sets else np.zeros(0)


def similarity(n: int):
    """Column function: Jaccard similarity of two texts' n-grams; null where one is null."""

    @F.arrow_udf("double")
    def run(prev: pa.Array, curr: pa.Array) -> pa.Array:
        null = prev.is_null().to_numpy(zero_copy_only=False) | curr.is_null().to_numpy(zero_copy_only=False)
        return pa.array(gram_jaccard(_texts(prev), _texts(curr), n), mask=null)

    return run


def distinct(n: int):
    """Column function: the distinct n-grams of a stripped text; null of null."""

    def grams(text: str) -> list[str]:
        t = text.strip()
        return list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1))) if len(t) >= n else [t] * bool(t)

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else grams(t) for t in text.to_pylist()], pa.list_(pa.string()))

    return run


@F.arrow_udf(ArrayType(DoubleType()))
def cross_features(prev: pa.Array, curr: pa.Array) -> pa.Array:
    """Seventeen numbers about two consecutive pages, as in text.CROSS_FEATURES; null texts count as empty."""
    a, b = _texts(prev), _texts(curr)
    part = lambda f: ([f(t) for t in a], [f(t) for t in b])
    columns = [gram_jaccard(*part(lambda t: t[:n]), 4) for n in (50, 150, 300, 600)]
    columns += [gram_jaccard(*part(lambda t: t[-n:]), 4) for n in (50, 150, 300, 600)]
    columns += [gram_jaccard(a, b, 4), gram_jaccard(*part(lambda t: t[:50]), 3), gram_jaccard(*part(lambda t: t[-50:]), 3), _word_jaccard(a, b)]
    x, y = (np.array(v, float) for v in part(len))
    low, high = np.minimum(x, y), np.maximum(x, y)
    r, s = (np.array(v, float) for v in part(lambda t: len(_DIGITS.findall(t[-300:]))))
    columns += [np.maximum(low, 1) / np.maximum(high, 1), np.abs(np.log1p(x) - np.log1p(y)), r, s, np.abs(r - s)]
    flat = np.stack(columns, 1).reshape(-1) if len(a) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * 17), pa.array(flat))
