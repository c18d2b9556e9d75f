"""Arrays of numbers as column expressions. Elements are taken as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Dot product over the norms, each with eps added."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def pair_difference(prev: Column, curr: Column) -> Column:
    """Both vectors, their difference and its absolute value: for structure, layout and visual features."""
    prev, curr = doubles(prev), doubles(curr)
    gap = F.zip_with(prev, curr, lambda x, y: x - y)
    return F.concat(prev, curr, gap, F.transform(gap, F.abs))


def pair_product(prev: Column, curr: Column) -> Column:
    """Both vectors, their product and absolute difference: for embeddings."""
    prev, curr = doubles(prev), doubles(curr)
    return F.concat(prev, curr, F.zip_with(prev, curr, lambda x, y: x * y), F.zip_with(prev, curr, lambda x, y: F.abs(x - y)))


def uniform(*key: Column | str | int) -> Column:
    """A number from 0 up to 1 that depends on the key alone: not on partitions, and the same in any SQL engine with md5."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
