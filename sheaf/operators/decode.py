"""Smoothing of boundary probabilities by a two-state hidden Markov model.

State 1 opens a document, state 0 goes on with one. The sequence of a stream is decoded whole, in
an Arrow function that takes one step of all streams of a batch at a time: a stream is one stack of
pages, and the back-trace needs its end. Time grows with the number of pages.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import in_order

TINY = 1e-9


@dataclass(frozen=True)
class Rates:
    """Chances that a boundary follows a page inside a document, and one that opens it."""

    same_to_new: float = 0.05
    new_to_new: float = 0.05
    boundary_rate: float | None = None  # measured for reports; decoding doesn't use it


def calibrate(pages: DataFrame, before: Rates = Rates()) -> Rates:
    """Rates counted on labelled pages; a rate without a case stays as it was."""
    steps = pages.where(F.col("boundary").isNotNull()).withColumn("prev", F.lag("boundary").over(in_order())).where(F.col("prev").isNotNull())
    new, prev = F.col("boundary"), F.col("prev")
    c = steps.agg(F.count_if(~prev).alias("s"), F.count_if(~prev & new).alias("sn"), F.count_if(prev).alias("n"), F.count_if(prev & new).alias("nn"), F.count("*").alias("all"), F.count_if(new).alias("hits")).first()
    clamp = lambda x: min(max(x, TINY), 1 - TINY)
    out = before
    if c["s"]:
        out = replace(out, same_to_new=clamp(c["sn"] / c["s"]))
    if c["n"]:
        out = replace(out, new_to_new=clamp(c["nn"] / c["n"]))
    return replace(out, boundary_rate=clamp(c["hits"] / c["all"])) if c["all"] else out


def best_paths(p: np.ndarray, bounds: np.ndarray, rates: Rates) -> np.ndarray:
    """The states of sequences of probabilities that stand one after another; the first of each opens a document, whatever its p."""
    ln = lambda x: np.log(min(max(x, TINY), 1.0))
    s_n, s_s, n_n, n_s = ln(rates.same_to_new), ln(1 - rates.same_to_new), ln(rates.new_to_new), ln(1 - rates.new_to_new)
    e0, e1 = np.log(np.maximum(1 - p, TINY)), np.log(np.maximum(p, TINY))
    lens = np.diff(bounds)
    order = np.argsort(-lens, kind="stable")
    start, lens = bounds[:-1][order], lens[order]
    d0, d1 = np.full(len(lens), -np.inf), np.zeros(len(lens))
    back = np.zeros((2, len(p)), np.int8)
    alive = np.searchsorted(-lens, -np.arange(1, lens[0] + 1 if len(lens) else 1), side="right")  # sequences of over k pages
    for k in range(1, len(alive)):
        m = alive[k]
        at, a, b = start[:m] + k, d0[:m], d1[:m]
        a0, b0, a1, b1 = a + s_s, b + n_s, a + s_n, b + n_n
        back[0, at], back[1, at] = a0 < b0, a1 < b1
        d0[:m], d1[:m] = np.maximum(a0, b0) + e0[at], np.maximum(a1, b1) + e1[at]
    out = np.zeros(len(p), bool)
    now = np.where(d0 > d1, 0, 1)
    for k in range(len(alive) - 1, 0, -1):
        m = alive[k]
        at = start[:m] + k
        out[at] = now[:m] == 1
        now[:m] = back[now[:m], at]
    out[start[lens > 0]] = True
    return out


def decoded(probs: Column, rates: Rates) -> Column:
    """The states of an array of probabilities in order."""

    @F.arrow_udf("array<boolean>")
    def run(column: pa.Array) -> pa.Array:
        lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        p = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(best_paths(p, bounds, rates)))

    return run(probs)


def smooth(probs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """stream_id, pos, pred from stream_id, pos, prob."""
    steps = F.array_sort(F.collect_list(F.struct("pos", F.col("prob").cast("double").alias("p"))))
    states = probs.groupBy("stream_id").agg(steps.alias("steps")).withColumn("states", decoded(F.col("steps.p"), rates))
    flat = states.select("stream_id", F.explode(F.arrays_zip("steps", "states")).alias("x"))
    return flat.select("stream_id", F.col("x.steps.pos").alias("pos"), F.col("x.states").alias("pred"))


def late_ensemble(parts: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean prob of several models' (stream_id, pos, prob); the first page has 1."""
    if not parts:
        raise ValueError("an ensemble needs a model")
    weights = weights if weights is not None else [1.0] * len(parts)
    if len(weights) != len(parts) or min(weights) < 0 or sum(weights) == 0:
        raise ValueError("there must be one weight for each model, none negative and not all 0")
    total = float(sum(weights))
    rows = None
    for part, w in zip(parts, weights):
        one = part.select("stream_id", "pos", (F.col("prob") * F.lit(float(w))).alias("prob"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("stream_id", "pos").agg(F.when(F.col("pos") == 0, 1.0).otherwise(F.sum("prob") / total).alias("prob"))


def threshold(probs: DataFrame, at: float = 0.5) -> DataFrame:
    """pred: prob over at, and the first page."""
    return probs.withColumn("pred", (F.col("pos") == 0) | (F.col("prob") > at))
