"""How well predicted boundaries match true ones.

Input: a page a row, with stream_id, pos, and booleans truth and pred. Every metric is computed for
each stream; `report` averages over streams, so that long ones don't dominate.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .streams import document_ids


def side_by_side(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Two labellings (stream_id, pos, boundary); null where one lacks a page."""
    return truth.select("stream_id", "pos", F.col("boundary").alias("truth")).join(pred.select("stream_id", "pos", F.col("boundary").alias("pred")), ["stream_id", "pos"], "full")


def paired(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """side_by_side, if both label the same pages."""
    return checked(side_by_side(truth, pred))


def checked(pages: DataFrame) -> DataFrame:
    """pages, if no label is missing and every stream opens with boundaries in both."""
    bad = F.col("truth").isNull() | F.col("pred").isNull() | ((F.col("pos") == 0) & ~(F.col("truth") & F.col("pred")))
    opens = pages.agg(F.count_if(bad).alias("bad"), F.count_distinct("stream_id").alias("n"), F.count_if(F.col("pos") == 0).alias("opens")).first()
    if not opens["n"]:
        raise ValueError("there are no streams")
    if opens["bad"] or opens["opens"] != opens["n"]:
        raise ValueError("labels must cover the same pages, and the first page of each stream must be a boundary")
    return pages


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1)).cast("double")).otherwise(0.0)


def page_scores(pages: DataFrame) -> DataFrame:
    """Precision, recall and F1 of boundaries after the first page; 0 where undefined, so also for one document found whole."""
    inner = F.col("pos") > 0
    n = pages.groupBy("stream_id").agg(F.count_if(inner & F.col("truth") & F.col("pred")).alias("tp"), F.count_if(inner & F.col("pred")).alias("p"), F.count_if(inner & F.col("truth")).alias("t"))
    # F1 from precision and recall, as it is defined
    out = n.withColumn("precision", _ratio(F.col("tp"), F.col("p"))).withColumn("recall", _ratio(F.col("tp"), F.col("t")))
    total = F.col("precision") + F.col("recall")
    return out.select("stream_id", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"))


def panoptic(pages: DataFrame) -> DataFrame:
    """Recognition, segmentation and panoptic quality.

    Overlaps are counted by pages, as pairs (true document, predicted document) that meet; an
    overlap of over half the union leaves no room for a second, so matching needs no search.
    """
    d = pages.withColumn("t", document_ids("truth")).withColumn("p", document_ids("pred"))
    meet = d.groupBy("stream_id", "t", "p").agg(F.count("*").alias("n"))
    t, p = meet.groupBy("stream_id", "t").agg(F.sum("n").alias("nt")), meet.groupBy("stream_id", "p").agg(F.sum("n").alias("np"))
    iou = F.col("n") / (F.col("nt") + F.col("np") - F.col("n"))
    hits = meet.join(t, ["stream_id", "t"]).join(p, ["stream_id", "p"]).withColumn("iou", iou).where("iou > 0.5")
    hits = hits.groupBy("stream_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("sum_iou"))
    size = pages.groupBy("stream_id").agg((F.count_if("truth") + F.count_if("pred")).alias("docs"))
    out = size.join(hits, "stream_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("rq", 2.0 * F.col("tp") / F.col("docs"))
    out = out.withColumn("sq", F.when(F.col("tp") > 0, F.col("sum_iou") / F.greatest("tp", F.lit(1))).otherwise(0.0))
    return out.select("stream_id", "rq", "sq", (F.col("rq") * F.col("sq")).alias("pq"))


def exact(pages: DataFrame) -> DataFrame:
    """Whether a stream is predicted without fault: straight-through processing."""
    return pages.groupBy("stream_id").agg(F.bool_and(F.col("truth") == F.col("pred")).alias("exact"))


def moved(p: list[int], t: list[int], n: list[int]) -> int:
    """Pages outside the assignment of predicted documents p to true ones t that share n pages."""
    size: dict[int, int] = {}
    wishes: dict[int, list] = {}
    for a, b, k in zip(p, t, n):
        size[a] = size.get(a, 0) + k
        wishes.setdefault(a, []).append((-k, b))
    taken: set[int] = set()
    right = 0
    for a in sorted(size, key=lambda x: (-size[x], x)):
        for k, b in sorted(wishes[a]):
            if b not in taken:
                taken.add(b)
                right -= k
                break
    return sum(n) - right


@F.arrow_udf(LongType())
def _moved(p: pa.Array, t: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([moved(*x) for x in zip(p.to_pylist(), t.to_pylist(), n.to_pylist())], pa.int64())


def drags(pages: DataFrame) -> DataFrame:
    """Drag-and-drops that a reviewer needs: pages whose predicted document isn't assigned to their own.

    Predicted documents choose in order of size (then of number), each the true document it shares
    most pages with (then the lower number) of those still free.
    """
    d = pages.withColumn("t", document_ids("truth")).withColumn("p", document_ids("pred"))
    meet = d.groupBy("stream_id", "p", "t").agg(F.count("*").alias("n"))
    per = meet.groupBy("stream_id").agg(F.collect_list(F.struct("p", "t", "n")).alias("m"))
    return per.select("stream_id", _moved("m.p", "m.t", "m.n").alias("drags"))


def per_stream(pages: DataFrame) -> DataFrame:
    """All metrics, a row a stream."""
    out = page_scores(pages).join(panoptic(pages), "stream_id").join(exact(pages), "stream_id")
    return out.join(drags(pages), "stream_id")


def report(pages: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """Means over streams; with keys, for each group of streams in `of` (stream_id and the keys)."""
    rows = per_stream(pages)
    if keys:
        rows = rows.join(of.select("stream_id", *keys).distinct(), "stream_id")
    means = [F.count("*").alias("n_streams"), F.avg("f1").alias("page_f1_mean"), F.avg("pq").alias("pq_mean"), F.avg(F.col("exact").cast("double")).alias("stp"), F.avg("drags").alias("mndd_mean")]
    return rows.groupBy(*keys).agg(*means) if keys else rows.agg(*means)


__all__ = ["checked", "drags", "exact", "page_scores", "paired", "panoptic", "per_stream", "report", "side_by_side"]
