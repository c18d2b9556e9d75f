"""Page streams in long form: stream_id, pos, source, page, boundary.

A stream is one finite stack of pages. Positions run from 0 without gaps; the first page of a
labelled stream is a boundary; in an unlabelled one every boundary is null.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["source", "page"]


def in_order(stream: str = "stream_id", pos: str = "pos") -> W:
    return W.partitionBy(stream).orderBy(pos)


def check_streams(pages: DataFrame) -> DataFrame:
    """A row for each stream with what is wrong with it, null if nothing is."""
    first = F.max(F.when(F.col("pos") == 0, F.col("boundary")))
    marks = F.count("boundary")
    per = pages.groupBy("stream_id").agg(F.count("*").alias("n_pages"), F.count_distinct("pos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"), marks.alias("marks"), first.alias("opens"), F.count_if("boundary").alias("n_documents"))
    n = F.col("n_pages")
    fault = (
        F.when((F.col("low") != 0) | (F.col("high") + 1 != n) | (F.col("places") != n), "positions don't run from 0 without gaps")
        .when((F.col("marks") != 0) & (F.col("marks") != n), "some pages have no boundary")
        .when((F.col("marks") > 0) & ~F.col("opens"), "the first page is no boundary")
    )
    documents = F.when(F.col("marks") > 0, F.col("n_documents"))
    return per.select("stream_id", "n_pages", documents.alias("n_documents"), fault.alias("fault"))


def require_streams(pages: DataFrame, labelled: bool = False) -> DataFrame:
    """pages, if all streams are sound (and labelled)."""
    bad = check_streams(pages).where(F.col("fault").isNotNull() | (F.lit(labelled) & F.col("n_documents").isNull())).limit(1).collect()
    if bad:
        raise ValueError(f"stream {bad[0]['stream_id']}: {bad[0]['fault'] or 'has no labels'}")
    return pages


def with_boundaries(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """pages with the boundaries of another frame (stream_id, pos, boundary), which must cover them all."""
    out = pages.drop("boundary").join(boundaries.select("stream_id", "pos", "boundary"), ["stream_id", "pos"])
    if out.count() != pages.count() or boundaries.count() != pages.count():
        raise ValueError("there must be one boundary for each page")
    return require_streams(out)


def summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_distinct("stream_id").alias("n_streams"), F.count("*").alias("n_pages"), F.count_if("boundary").alias("n_documents"))


def filter_by_length(pages: DataFrame, min_pages: int = 1, max_pages: int = 10**9) -> DataFrame:
    """Streams of min_pages to max_pages."""
    sizes = pages.groupBy("stream_id").agg(F.count("*").alias("n"))
    return pages.join(sizes.where(F.col("n").between(min_pages, max_pages)), "stream_id", "left_semi")


def prune(side: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of a side table (source, page, ..) whose page is in pages."""
    return side.join(pages.select(*KEY), KEY, "left_semi")


def document_ids(flag: str = "boundary") -> Column:
    """Number of the document a page is in, from 0."""
    return F.sum(F.col(flag).cast("int")).over(in_order().rowsBetween(W.unboundedPreceding, 0)) - 1


def spans(pages: DataFrame, flag: str = "boundary") -> DataFrame:
    """stream_id, doc, start, stop: the pages start up to stop make a document."""
    return pages.withColumn("doc", document_ids(flag)).groupBy("stream_id", "doc").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))


def pairs(pages: DataFrame, *columns: str) -> DataFrame:
    """Pages after the first, with prev_ and curr_ values of the columns."""
    w = in_order()
    out = pages
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumnRenamed(c, f"curr_{c}")
    return out.where("pos >= 1")


def positions(pages: DataFrame) -> DataFrame:
    """pages with relative position, its rest, and the stream's length."""
    n = F.count("*").over(W.partitionBy("stream_id"))
    span = F.greatest(n - 1, F.lit(1)).cast("double")
    return pages.withColumn("n_pages", n).withColumn("relative", F.col("pos") / span).withColumn("remaining", (n - 1 - F.col("pos")) / span)


def neighbours(pages: DataFrame, prob: str = "prob", window: int = 2) -> DataFrame:
    """pages with prob of the pages around (0 outside the stream) and max, mean and deviation over all but the first page."""
    out, w = pages, in_order()
    for k in range(-window, window + 1):
        value = F.lag(prob, -k, 0.0).over(w) if k < 0 else F.lead(prob, k, 0.0).over(w) if k else F.col(prob)
        out = out.withColumn(f"near_{k + window}", value)
    tail = F.when(F.col("pos") >= 1, F.col(prob))
    every = W.partitionBy("stream_id")
    for name, f in (("tail_max", F.max), ("tail_mean", F.avg), ("tail_std", F.stddev_pop)):
        out = out.withColumn(name, F.coalesce(f(tail).over(every), F.lit(0.0)))
    return positions(out)


def split_streams(pages: DataFrame, frac: float = 0.8) -> DataFrame:
    """pages with train: whether the stream is among the first max(1, n * frac), by stream_id."""
    order = ordinals(pages)
    cut = F.greatest(F.lit(1), F.floor(F.col("n_all") * F.lit(frac)))
    return pages.join(order.select("stream_id", (F.col("ord") < cut).alias("train")), "stream_id")


def slice_streams(pages: DataFrame, n_slices: int) -> DataFrame:
    """pages with slice_id: equal runs of streams by stream_id; the remainder has no slice and goes."""
    if n_slices < 2:
        raise ValueError("there must be two slices at least")
    order = ordinals(pages)
    size = F.floor(F.col("n_all") / n_slices)
    sliced = order.where(size > 0).select("stream_id", F.floor(F.col("ord") / size).alias("slice_id")).where(F.col("slice_id") < n_slices)
    return pages.join(sliced, "stream_id")


def ordinals(pages: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys (stream_id by default) with ord, the place among all in order, from 0, and n_all, their number.

    They are cut into ranges at approximate percentiles of the first key and numbered in each; only
    the ranges' sizes pass through one task. Of strings, the seven bytes after the prefix that all share make the number that is cut.
    """
    keys = keys or ("stream_id",)
    rows = pages.select(*keys).distinct()
    key, kind = keys[0], dict(rows.dtypes)[keys[0]]
    number = F.col(key)
    if kind == "string":
        ends = rows.agg(F.min(key), F.max(key)).first()
        shared = len(os.path.commonprefix([(x or "").encode() for x in ends]))
        raw = F.hex(F.substring(F.col(key).cast("binary"), shared + 1, 7))
        number = F.coalesce(F.conv(F.rpad(raw, 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))
    elif kind not in ("bigint", "int", "smallint", "double"):
        raise TypeError(f"rows can't be numbered by {key}, which is {kind}")
    rows = rows.withColumn("_number", number)
    cuts = rows.agg(F.percentile_approx("_number", [k / 200 for k in range(1, 200)], 2000).alias("cuts"))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("_number")))).drop("cuts", "_number")  # one row of 199 numbers
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n_all", F.sum("n").over(W.partitionBy()))
    placed = ranged.withColumn("ord", F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1)
    return placed.join(F.broadcast(sizes), "part").select(*keys, (F.col("ord") + F.col("before")).alias("ord"), "n_all")  # 200 rows at most
