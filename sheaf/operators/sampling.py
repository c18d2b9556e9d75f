"""Reproducible sampling: every draw is a hash of the seed and of what is drawn, so it depends on no partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import uniform
from .streams import ordinals

#: Documents whose hashes are sorted at once for a stream.
PART = 4096


def poisson(mean: float, seed: int, key: Column, tag: str = "poisson") -> Column:
    """A Poisson number for each key: how many draws fit before their product falls to e ** -mean."""
    if mean <= 0:
        raise ValueError("mean must be over 0")
    if mean > 500:
        raise ValueError("mean must be 500 at most: e ** -mean would be 0")
    most = int(mean + 12 * math.sqrt(mean) + 30)
    start = F.struct(F.lit(1.0).alias("product"), F.lit(0).alias("n"), F.lit(False).alias("over"))
    draw = lambda k: uniform(seed, tag, key, k)

    def step(s: Column, k: Column) -> Column:
        product = s["product"] * draw(k)
        over = s["over"] | (product <= math.exp(-mean))
        return F.struct(product.alias("product"), (s["n"] + F.when(over, 0).otherwise(1)).alias("n"), over.alias("over"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), start, step)["n"]


def stream_specs(docs: DataFrame, n_streams: int, mean_docs: float, seed: int = 0, doc: str = "source") -> DataFrame:
    """stream_id, doc_ord and a document: in each of n_streams a Poisson number of distinct documents, one at least.

    A stream's choices are the documents of lowest hash of stream and place in the pool's order, whatever the pool's
    size. So every stream hashes the whole pool, in parts: no array or sort grows with it but by a part's first choices.
    """
    if n_streams < 1 or mean_docs <= 0:
        raise ValueError("n_streams must be 1 at least and mean_docs over 0")
    pool = ordinals(docs, doc)
    size = pool.select("n_all").first()
    if size is None:
        raise ValueError("there are no documents to sample from")
    n = int(size["n_all"])
    streams = docs.sparkSession.range(n_streams).withColumnRenamed("id", "stream_id")
    wanted = F.least(F.greatest(poisson(mean_docs, seed, F.col("stream_id")), F.lit(1)), F.lit(n)).cast("int")
    picks = streams.withColumn("wanted", wanted)
    parts = docs.sparkSession.range(-(-n // PART)).select((F.col("id") * PART).alias("start"))  # one row for each PART documents
    places = F.transform(F.sequence("start", F.least(F.col("start") + PART - 1, F.lit(n - 1))), lambda k: F.struct(uniform(seed, "doc", F.col("stream_id"), k).alias("u"), k.alias("ord")))
    first = picks.crossJoin(F.broadcast(parts)).select("stream_id", "wanted", F.explode(F.slice(F.array_sort(places), 1, F.col("wanted"))).alias("s"))
    order = F.row_number().over(W.partitionBy("stream_id").orderBy("s.u", "s.ord")) - 1
    rows = first.withColumn("doc_ord", order).where("doc_ord < wanted").select("stream_id", "doc_ord", "s.ord")
    return rows.join(pool.drop("n_all"), "ord").select("stream_id", F.col("doc_ord").cast("long").alias("doc_ord"), doc)


def build_streams(specs: DataFrame, pages: DataFrame) -> DataFrame:
    """Long-form streams of the documents in specs; pages: source, page, and more columns, a row a page.

    A document is one set of pages however many streams it was taken from. Its first page is a boundary.
    """
    distinct = pages.dropDuplicates(["source", "page"]).drop("stream_id", "pos", "boundary")
    w = W.partitionBy("stream_id").orderBy("doc_ord", "page")
    own = W.partitionBy("stream_id", "doc_ord").orderBy("page")
    out = specs.join(distinct, "source").withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return out.withColumn("boundary", F.row_number().over(own) == 1)


def resample(pages: DataFrame, n_streams: int = 200, mean_docs: float = 3.0, seed: int = 0) -> DataFrame:
    """New streams of the documents (sources) of pages."""
    return build_streams(stream_specs(pages, n_streams, mean_docs, seed), pages)


def doc_split(pages: DataFrame, train_frac: float = 0.8, seed: int = 0) -> DataFrame:
    """source and train: a split by shuffled documents, max(1, n * train_frac) of them for training."""
    keyed = pages.select("source").distinct().withColumn("u", uniform(seed, "split", F.col("source")))
    order = ordinals(keyed, "u", "source")
    cut = F.greatest(F.lit(1), F.floor(F.col("n_all") * F.lit(train_frac)))
    return order.select("source", (F.col("ord") < cut).alias("train"))


def fair_split(pages: DataFrame, n_train: int = 400, n_test: int = 100, mean_docs: float = 3.0, train_frac: float = 0.8, seed: int = 0) -> DataFrame:
    """Streams for training and testing (column train) that share no document."""
    split = doc_split(pages, train_frac, seed)
    out = None
    for train, n in ((True, n_train), (False, n_test)):
        part = pages.join(split.where(F.col("train") == train), "source", "left_semi")
        if part.isEmpty():
            raise ValueError("a side of the split has no document")
        streams = resample(part, n, mean_docs, seed + (0 if train else 1)).withColumn("train", F.lit(train))
        out = streams if out is None else out.unionByName(streams)
    return out


def kfold(pages: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """stream_id and fold: shuffled streams in k runs, the first n % k of them one longer."""
    keyed = pages.select("stream_id").distinct().withColumn("u", uniform(seed, "fold", F.col("stream_id")))
    order = ordinals(keyed, "u", "stream_id")
    n, small = F.col("n_all"), F.floor(F.col("n_all") / k)
    long_part = (n % k) * (small + 1)
    fold = F.when(F.col("ord") < long_part, F.floor(F.col("ord") / (small + 1))).otherwise((n % k) + F.floor((F.col("ord") - long_part) / F.greatest(small, F.lit(1))))
    return order.select("stream_id", fold.alias("fold"))
