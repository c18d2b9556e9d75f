"""The driver's tables as page streams, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pages as P


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five conversations make a stream, each is a document, a turn is a page."""
    t = read(spark, sf_dir, "conversations").withColumn("stream_id", F.floor(F.col("conv_id") / 5))
    w = W.partitionBy("stream_id").orderBy("conv_id", "turn")
    return t.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("conv_id").alias("source"), F.col("turn").alias("page"), (F.col("turn") == 0).alias("boundary"), "text")


V1 = """v1 as (select conv_id // 5 as stream_id, row_number() over (partition by conv_id // 5 order by conv_id, turn) - 1 as pos,
 conv_id as source, turn as page, turn = 0 as boundary, text from conversations)"""


def doc_rows(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Page rows of documents: their texts in parts of 1,000 characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = F.greatest(F.ceil(F.length("text") / size) - 1, F.lit(0)).cast("long")
    rows = d.withColumn("pg_id", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("doc_id", "pg_id", F.substr("text", (F.col("pg_id") * size + 1).cast("int"), F.lit(size)).alias("text"))


def doc_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents make a stream."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 10).alias("stream_id"), (F.col("doc_id") % 10).alias("doc_ord"), "doc_id")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("stream_id").orderBy("doc_id", "pg_id")
    rows = doc_rows(spark, sf_dir).withColumn("stream_id", F.floor(F.col("doc_id") / 10))
    return rows.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("doc_id").alias("source"), F.col("pg_id").alias("page"), (F.col("pg_id") == 0).alias("boundary"), "text")


V2 = """d2 as (select doc_id, coalesce(text, '') as text, unnest(range(greatest(cast(ceil(length(coalesce(text, '')) / 1000.0) as bigint), 1))) as pg_id from documents),
v2 as (select doc_id // 10 as stream_id, row_number() over (partition by doc_id // 10 order by doc_id, pg_id) - 1 as pos, doc_id as source, pg_id as page,
 pg_id = 0 as boundary, substring(text, pg_id * 1000 + 1, 1000) as text from d2)"""


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order: true boundaries after 6 hours' rest in whole seconds of the clock, predicted ones by kind, and a probability."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", F.lag("ts").over(w).alias("before"), (F.row_number().over(w) - 1).cast("long").alias("pos"))
    clock = lambda c: F.expr(f"(cast({c} as timestamp_ntz) - timestamp_ntz'1970-01-01') div interval '1' second")
    truth = (F.col("pos") == 0) | (clock("ts") - clock("before") > 21600)
    pred = (F.col("pos") == 0) | F.col("event_type").isin("click", "view", "error")
    prob = F.when(F.col("pos") == 0, 1.0).otherwise(((F.col("event_id") * 7919) % 997 + 1) / F.lit(1000.0))
    return e.select(F.col("user_id").alias("stream_id"), "pos", truth.alias("truth"), pred.alias("pred"), prob.alias("prob"))


V3 = """e3 as (select user_id, event_id, event_type, ts, lag(ts) over w as before, row_number() over w - 1 as pos from events window w as (partition by user_id order by ts, event_id)),
v3 as (select user_id as stream_id, pos, pos = 0 or epoch_us(ts) // 1000000 - epoch_us(before) // 1000000 > 21600 as truth, pos = 0 or event_type in ('click', 'view', 'error') as pred,
 case when pos = 0 then 1.0::double else ((event_id * 7919) % 997 + 1) / 1000.0::double end as prob from e3)"""


def vec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty embeddings make a stream; a boundary is where label div 5 changes."""
    w = W.partitionBy("stream_id").orderBy("pos")
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("stream_id"), (F.col("vec_id") % 20).cast("long").alias("pos"), "vec_id", "embedding", F.floor(F.col("label") / 5).alias("kind"))
    return e.withColumn("boundary", F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))).drop("kind")


V4 = """e4 as (select vec_id // 20 as stream_id, vec_id % 20 as pos, vec_id, [x::double for x in embedding] as embedding, label // 5 as kind from embeddings),
v4 as (select stream_id, pos, vec_id, embedding, coalesce(lag(kind) over (partition by stream_id order by pos) <> kind, true) as boundary from e4)"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of pages: an order is a page, a line a word, its figures the corners."""
    t = read(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    return t.select(F.col("l_orderkey").alias("page"), (d("l_discount") * 10).alias("x"), (d("l_quantity") / 50).alias("y"), (d("l_tax") / 2).alias("w"), (d("l_tax") / 4).alias("h"))


V5 = "v5 as (select l_orderkey as page, l_discount::double * 10 as x, l_quantity::double / 50 as y, l_tax::double / 2 as w, l_tax::double / 4 as h from lineitem)"


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_pages with a layout: a page has the word boxes of one order, in turn, or none where that order has none."""
    words = ocr_words(spark, sf_dir)
    boxes = words.groupBy(F.col("page").alias("sheet")).agg(F.array(*P.layout_aggregates(*(F.col(c) for c in "xywh"))).alias("layout"))
    last = F.broadcast(words.agg(F.max("page").alias("last")))  # one row
    pages = conv_pages(spark, sf_dir).crossJoin(last).withColumn("sheet", F.pmod(F.col("source") * 8 + F.col("page"), F.col("last") + 1))
    return pages.join(boxes, "sheet", "left").drop("sheet", "last")


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layout_pages with an embedding, of one vector in turn, and its first numbers in place of visual features."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sheet"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = F.broadcast(vectors.agg(F.count("*").alias("vectors")))  # one row
    pages = layout_pages(spark, sf_dir).crossJoin(n).withColumn("sheet", F.pmod(F.col("source") * 8 + F.col("page"), F.col("vectors")))
    return pages.join(vectors, "sheet").withColumn("visual", F.slice("embedding", 1, P.VISUAL_SIZE)).drop("sheet", "vectors")
