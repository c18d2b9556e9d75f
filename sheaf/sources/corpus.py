"""Corpora: streams in long form with text, layout and visual tables keyed by (source, page)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pages import LAYOUT_SIZE, VISUAL_SIZE, image_features, ocr_layout, ocr_text
from ..functions.pdf import page_count, page_texts
from ..functions.vectors import zeros
from ..operators import streams
from ..operators.streams import KEY

TABLES = {"pages": "stream_id string, pos long, source string, page long, boundary boolean", "text": "source string, page long, text string", "layout": "source string, page long, layout array<double>", "visual": "source string, page long, visual array<double>"}


@dataclass
class Corpus:
    pages: DataFrame
    text: DataFrame
    layout: DataFrame | None = None
    visual: DataFrame | None = None

    def save(self, path: str) -> None:
        for name in TABLES:
            if (part := getattr(self, name)) is not None:
                part.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Corpus:
        """A saved corpus. Layout and visual tables may be missing."""

        def table(name: str) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{path}/{name}")
            except AnalysisException as e:
                if name in ("pages", "text") or e.getCondition() != "PATH_NOT_FOUND":
                    raise
                return None

        return Corpus(*(table(name) for name in TABLES))

    def with_text(self, strict: bool = True) -> DataFrame:
        """pages with text; a page without is an error if strict."""
        return resolve(self.pages, self.text, "text", strict)

    @property
    def has_layout(self) -> bool:
        return self.layout is not None and not self.layout.isEmpty()

    @property
    def has_visual(self) -> bool:
        return self.visual is not None and not self.visual.isEmpty()

    def with_layout(self, strict: bool = False) -> DataFrame:
        """pages with layout: zeros where a page has none, or an error if strict."""
        return self._with("layout", LAYOUT_SIZE, strict)

    def with_visual(self, strict: bool = False) -> DataFrame:
        """pages with visual features, as with_layout."""
        return self._with("visual", VISUAL_SIZE, strict)

    def _with(self, column: str, size: int, strict: bool) -> DataFrame:
        side = getattr(self, column)
        if not strict:
            return with_default(self.pages, side, column, size)
        if side is None:
            raise ValueError(f"the corpus has no {column} features")
        return resolve(self.pages, side, column)

    def filtered(self, min_pages: int = 1, max_pages: int = 10**9) -> Corpus:
        """Only streams of a length in the bounds, and what belongs to them."""
        return self.only(streams.filter_by_length(self.pages, min_pages, max_pages))

    def only(self, pages: DataFrame) -> Corpus:
        cut = lambda t: t if t is None else streams.prune(t, pages)
        return Corpus(pages, cut(self.text), cut(self.layout), cut(self.visual))

    def merged(self, other: Corpus) -> Corpus:
        """Streams of both; where both have a page's text, layout or visual, the other's counts."""
        both = lambda a, b: right_wins(a, b) if a is not None and b is not None else a if b is None else b
        return Corpus(self.pages.unionByName(other.pages), both(self.text, other.text), both(self.layout, other.layout), both(self.visual, other.visual))


def resolve(pages: DataFrame, side: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """pages with a column of a side table. If strict, reading a page that has none fails."""
    out = pages.join(side.select(*KEY, column).withColumn("_there", F.lit(True)), KEY, "left")
    if strict:
        miss = F.raise_error(F.concat(F.lit(f"no {column} for page "), F.col("page").cast("string"), F.lit(" of "), F.col("source").cast("string")))
        out = out.withColumn(column, F.when(F.col("_there"), F.col(column)).otherwise(miss.cast(side.schema[column].dataType)))
    return out.drop("_there")


def with_default(pages: DataFrame, side: DataFrame | None, column: str, size: int) -> DataFrame:
    """pages with a feature array, zeros where the side table has none."""
    if side is None:
        return pages.withColumn(column, zeros(size))
    return pages.join(side.select(*KEY, column), KEY, "left").withColumn(column, F.coalesce(column, zeros(size)))


def right_wins(left: DataFrame, right: DataFrame) -> DataFrame:
    """All keys (source, page) of both; the right one's row where both have it."""
    return left.join(right, KEY, "left_anti").unionByName(right)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*")


def from_rows(rows: DataFrame, namespace: str, boundaries: str = "boundaries", stream_id: str = "stream_id", page_ids: str | None = None, texts: str | None = None, max_streams: int | None = None, order: str | None = None) -> Corpus:
    """A corpus from a stream a row: arrays of boundaries and, if named, of page ids and texts.

    Without page ids they are "stream/position". Numbers count as true unless 0; strings are refused,
    since "False" would count as true. Arrays of other lengths are refused when read. max_streams keeps the first rows by `order`
    (by stream_id without). Of a page that comes twice, the last text counts.
    """
    kind = dict(rows.dtypes)[boundaries]
    if "string" in kind:
        raise ValueError("boundaries must be booleans or numbers")
    if max_streams is not None:
        rows = rows.orderBy(order or stream_id).limit(max_streams)
    if rows.isEmpty():
        raise ValueError("there are no streams")
    n = F.size(boundaries)
    for column in filter(None, (page_ids, texts)):
        rows = rows.withColumn(column, F.when(F.size(column) == n, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} and {boundaries} differ in length in stream "), F.col(stream_id).cast("string"))).cast(rows.schema[column].dataType)))
    sid = F.col(stream_id).cast("string")
    ids = F.col(page_ids).cast("array<string>") if page_ids else F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(sid, F.lit("/"), k.cast("string")))
    ids = F.when(n > 0, ids).otherwise(F.raise_error("a stream must have a page").cast("array<string>"))
    parts = [F.col(boundaries).cast("array<boolean>").alias("boundary"), ids.alias("id"), (F.col(texts).cast("array<string>") if texts else F.array_repeat(F.lit(None).cast("string"), n)).alias("text")]
    long = rows.select(sid.alias("sid"), F.posexplode(F.arrays_zip(*parts)).alias("pos", "x")).withColumnRenamed("sid", "stream_id")
    long = long.select("stream_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit(f"{namespace}:"), F.col("x.id")).alias("source"), F.lit(0).cast("long").alias("page"), F.col("x.boundary").alias("boundary"), F.col("x.text").alias("text"))
    text = last_wins(long.select(*KEY, "text", F.struct("stream_id", "pos").alias("at")), KEY, "at").select(*KEY, "text") if texts else long.select(*KEY, "text").limit(0)
    return Corpus(long.drop("text"), text)


def load_rows(spark: SparkSession, path: str, namespace: str | None = None, file_format: str = "parquet", **options) -> Corpus:
    """from_rows over an exported dataset; the namespace is the path's last part unless given."""
    return from_rows(spark.read.format(file_format).load(path), namespace or path.rstrip("/").split("/")[-1], **options)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, doc_ord, doc_id from lines "document stream"; other lines are passed over.

    File order is kept: one small file of definitions is read as one row and numbered there.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line", "raw"))
    tokens = F.filter(F.split("raw", r"(?U)\s+"), lambda t: t != "")
    rows = lines.select("line", tokens.alias("t")).where("size(t) = 2").select("line", F.col("t")[0].alias("doc_id"), F.col("t")[1].cast("long").alias("stream_id"))
    return rows.select("stream_id", (F.row_number().over(W.partitionBy("stream_id").orderBy("line")) - 1).cast("long").alias("doc_ord"), "doc_id")


def first_streams(definitions: DataFrame, max_streams: int | None) -> DataFrame:
    """The definitions of the max_streams lowest ids; later steps may still drop some of them."""
    if max_streams is None:
        return definitions
    ids = definitions.select("stream_id").distinct().orderBy("stream_id").limit(max_streams)
    return definitions.join(ids, "stream_id", "left_semi")


def needed_rows(definitions: DataFrame, rows: DataFrame) -> DataFrame:
    """The page rows of documents that some definition names."""
    return rows.join(definitions.select("doc_id").distinct(), "doc_id", "left_semi")


def described(rows: DataFrame) -> DataFrame:
    """Page rows with text and layout of a column ocr, and visual features of a column img, where they lack them."""
    made = rows
    if "ocr" in rows.columns:
        for name, f in (("text", ocr_text), ("layout", ocr_layout)):
            if name not in rows.columns:
                made = made.withColumn(name, f(F.col("ocr")))
    if "img" in rows.columns and "visual" not in rows.columns:
        made = made.withColumn("visual", image_features()(F.col("img")))
    return made.drop("ocr", "img")


def build_corpus(definitions: DataFrame, rows: DataFrame, max_streams: int | None = None) -> Corpus:
    """Streams from definitions (stream_id, doc_ord, doc_id) and page rows (doc_id, pg_id, text and maybe layout, visual, row_ord).

    Documents stand in the definitions' order, pages by pg_id; page 0 of a document is a boundary. Of rows for one
    page the last by row_ord counts (without it the greatest). Streams without a page go; none left is an error.
    """
    definitions = first_streams(definitions, max_streams)
    rows = described(needed_rows(definitions, rows))
    rows = last_wins(rows if "row_ord" in rows.columns else rows.withColumn("row_ord", F.struct(*(c for c in rows.columns if c not in ("doc_id", "pg_id")))), ["doc_id", "pg_id"], "row_ord").drop("row_ord")
    w = W.partitionBy("stream_id").orderBy("doc_ord", "pg_id")
    pages = definitions.join(rows.select("doc_id", "pg_id"), "doc_id").select(F.col("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("doc_id").cast("string").alias("source"), F.col("pg_id").cast("long").alias("page"), (F.col("pg_id") == 0).alias("boundary"))
    if pages.isEmpty():
        raise ValueError("no stream has a page")
    side = rows.withColumnsRenamed({"doc_id": "source", "pg_id": "page"}).withColumn("source", F.col("source").cast("string")).withColumn("page", F.col("page").cast("long"))
    part = lambda c: side.select(*KEY, c) if c in side.columns else None
    return Corpus(pages, part("text"), part("layout"), part("visual"))


def concat_sources(sources: DataFrame) -> DataFrame:
    """Pages and labels of sources (stream_id, doc_ord, source, n_pages) put one after another; a source without pages is refused."""
    n = F.when(F.col("n_pages") > 0, F.col("n_pages")).otherwise(F.raise_error(F.concat(F.col("source"), F.lit(" has no page"))).cast("long"))
    pages = sources.select("stream_id", "doc_ord", "source", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("page"))
    w = W.partitionBy("stream_id").orderBy("doc_ord", "page")
    return pages.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "source", "page", (F.col("page") == 0).alias("boundary"))


def scan_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """source (path under root without suffix), path and content of the files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    rest = F.substring_index(F.col("path"), base, -1)
    return found.select(F.regexp_replace(rest, r"\.[^./]*$", "").alias("source"), "path", "content")


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """source and path, in order of path; contents aren't read."""
    return scan_files(spark, root, pattern).select("source", "path").orderBy("path")


def page_counts(files: DataFrame, count=page_count) -> DataFrame:
    """source and n_pages of files; count tells it from the bytes of one."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"source": batch["source"], "n_pages": [count(raw) for raw in batch["content"]]})

    return files.select("source", "content").mapInPandas(run, "source string, n_pages long")


def file_text(pages: DataFrame, files: DataFrame, parse=page_texts) -> DataFrame:
    """pages (source, page) with the text of that page of the file named source, with or without a suffix.

    Each file that is asked for is parsed once. A file that isn't there and a page that a file doesn't have are errors.
    """
    wanted = pages.select(F.regexp_replace("source", r"\.pdf$", "").alias("source")).distinct()
    texts = file_pages(files.join(wanted, "source", "left_semi"), parse)
    sizes = texts.groupBy(F.col("source").alias("_file")).agg(F.count("*").alias("_pages"))
    out = pages.withColumn("_file", F.regexp_replace("source", r"\.pdf$", ""))
    out = out.join(sizes, "_file", "left").join(texts.select(F.col("source").alias("_file"), "page", "text"), ["_file", "page"], "left")
    miss = F.when(F.col("_pages").isNull(), F.concat(F.lit("there is no file "), F.col("source"))).otherwise(F.concat(F.col("source"), F.lit(" has no page "), F.col("page").cast("string")))
    text = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(miss).cast("string"))
    return out.select(*pages.columns, text.alias("text"))


def file_pages(files: DataFrame, parse=page_texts) -> DataFrame:
    """source, page, text of files; parse turns the bytes of one into a list of page texts, and is called once a file."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(s, k, t) for s, raw in zip(batch["source"], batch["content"]) for k, t in enumerate(parse(raw))]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.select("source", "content").mapInPandas(run, "source string, page long, text string")
