"""Known data sources of page streams, as literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODALITIES, LABELINGS = ("image", "text", "image+text"), ("pss_labeled", "single_doc_pdfs", "bulk_corpus")
SCHEMA = "name string, languages array<string>, modality string, labeling string, pages_estimate long, license string, url string, notes string"
_EU = "bg cs da de el en es et fi fr ga hr hu it lt lv mt nl pl pt ro sk sl sv".split()
_ROWS = [
    ("ai_lab_splitter", ["pt"], "image", "pss_labeled", 31_789),
    ("arxiv", ["en"], "image+text", "single_doc_pdfs", None),
    ("bundestag_drucksachen", ["de"], "image+text", "single_doc_pdfs", None),
    ("doclaynet", ["en", "de", "fr", "ja"], "image+text", "single_doc_pdfs", 80_863),
    ("eurlex", _EU, "image+text", "single_doc_pdfs", None),
    ("iit_cdip", ["en"], "image+text", "bulk_corpus", 7_000_000),
    ("openpss_long", ["nl"], "image+text", "pss_labeled", 89_491),
    ("openpss_short", ["nl"], "image+text", "pss_labeled", 52_177),
    ("tabme_pp", ["en"], "image+text", "pss_labeled", 3_300_000),
    ("tobacco800", ["en"], "image+text", "pss_labeled", 1_290),
    ("wooir", ["nl"], "image+text", "pss_labeled", 44_975),
]


class Registry:
    """Sources by name. A name can be registered once."""

    def __init__(self):
        self.rows: dict[str, tuple] = {}

    def register(self, name: str, languages: list[str], modality: str, labeling: str, pages_estimate: int | None = None, license: str | None = None, url: str = "", notes: str | None = None) -> None:
        if name in self.rows:
            raise ValueError(f"source {name!r} is already registered")
        if modality not in MODALITIES or labeling not in LABELINGS:
            raise ValueError(f"source {name!r} has an unknown modality or labeling")
        self.rows[name] = (name, languages, modality, labeling, pages_estimate, license, url, notes)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.rows[k] for k in sorted(self.rows)], SCHEMA)


def known() -> Registry:
    made = Registry()
    for row in _ROWS:
        made.register(*row)
    return made


def listing(sources: DataFrame) -> DataFrame:
    """One line for each source: name, languages, number of pages (? if unknown), address."""
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    pages = F.coalesce(F.format_number("pages_estimate", 0), F.lit("?"))
    pages = F.when(F.length(pages) < 12, F.lpad(pages, 12, " ")).otherwise(pages)
    return sources.select("name", F.concat_ws(" ", wide(F.col("name"), 24), wide(F.array_join("languages", ","), 10), pages, F.coalesce("url", F.lit(""))).alias("line"))
