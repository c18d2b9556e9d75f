"""Scoring a model on streams, once or walking forward through slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import metrics, streams


def labelled_pairs(model, pages: DataFrame) -> DataFrame:
    """stream_id, pos, truth and pred of all pages."""
    found = model.predict(pages).select("stream_id", "pos", F.col("pred").alias("boundary"))
    return metrics.side_by_side(pages, found)


def _report(found: DataFrame, *keys: str, of: DataFrame | None = None) -> list[Row]:
    """The report's rows (few); the labels are made once, since every metric reads them."""
    found = found.persist()
    try:
        metrics.checked(found)
        return metrics.report(found, *keys, of=of).collect()
    finally:
        found.unpersist()


def evaluate(model, pages: DataFrame) -> DataFrame:
    """One row: n_streams, page_f1_mean, pq_mean, stp, mndd_mean."""
    streams.require_streams(pages, labelled=True)
    schema = "n_streams long, page_f1_mean double, pq_mean double, stp double, mndd_mean double"
    return pages.sparkSession.createDataFrame(_report(labelled_pairs(model, pages)), schema)


def walk_forward(models: list, pages: DataFrame) -> list[Row]:
    """For each slice but the last: fit on it and those before, test on the next.

    pages has slice_id and slice_name. A model without fit is applied as it is, to all slices at once.
    """
    slices = [tuple(r) for r in pages.select("slice_id", "slice_name").distinct().orderBy("slice_id").collect()]
    if len(slices) < 2:
        raise ValueError("walking forward needs two slices")
    streams.require_streams(pages, labelled=True)
    fixed = {}
    for m in models:
        if not hasattr(m, "fit"):
            later = pages.where(F.col("slice_id") > slices[0][0])
            fixed[m.name] = {r["slice_id"]: r for r in _report(labelled_pairs(m, later), "slice_id", of=later)}
    out = []
    for i in range(len(slices) - 1):
        train, test = pages.where(F.col("slice_id") <= slices[i][0]), pages.where(F.col("slice_id") == slices[i + 1][0])
        for m in models:
            r = fixed[m.name][slices[i + 1][0]] if m.name in fixed else _report(labelled_pairs(m.fit(train), test))[0]
            out.append(Row(model=m.name, train_slices=[s[1] for s in slices[: i + 1]], test_slice=slices[i + 1][1], n_streams=r["n_streams"], page_f1_mean=r["page_f1_mean"], pq_mean=r["pq_mean"], stp=r["stp"], mndd_mean=r["mndd_mean"]))
    return out


def format_results(rows: list[Row]) -> str:
    head = f"{'model':<28}{'test':<12}{'page F1':>9}{'PQ':>9}{'STP':>9}{'MNDD':>9}"
    lines = [f"{r.model:<28}{r.test_slice:<12}{r.page_f1_mean:>9.3f}{r.pq_mean:>9.3f}{r.stp:>9.3f}{r.mndd_mean:>9.3f}" for r in rows]
    return "\n".join([head, "-" * len(head), *lines])
