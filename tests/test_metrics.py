import pytest
from pyspark.sql import functions as F

from sheaf.operators import metrics, streams

SMOKE = ["TFFTF", "TFTFFF", "TFFFFF", "T", "TTT"]


def row(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    "truth, every, never",
    [
        (SMOKE, (0.346667, 0.4, 0.4, 2.4), (0.0, 0.568889, 0.4, 1.2)),
        (["T", "TT", "TFFFTF"], (0.444444, 0.666667, 0.666667, 1.333333), (0.0, 0.481481, 0.333333, 1.0)),
        (["TFTFF", "TFF"], (0.2, 0.0, 0.0, 2.5), (0.0, 0.7, 0.5, 1.0)),
        (["TFFTFFFF", "TFFTT", "TFF", "TFFF", "TFFFFF"], (0.183333, 0.1, 0.0, 3.6), (0.0, 0.743333, 0.6, 1.0)),
    ],
)
def test_reports_of_trivial_models(labels, truth, every, never):
    for fill, want in ((lambda s: "T" * len(s), every), (lambda s: "T" + "F" * (len(s) - 1), never)):
        got = row(metrics.report(labels(truth, [fill(s) for s in truth])))
        assert [round(got[k], 6) for k in ("page_f1_mean", "pq_mean", "stp", "mndd_mean")] == list(want)


def test_one_stream_values(labels):
    s = row(metrics.page_scores(labels(["TFFTFT"], ["TFTFFT"])))
    assert (s["precision"], s["recall"], s["f1"]) == (0.5, 0.5, 0.5)
    p = row(metrics.panoptic(labels(["TFFFF"], ["TFFFT"])))
    assert p["rq"] == pytest.approx(2 / 3) and p["sq"] == pytest.approx(0.8)
    assert row(metrics.panoptic(labels(["TF"], ["TT"])))["pq"] == 0  # half of the union is no match
    assert row(metrics.drags(labels(["TFFTF"], ["TFTFF"])))["drags"] == 1
    assert row(metrics.drags(labels(["TFFF"], ["TTTT"])))["drags"] == 3


def test_bad_labels_are_refused(spark, labels):
    good = labels(["TF"]).select("stream_id", "pos", F.col("truth").alias("boundary"))
    with pytest.raises(ValueError):
        metrics.paired(good, good.where("pos = 0"))
    with pytest.raises(ValueError):
        metrics.paired(good, good.withColumn("boundary", F.lit(False)))
    with pytest.raises(ValueError):
        metrics.paired(good.limit(0), good.limit(0))


def test_spans_and_validation(labels):
    pages = labels(["TFFTF", "TTT", "T"]).withColumnRenamed("truth", "boundary")
    got = {tuple(r) for r in streams.spans(pages).collect()}
    assert {(0, 0, 0, 3), (0, 1, 3, 5), (1, 2, 2, 3), (2, 0, 0, 1)} <= got and len(got) == 6
    assert streams.check_streams(pages).where("fault is not null").isEmpty()
    bad = pages.withColumn("boundary", F.when(F.col("stream_id") == 1, F.col("pos") > 0).when((F.col("stream_id") == 2), None).otherwise(F.when(F.col("pos") != 1, F.col("boundary"))))
    faults = {r.stream_id: r.fault for r in streams.check_streams(bad).collect()}
    assert "first page" in faults[1] and "no boundary" in faults[0] and faults[2] is None
    with pytest.raises(ValueError):
        streams.require_streams(bad)
    with pytest.raises(ValueError):
        streams.require_streams(bad.where("stream_id = 2"), labelled=True)
    assert "gaps" in streams.check_streams(pages.where("pos <> 1")).where("stream_id = 0").first().fault
