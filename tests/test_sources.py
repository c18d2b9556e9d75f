import pytest
from pyspark.sql import functions as F

from sheaf.sources import corpus, registry
from sheaf.streaming import arrivals


def test_registry(spark):
    made = registry.known()
    assert len(made.rows) == 11
    with pytest.raises(ValueError, match="already registered"):
        made.register("arxiv", ["en"], "image", "bulk_corpus")
    lines = {r.name: r.line for r in registry.listing(made.frame(spark)).collect()}
    assert "7,000,000" in lines["iit_cdip"] and " ? " in lines["arxiv"]


def test_rows_to_corpus(spark):
    rows = spark.createDataFrame([("a", [1, 0], ["p", "q"], ["x", "y"]), ("b", [1], ["p"], ["z"])], "stream_id string, boundaries array<int>, page_ids array<string>, texts array<string>")
    c = corpus.from_rows(rows, "ns", page_ids="page_ids", texts="texts")
    assert {(r.source, r.text) for r in c.text.collect()} == {("ns:p", "z"), ("ns:q", "y")}
    assert corpus.from_rows(rows, "ns", max_streams=1).pages.select("source").distinct().count() == 2
    with pytest.raises(ValueError):
        corpus.from_rows(rows.limit(0), "ns")
    with pytest.raises(Exception, match="differ in length"):
        corpus.from_rows(rows.withColumn("texts", F.array(F.lit("x"))), "ns", texts="texts").text.collect()


def test_build_save_load_and_filter(spark, tmp_path):
    at = tmp_path / "folders.txt"
    at.write_text("b 7\na 7\nbroken\n\nc 9\nd 10\n")
    defs = corpus.read_definitions(spark, str(at))
    pages = spark.createDataFrame([("a", 1, "a1", 0), ("a", 0, "old", 1), ("a", 0, "a0", 2), ("b", 0, "b0", 3), ("e", 0, "e0", 4), ("d", 0, "d0", 5)], "doc_id string, pg_id int, text string, row_ord int")
    c = corpus.build_corpus(defs, pages)
    got = [(r.stream_id, r.pos, r.text, r.boundary) for r in c.with_text().orderBy("stream_id", "pos").collect()]
    assert got == [(7, 0, "b0", True), (7, 1, "a0", True), (7, 2, "a1", False), (10, 0, "d0", True)]
    assert corpus.build_corpus(defs, pages, max_streams=2).pages.select("stream_id").distinct().count() == 1
    with pytest.raises(ValueError):
        corpus.build_corpus(defs, pages.limit(0))
    c.save(str(tmp_path / "c"))
    back = corpus.Corpus.load(spark, str(tmp_path / "c"))
    assert back.layout is None and sorted(back.pages.collect()) == sorted(c.pages.collect())
    assert back.with_layout().where("size(layout) <> 14").isEmpty()
    kept = back.filtered(2, 5)
    assert kept.pages.count() == 3 and kept.text.count() == 3
    more = corpus.Corpus(back.pages, back.text.withColumn("text", F.lit("new")).where("source = 'a'"))
    assert {r.text for r in back.merged(more).text.where("source in ('a', 'b')").collect()} == {"new", "b0"}
    with pytest.raises(Exception, match="no text"):
        corpus.resolve(back.pages, back.text.limit(0), "text").collect()


def test_files_and_concatenation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"one\ftwo")
    files = corpus.scan_files(spark, str(tmp_path))
    assert [r.source for r in files.collect()] == ["in/x"]
    pages = corpus.file_pages(files, lambda raw: raw.decode().split("\f"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(0, "one"), (1, "two")]
    sizes = spark.createDataFrame([(0, 0, "x", 2), (0, 1, "y", 1)], "stream_id long, doc_ord long, source string, n_pages long")
    assert [r.boundary for r in corpus.concat_sources(sizes).orderBy("pos").collect()] == [True, False, True]
    with pytest.raises(Exception, match="has no page"):
        corpus.concat_sources(sizes.withColumn("n_pages", F.lit(0).cast("long"))).collect()


def test_pdf_files(spark, tmp_path):
    from .test_functions import a_pdf

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "y.pdf").write_bytes(a_pdf(["one", "two", "three"]))
    (tmp_path / "b.pdf").write_bytes(a_pdf(["four"]))
    assert [r.source for r in corpus.list_files(spark, str(tmp_path)).collect()] == ["b", "in/y"]
    files = corpus.scan_files(spark, str(tmp_path))
    assert {(r.source, r.n_pages) for r in corpus.page_counts(files).collect()} == {("b", 1), ("in/y", 3)}
    pages = lambda *rows: spark.createDataFrame(list(rows), "source string, page long")
    got = corpus.file_text(pages(("in/y", 2), ("in/y", 0), ("b.pdf", 0), ("in/y", 2)), files).collect()
    assert sorted((r.source, r.page, r.text.split("\n")[0]) for r in got) == [("b.pdf", 0, "four"), ("in/y", 0, "one"), ("in/y", 2, "three"), ("in/y", 2, "three")]
    with pytest.raises(Exception, match="no file z"):
        corpus.file_text(pages(("z", 0)), files).collect()
    with pytest.raises(Exception, match="b has no page 1"):
        corpus.file_text(pages(("b", 1)), files).collect()


def test_ocr_and_images_become_features(spark):
    import json

    word = {"Word": "hi"} | {f"{a}{k}": 0.5 for a in "XY" for k in range(1, 5)}
    rows = spark.createDataFrame([("a", 0, json.dumps({"lines": [word]}), bytearray(b"P5 96 96 255\n" + bytes([255]) * 96 * 96)), ("a", 1, "", None)], "doc_id string, pg_id int, ocr string, img binary")
    c = corpus.build_corpus(spark.createDataFrame([(1, 0, "a")], "stream_id long, doc_ord long, doc_id string"), rows)
    assert c.has_layout and c.has_visual and [r.text for r in c.with_text().orderBy("pos").collect()] == ["hi", ""]
    assert [r.layout[7] for r in c.with_layout(strict=True).orderBy("pos").collect()] == [0.5, 0.0]
    assert [r.visual[1] for r in c.with_visual(strict=True).orderBy("pos").collect()] == [1.0, 0.0]
    bare = corpus.Corpus(c.pages, c.text)
    assert not bare.has_layout and bare.with_visual().where("size(visual) = 17").count() == 2
    with pytest.raises(ValueError, match="no layout"):
        bare.with_layout(strict=True)
    with pytest.raises(Exception, match="no visual for page"):
        corpus.Corpus(c.pages, c.text, None, c.visual.limit(0)).with_visual(strict=True).collect()


def test_strings_are_numbered_in_order(spark):
    from sheaf.operators import streams

    names = [f"set:/page {k * 37 % 1000}" for k in range(300)] + ["set:", "set:/é", "set:/ page", "set:/page 37 b"]
    rows = spark.createDataFrame([(n,) for n in names + names[:5]], "stream_id string")
    got = streams.ordinals(rows)
    assert [r.stream_id for r in got.orderBy("ord").collect()] == sorted(set(names), key=str.encode)
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(len(set(names)))) and got.where("n_all <> 304").isEmpty()
    assert streams.ordinals(rows.limit(0)).count() == 0 and streams.ordinals(rows.limit(1)).first().ord == 0


def test_arrivals(spark, tmp_path):
    rows = [(1, 0, "alpha beta gamma", 0), (1, 1, "alpha beta gamma!", 1), (1, 2, "something else", 2), (2, 0, "zz", 3)]
    df = spark.createDataFrame(rows, "stream_id long, pos long, text string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 10**9)).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = arrivals.arriving_boundaries(live).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.stream_id, r.pos): r.boundary for r in spark.table("arrived").collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): True, (2, 0): True}
