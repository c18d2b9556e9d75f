import random
import re
import zlib

import corpus_pipeline
import pytest
from sheaf.llm import bytecnn, langid, packing, queries
from sheaf.llm._store import written

from .brute import left, mixture, quality, repeats, similar
from .conftest import prose

VOCAB = {"aa": "der die und nicht haus wasser straße grün baum vogel".split(), "bb": "el la que casa niño río agua señor mesa libro".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, score double"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two languages, junk, near and exact copies, shared passages, texts without letters, nulls, repeated rows and ids, clashing columns."""
    r, rows = random.Random(3), []
    say = lambda lang, k: " ".join(r.choices(VOCAB[lang], k=k))
    passage = prose(r, 60)
    for i in range(90):
        lang = ["aa", "bb"][i % 2]
        text = say(lang, r.randint(20, 70))
        if i % 9 == 4:
            text = " ".join(f"{w}###" for w in text.split())
        elif i % 10 == 7:
            text = text + " " + passage + " " + say(lang, 30)
        rows.append([i, text, lang])
    for i in range(90, 100):
        words = rows[i - 90][1].split()
        words[r.randrange(len(words))] = "ander"
        rows.append([i, " ".join(words), "aa"])
    rows += [[100, rows[1][1], "bb"], [101, None, None], [102, "", "aa"], [103, "123 456", None], [104, say("aa", 900), "aa"], [105, " \n", None]]
    rows += [[3, rows[3][1], "bb"], [None, say("bb", 30), "bb"], [None, passage, "aa"]]
    full = [(i, t, lang, "s", len(t or ""), 7, "h", 0.5) for i, t, lang in rows]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 != 4)) for i in range(80)] + [(5, 1), (None, 0), (500, 0)], "doc_id long, quality int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}


def test_every_stage_against_brute_force(spark, table):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "substrings", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = queries.read(spark, table, "documents")
    labels = queries.read(spark, table, "labels").where(~langid.held_out(folds=5, fold=0))

    kept = written(stage["language"](spark, docs, table), "kept")
    model = langid.fit_languages(docs.where(~langid.held_out(folds=3, fold=1)))
    want = {i for i, t in texts_of(docs).items() if re.search(r"[^\W\d_]", t) and max(mixture(model, t)) >= 0.5}
    assert set(texts_of(kept)) == want and kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert {101, 102, 103, 105}.isdisjoint(want) and kept.where("doc_id = 3").count() == 2

    docs, kept = kept, written(stage["quality"](spark, kept, table), "kept")
    net = bytecnn.fit_quality(docs, labels)
    assert net.fixed is None
    want = {i for i, t in texts_of(docs).items() if quality(net, t) >= 0.3}
    assert set(texts_of(kept)) == want and kept.columns == docs.columns
    assert not any(i % 9 == 4 for i in want if i < 90) and len(want) > 70

    docs, kept = kept, written(stage["near_duplicates"](spark, kept, table), "kept")
    texts = texts_of(docs)
    assert set(texts_of(kept)) == {i for i, (_, _, c) in similar(texts).items() if c == i} != set(texts)
    assert kept.where("doc_id is null").count() == docs.where("doc_id is null").count() and kept.columns == docs.columns

    docs, kept = kept, written(stage["substrings"](spark, kept, table), "kept")
    texts = texts_of(docs)
    want = {i: left(texts[i], gone).decode("utf-8", "ignore") for i, gone in repeats(texts, keep_first=True).items()}
    assert texts_of(kept) == {i: t for i, t in want.items() if t} and kept.columns == docs.columns
    assert kept.where("n_chars <> length(text)").isEmpty() and any(want[i] != texts[i] for i in texts)

    tokens = packing._tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in stage["packing"](spark, kept, table).where("doc_id is not null").collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.length))
    for i, t in texts_of(kept).items():
        n = len(tokens.encode(t, add_special_tokens=False).ids) + 1
        rows = kept.where(f"doc_id = {i}").count() if i == 3 else 1
        assert sorted(pieces[i]) == sorted([(k, (n - 1) % 2048 + 1 if k == 0 else 2048) for k in range(-(-n // 2048))] * rows)
    assert set(pieces) == set(texts_of(kept))

    run = corpus_pipeline.run(spark, table).where("doc_id is not null")
    got = {}
    for r in run.collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.length))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in pieces.items()}


def test_stages_on_an_empty_table(spark, table, tmp_path):
    for name in ("documents", "labels"):
        queries.read(spark, table, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    with pytest.warns(UserWarning, match="no language"):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def rows_of(df):
    return {r.doc_id: r for r in df.where("doc_id is not null").collect()}


def test_held_out_rows_teach_nothing(spark, table, tmp_path):
    """The queries' folds: what held-out rows say of language and quality changes no result."""
    from pyspark.sql import functions as F

    docs, labels = (queries.read(spark, table, t) for t in ("documents", "labels"))
    docs.withColumn("lang", F.when(langid.held_out(folds=3, fold=1), "zz").otherwise(F.col("lang"))).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("quality", F.when(langid.held_out(folds=5, fold=0), 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / "labels.parquet"))
    for query, folds, fold in ((queries.op1_language_mixture, 3, 1), (queries.op3_byte_cnn, 5, 0)):
        a, b = rows_of(query(spark, table)), rows_of(query(spark, str(tmp_path)))
        assert a.keys() == b.keys() == set(texts_of(docs))
        assert all(a[i] == b[i] and a[i].held_out == (zlib.crc32(str(i).encode()) % folds == fold) for i in a)


def test_queries_give_every_row(spark, table, tmp_path):
    """Nulls, repeated rows and clashing columns lose no row; equal texts have equal values; empty tables give empty results."""
    docs, n = queries.read(spark, table, "documents"), 109
    assert docs.count() == n
    for name in ("documents", "labels"):
        queries.read(spark, table, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (queries.op1_language_mixture, queries.op2_transport_stream, queries.op3_byte_cnn, queries.op7_piece_codec, queries.op8_rule_forest, queries.op10_token_counts):
        found = query(spark, table)
        assert found.count() == n and query(spark, str(tmp_path)).count() == 0
        got = rows_of(found)
        drop = {"doc_id", "held_out"}
        one, two = ({k: v for k, v in got[i].asDict().items() if k not in drop} for i in (1, 100))
        assert one == two and {k: v for k, v in got[101].asDict().items() if k not in drop} == {k: v for k, v in got[102].asDict().items() if k not in drop}
