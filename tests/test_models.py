import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import boosting, decode, evaluate, models, sampling, streams


def viterbi(probs, sn, nn):
    """The decoder in plain Python."""
    ln = lambda x: np.log(max(x, 1e-9))
    d, back = [-np.inf, 0.0], []
    for p in probs[1:]:
        to = [[d[0] + ln(1 - sn), d[1] + ln(1 - nn)], [d[0] + ln(sn), d[1] + ln(nn)]]
        back.append([0 if t[0] >= t[1] else 1 for t in to])
        d = [max(to[0]) + ln(1 - p), max(to[1]) + ln(p)]
    path = [0 if d[0] > d[1] else 1]
    for b in reversed(back):
        path.append(b[path[-1]])
    path = path[::-1]
    path[0] = 1
    return [bool(x) for x in path]


def test_decoder_against_plain_python(spark):
    r = random.Random(4)
    cases = [[1.0] + [round(r.random(), 2) for _ in range(r.randint(0, 12))] for _ in range(60)] + [[1, 0.05, 0.55, 0.05, 0.05]]
    df = spark.createDataFrame([(s, k, float(p)) for s, c in enumerate(cases) for k, p in enumerate(c)], "stream_id long, pos long, prob double")
    for sn, nn in ((0.05, 0.05), (0.2, 0.05), (0.5, 0.5)):
        got = {}
        for x in decode.smooth(df, decode.Rates(sn, nn)).collect():
            got.setdefault(x.stream_id, {})[x.pos] = x.pred
        assert all([got[s][k] for k in range(len(c))] == viterbi(c, sn, nn) for s, c in enumerate(cases))


def test_calibration(spark, labels):
    pages = labels(["TFFTFFFTFF"]).withColumnRenamed("truth", "boundary")
    assert decode.calibrate(pages).boundary_rate == pytest.approx(2 / 9)
    empty = decode.calibrate(pages.withColumn("boundary", F.lit(None).cast("boolean")))
    assert empty == decode.Rates()


def test_ensemble(spark, labels):
    pages = labels(["TFF"]).withColumnRenamed("truth", "boundary")
    parts = [m.predict(pages) for m in (models.EveryPage(), models.NeverSplit())]
    probs = lambda w=None: [r.prob for r in decode.late_ensemble(parts, w).orderBy("pos").collect()]
    assert probs() == [1, 0.5, 0.5] and probs([3.0, 1.0]) == [1, 0.75, 0.75]
    for bad in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            decode.late_ensemble(parts, bad)
    with pytest.raises(ValueError):
        decode.late_ensemble([])


def test_sampling(spark):
    draws = spark.range(2000).select(sampling.poisson(5.0, 1, F.col("id"))).toPandas().iloc[:, 0]
    assert 4.5 < draws.mean() < 5.5 and 4 < draws.var() < 6
    with pytest.raises(ValueError):
        sampling.poisson(0, 1, F.col("id"))
    pages = spark.createDataFrame([(d // 3, 0, d, p, p == 0) for d in range(400) for p in range(d % 3 + 1)], "stream_id long, pos long, source long, page long, boundary boolean")
    a, b = (sampling.resample(pages.repartition(n), 30, 3.0, 7) for n in (1, 5))
    assert sorted(a.collect()) == sorted(b.collect())
    assert streams.check_streams(a).where("fault is not null").isEmpty()
    assert a.groupBy("stream_id", "source", "page").count().where("count > 1").isEmpty()
    both = sampling.fair_split(pages, 20, 10)
    assert both.where("train").select("source").intersect(both.where("not train").select("source")).isEmpty()
    folds = sampling.kfold(pages, 5).groupBy("fold").count().toPandas()["count"]
    assert folds.max() - folds.min() <= 1 and len(folds) == 5


def lowest_hashes(seed: int, stream: int, n: int, mean: float) -> list[int]:
    """A stream's documents in plain Python: Poisson many, those of lowest hash."""
    u = lambda *key: int(md5("|".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) / 2**32
    product, wanted = u("poisson", stream, 0), 0
    while product > np.exp(-mean):
        wanted += 1
        product *= u("poisson", stream, wanted)
    return sorted(range(n), key=lambda k: (u("doc", stream, k), k))[: max(1, min(wanted, n))]


@pytest.mark.parametrize("n", [40, 215, 1000, 9000])
def test_one_draw_rule_for_every_pool_size(spark, n):
    docs = spark.range(n).select((F.col("id") * 3).alias("source"))
    got = {}
    for r in sampling.stream_specs(docs, 20, 3.0, 5).orderBy("stream_id", "doc_ord").collect():
        got.setdefault(r.stream_id, []).append((r.doc_ord, r.source))
    assert got == {s: [(k, 3 * x) for k, x in enumerate(lowest_hashes(5, s, n, 3.0))] for s in range(20)}


@pytest.fixture(scope="module")
def learnable(spark):
    """Documents open with a title word."""
    r, rows = random.Random(0), []
    vocab = [f"word{k}" for k in range(30)]
    for s in range(40):
        for p in range(r.randint(3, 8)):
            first = p == 0 or r.random() < 0.35
            text = ("invoice number " if first else "continued page ") + " ".join(r.choices(vocab, k=8))
            rows.append((s, p, first, text))
    return spark.createDataFrame(rows, "stream_id long, pos long, boundary boolean, text string")


def test_trees_learn_and_survive_saving(spark, learnable, tmp_path):
    train, test = learnable.where("stream_id < 30"), learnable.where("stream_id >= 30")
    m = models.build_model("tfidf-xgb-rich", trees=5, vocab=200)
    with pytest.raises(RuntimeError):
        m.predict(test)
    got = evaluate.evaluate(m.fit(train), test).first()
    assert got.page_f1_mean > 0.6 and got.stp > 0
    m.save(str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    assert sorted(again.predict(test).collect()) == sorted(m.predict(test).collect())
    with pytest.raises(ValueError):
        m.fit(train.withColumn("boundary", F.lit(None).cast("boolean")))


def test_registered_trees_are_whole(spark, monkeypatch):
    from sheaf.plans import queries

    monkeypatch.setattr(queries, "_report", lambda spark, d, model, pages: (model, pages))
    made = {f: getattr(queries, f)(spark, "/root/testdata/sf0.001") for f in ("tfidf_gbt_eval", "page_gbt_eval", "rich_gbt_eval", "semantic_gbt_eval", "all_gbt_eval", "embedding_gbt_eval")}
    sizes = {f: (m.trees, m.depth, m.vocab_size) for f, (m, _) in made.items()}
    assert sizes == {"tfidf_gbt_eval": (100, 4, 20_000), "page_gbt_eval": (200, 5, 20_000), "rich_gbt_eval": (300, 6, 20_000), "semantic_gbt_eval": (300, 6, 20_000), "all_gbt_eval": (300, 6, 20_000), "embedding_gbt_eval": (150, 5, 10_000)}
    pages, sheets = made["tfidf_gbt_eval"][1], made["all_gbt_eval"][1]
    assert sheets.select(*pages.columns).exceptAll(pages).isEmpty() and sheets.count() == pages.count()
    assert sheets.where("exists(layout, v -> v > 0)").count() > 0.2 * pages.count()
    assert sheets.where("size(embedding) <> 64 or size(visual) <> 17").isEmpty()


def grown(x, y, trees, depth, rate):
    """Boosting in plain Python: every split of every value tried; NaN is missing."""
    margin, out = [0.0] * len(y), []

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def grow(rows, level, g, h):
        best = (1e-6, None)
        if level < depth:
            for f in range(len(x[0])):
                for cut in sorted({x[i][f] for i in rows if x[i][f] == x[i][f]}):
                    for missing in (False, True):
                        left = [i for i in rows if (x[i][f] <= cut if x[i][f] == x[i][f] else missing)]
                        right = [i for i in rows if i not in left]
                        if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 1:
                            best = max(best, (gain(left, g, h) + gain(right, g, h) - gain(rows, g, h), (left, right)), key=lambda b: b[0])
        if best[1] is None:
            leaf = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
            for i in rows:
                margin[i] += leaf
        else:
            for part in best[1]:
                grow(part, level + 1, g, h)

    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        grow(list(range(len(y))), 0, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p])
    return [1 / (1 + np.exp(-m)) for m in margin]


def test_boosting_against_plain_python():
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(60, 4)), 1)
    x[r.random(x.shape) < 0.3] = np.nan
    x[x == 0] = np.nan
    x[:, 3] = np.where(np.arange(60) < 6, 1.0, np.nan)
    y = ((np.nan_to_num(x[:, 0]) > 0) ^ (r.random(60) < 0.1)).astype(float)
    row, col = np.nonzero(~np.isnan(x))
    rows = boosting.Rows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=60))]), col, x[row, col])
    made = boosting.Trees(6, 3, 0.3).fit(rows, y)
    assert np.allclose(made.predict(rows), grown(x.tolist(), y.tolist(), 6, 3, 0.3))
    none = boosting.Rows(np.zeros(3, int), np.zeros(0, int), np.zeros(0))
    assert np.allclose(boosting.Trees(2, 3, 0.3).fit(none, np.array([0.0, 1.0])).predict(none), 0.5)


def test_tasks_learn_what_one_process_learns(spark):
    r = np.random.default_rng(1)
    rows = [(int(s), p, sorted(r.choice(50, 12, replace=False).tolist()), r.random(12).round(2).tolist(), r.random(3).round(3).tolist()) for s in range(70) for p in range(1, 5)]
    rows = [(*x, float((x[2][0] < 2) ^ (x[4][1] > 0.6))) for x in rows]
    frame = spark.createDataFrame(rows, "stream_id long, pos long, idx array<int>, val array<double>, dense array<double>, label double")
    want = boosting.Trees(4, 3, 0.3)
    whole = frame.repartition(1, "stream_id").sortWithinPartitions("stream_id", "pos").toArrow()
    want.fit(boosting.rows_of(whole, 50), whole.column("label").to_numpy())
    for tasks in (1, 3):
        got = boosting.learned(frame, boosting.Trees(4, 3, 0.3), 50, len(rows), tasks)
        assert (got.feature == want.feature).all() and np.allclose(got.cut, want.cut) and np.allclose(got.leaf, want.leaf)
        assert (got.missing_left == want.missing_left).all()
    assert (want.feature >= 0).any()


def test_trees_learn_from_every_page(spark):
    """A tree without a split tells how many pages it learned from, here with over 8 million values."""
    pages = spark.range(600).selectExpr("id div 6 as stream_id", "id % 6 as pos", "id % 3 = 0 as boundary", "transform(sequence(1, 4000), x -> 1.0D + (x + id) % 7) as embedding")
    m = models.PairTrees("one", ("embedding",), trees=1, depth=0, rate=1.0, use_text=False).fit(pages)
    n, hits = 500, 100
    assert m.model.leaf[0, 0] == pytest.approx(-(0.5 * n - hits) / (0.25 * n + 1))


def test_walk_forward(learnable):
    sliced = streams.slice_streams(learnable, 3).withColumn("slice_name", F.concat(F.lit("q"), "slice_id"))
    rows = evaluate.walk_forward([models.EveryPage(), models.Smoothed(models.TextSimilarity())], sliced)
    assert [r.train_slices for r in rows] == [["q0"], ["q0"], ["q0", "q1"], ["q0", "q1"]]
    assert "every_page" in evaluate.format_results(rows)
    with pytest.raises(ValueError):
        evaluate.walk_forward([models.EveryPage()], sliced.where("slice_id = 0"))


def test_every_name_builds():
    for name in models.MODELS:
        assert isinstance(models.build_model(name), models.Model)
    with pytest.raises(ValueError):
        models.build_model("nothing")
