import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import bytecnn, langid, mpegts, packing, piececodec, rules, tokencount
from sheaf.llm.queries import tokenizer_path

from .brute import WORD, mixture, quality

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def test_codec_and_counts(corpus, texts):
    lib = piececodec.library(PIECES)
    counts = {r.doc_id: r for r in tokencount.count_tokens(corpus, PIECES, limit=1000).collect()}
    for r in piececodec.encode_decode(corpus, PIECES).where("doc_id is not null").collect():
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        c = counts[r.doc_id]
        assert (c.n_tokens, c.n_bytes, c.over_limit) == (len(ids) - 2, len(texts[r.doc_id].encode()), len(ids) - 2 > 1000)
    assert tokencount.count_tokens(corpus.limit(0), PIECES).count() == 0


def test_codec_on_random_texts():
    r, lib = random.Random(1), piececodec.library(PIECES)
    made = ["".join(r.choices("  \t\nabcdeethin▁é漢字0123<s>\U0001F600́.,", k=r.randint(0, 90))) for _ in range(200)]
    made += ["".join(r.choices(a, k=k)) for a in ("a", "ab", "=-", "tehin", "_ ", "0123456789abcdef", "é漢") for k in (1, 2, 3, 33, 130, 700, 4000)]
    ids, at = piececodec.encode_batch(PIECES, pa.array(made))
    want = [lib.encode(t, add_bos=True, add_eos=True) for t in made]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    model = piececodec.pieces(PIECES)
    words, place, first = tokencount.distinct_words(pa.array(made))
    count = tokencount.surviving(model, *tokencount.characters(words))
    total = np.concatenate([[0], np.cumsum(count[place])])[first]
    assert np.diff(total).tolist() == [len(w) - 2 for w in want]


def test_codec_stops_at_a_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert piececodec.encode_decode(docs, PIECES).count() == 1 and piececodec.encode_decode(docs.limit(0), PIECES).count() == 0

    class Other:
        def encode(self, texts, **_):
            return [[1, 2] for _ in texts]

    monkeypatch.setattr(piececodec, "library", lambda path: Other())
    column = pa.array(["some words here"])
    run = piececodec.encode_decode
    seen = []
    docs_like = type("D", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, f, schema: seen.append(f)})()
    run(docs_like, PIECES)
    with pytest.raises(ValueError, match="differently"):
        list(seen[0](iter([pa.RecordBatch.from_arrays([pa.array([1]), column], names=["doc_id", "text"])])))


def test_token_ids_are_the_librarys(texts):
    t = packing._tokenizer(BYTES)
    some = [*texts.values(), "a" * 900 + " " * 900 + "b\n\n\n", "x<|endoftext|>y"]
    for text, ids in zip(some, packing.token_ids(BYTES, pa.array(some))):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(corpus, texts):
    rows = packing.pack_documents(corpus.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTES, size=256).collect()
    t, bins = packing._tokenizer(BYTES), {}
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 256 for r in own[1:]) and (len(own) == 1 or own[0].length <= 256)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 256) + 1


def test_exchange_and_bounds(spark):
    r = np.random.default_rng(3)
    n = r.integers(40, 100, 3000)
    pieces = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(n)], packing.PIECE_SQL)
    packed = packing.pack(packing.written(pieces, "p"), 100, per_partition=20_000)
    assert packed.count() == 3000 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 100").isEmpty()
    found = packed.select("sequence_id").distinct().count()
    alone = int(packing.best_fit_decreasing(np.sort(n)[::-1], 100).max()) + 1
    assert packing.lower_bound(n, 100) <= alone <= found <= 1.02 * alone
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.pack(packing.written(pieces.limit(0), "p"), 100).count() == 0


def test_transport_streams(corpus, texts):
    for n in (0, 1, 63, 64, 100, 150, 162, 176, 183, 5000, 16383, 16385, 70000):
        p = mpegts.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        media = mpegts.mux(p)
        back, found = mpegts.demux(media)
        assert np.array_equal(back, p) and found["cc_errors"] == 0 and len(media) % 188 == 0
    assert [x[2] for x in found["index"]] == [True, False, False, False, True]
    with pytest.raises(ValueError):
        mpegts.demux(media[1:-187])
    for r in mpegts.read_media(mpegts.with_media(corpus)).where("doc_id is not null").collect():
        raw = texts[r.doc_id].encode()
        p = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_lost_and_repeated_packets(spark):
    p = mpegts.padded(np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8))
    media = mpegts.mux(p)
    packets = media.reshape(-1, 188)
    units = [p[k : k + mpegts.UNIT] for k in range(0, len(p), mpegts.UNIT)]
    es = np.flatnonzero((packets[:, 1] & 0x1F == 1) & (packets[:, 2] == 0))
    starts = [k for k in es if packets[k, 1] & 0x40]
    for gone in (es[0], es[40], starts[1], starts[2] - 1, es[-1]):
        samples, found = mpegts.demux(np.delete(packets, gone, axis=0).reshape(-1))
        # whichever unit lost a packet is left out, the others are as they were
        left = [k for k in range(len(units)) if not (starts[k] <= gone and (k + 1 == len(units) or gone < starts[k + 1]))]
        if gone in starts:  # without its start its rest lengthens the unit before
            left = [k for k in left if k + 1 != starts.index(gone)]
        assert np.array_equal(samples, np.concatenate([units[k] for k in left])) and found["lost"] >= 1
    for twice in (0, 1, es[0], es[40], starts[1]):
        samples, found = mpegts.demux(np.insert(packets, twice, packets[twice], axis=0).reshape(-1))
        assert np.array_equal(samples, p) and not (found["cc_errors"] or found["lost"] or found["time_gaps"])
    whole = np.delete(packets, np.arange(starts[1], starts[2]), axis=0)  # a unit of 90 packets; then 16 more, which no counter shows
    assert mpegts.demux(whole.reshape(-1))[1]["time_gaps"] == 1
    table = spark.createDataFrame([(1, 70_000, bytearray(np.delete(packets, es[40], axis=0).tobytes())), (2, 70_000, bytearray(media.tobytes()))], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="packets are missing"):
        mpegts.read_media(table).collect()
    got = {r.doc_id: r for r in mpegts.read_media(table, strict=False).collect()}
    assert (got[1].lost, got[1].cc_errors, got[2].lost) == (1, 1, 0) and got[2].payload_sha256 == hashlib.sha256(p).hexdigest()
    assert [x.whole for x in got[1]["index"]] == [False, True, True, True, True]


def test_tables_of_many_packets():
    """Sections longer than a packet, and a network entry before the program's."""
    import struct

    def packed(pid, section):
        raw, out = b"\0" + section, []
        for k in range(0, len(raw), 184):
            out.append((struct.pack(">BHB", 0x47, 0x4000 * (k == 0) | pid, 0x10 | k // 184 & 15) + raw[k : k + 184]).ljust(188, b"\xff"))
        return np.frombuffer(b"".join(out), np.uint8)

    p = mpegts.padded((np.arange(1000) % 251).astype(np.uint8))
    media = mpegts.mux(p).reshape(-1, 188)
    pat = mpegts._section(0, 1, struct.pack(">HH", 0, 0xE000 | 0x10) + b"".join(struct.pack(">HH", k, 0xE000 | mpegts.PMT_PID) for k in range(1, 80)))
    info = bytes([0x05, 250]) + b"x" * 250
    pmt = mpegts._section(2, 1, struct.pack(">HH", 0xE000 | mpegts.ES_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", 0x06, 0xE000 | mpegts.ES_PID, 0xF000))
    long = np.concatenate([packed(0, pat), packed(mpegts.PMT_PID, pmt), media[2:].reshape(-1)])
    samples, found = mpegts.demux(long)
    assert np.array_equal(samples, p) and found["cc_errors"] == 0 and found["stream_type"] == 6


def test_rule_counts(corpus, texts):
    got = {r.doc_id: r for r in rules.apply_rules(corpus, None, 1.0).collect()}
    for i, t in texts.items():
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = set()
        for k, x in enumerate(windows):
            if windows.count(x) > 1:
                again.update(range(k, k + 8))
        r = got[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:80]
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and r.kept != r.base_failed


def junk(r):
    return " ".join(f"w{r.randint(0, 99)}{r.choice(['###', '$$$', '%%%'])}" for _ in range(60))


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choices(["the", "house", "stands", "near", "water", "and", "trees", "grow", "slowly", "there", "for", "years"], k=80))
    rows = [(i, junk(r) if i % 6 == 0 else good(), int(i % 6 != 0)) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_forest_and_network_learn(corpus, judged):
    train, test = judged.where("doc_id < 160"), judged.where("doc_id >= 160")
    forest = rules.fit_rules(judged.select("doc_id", "text"), train)
    kept = rules.apply_rules(test, *forest).join(test.select("doc_id", "quality"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in kept]) > 0.95
    model = bytecnn.fit_quality(judged, train)
    found = bytecnn.score_quality(test, model).join(test.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    assert bytecnn.keep_good(test, model).columns == test.columns
    hard = bytecnn.score_quality(corpus, model).collect()
    assert len(hard) == corpus.count() and all(0 <= r.score <= 1 for r in hard)
    none = bytecnn.fit_quality(judged, judged.limit(0))
    assert bytecnn.score_quality(corpus.limit(3), none).select("score").distinct().first()[0] == 0.5
    assert rules.fit_rules(judged, judged.limit(0))[0] is None


def test_large_labelled_documents_are_passed_over(spark):
    order = [r.id for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    label = {i: k % 2 for k, i in enumerate(order)}
    text = lambda i: ("fine words here " if label[i] else "zz## zz## ") * 4
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    for large in (order[:1], order[:2], [i for i in order if not label[i]]):
        rows = [(i, text(i) * (100 if i in large else 1)) for i in order]
        model = bytecnn.fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_bytes=8000)
        assert model.fixed is None
    with pytest.warns(UserWarning, match="labels 0"):
        one = bytecnn.fit_quality(spark.createDataFrame([(i, text(i)) for i in order if label[i]], "doc_id long, text string"), labels)
    assert one.fixed == 1


def test_scores_against_brute_force(corpus, texts, judged):
    """The network's and the forest's scores, one text at a time; neighbours change nothing."""
    model = bytecnn.fit_quality(judged, judged.where("doc_id < 160"))
    got = {r.doc_id: r.score for r in bytecnn.score_quality(corpus, model).where("doc_id is not null").collect()}
    some = sorted(texts, key=lambda i: (len(texts[i]) > 1500, i))[:40]
    assert all(abs(got[i] - quality(model, texts[i])) < 1e-9 for i in some)
    alone = [float(model.score(bytecnn.texts_of(pa.array([texts[i]])))[0]) for i in some]
    assert [got[i] for i in some] == alone

    forest, threshold = rules.fit_rules(judged.select("doc_id", "text"), judged)
    kept = {r.doc_id: r for r in rules.apply_rules(corpus, forest, threshold).where("doc_id is not null").collect()}
    for i in some:
        _, x = rules.statistics(bytecnn.texts_of(pa.array([texts[i]])))
        x, depth = x[0][forest.columns], []
        for axis, cut, path in zip(forest.axis, forest.cut, forest.path):
            slot = 1
            while axis[slot] >= 0:
                slot = 2 * slot + int(x[axis[slot]] >= cut[slot])
            depth.append(path[slot])
        anomaly = 2 ** (-sum(depth) / len(depth) / forest.norm)
        assert abs(kept[i].anomaly - anomaly) < 1e-9 and kept[i].kept == (not kept[i].base_failed and kept[i].anomaly <= threshold)


def test_forest_learns_from_all_rows(spark, monkeypatch):
    """Leaves count all documents and thresholds all labels, of which there are over 4,000; trees split rows drawn from all."""
    monkeypatch.setattr(rules, "FORESTS", [((1, 2, 3), 64), ((0, 2, 5), 16), ((2, 3), 64)])
    monkeypatch.setattr(rules, "ROWS", 15)
    r, rows = random.Random(4), []
    for i in range(6000):
        share = r.random() ** 2
        words = [r.choice(["#", "w%", "$$"]) if r.random() < share else r.choice(["the", "house", "stands", "near", "water"]) for _ in range(r.choice([5, 22, 25, 30]))]
        rows.append((i, " ".join(words), int(r.random() > share) if i % 10 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    counts, x = rules.statistics(bytecnn.texts_of(pa.array([t for _, t, _ in rows])))
    learned = [i for i in range(len(rows)) if not rules.base_failed(counts)[i]]
    assert sum(rows[i][2] == 1 for i in learned) > 2000
    cut = 2**31 * 1500 // len(learned)
    drawn = {q.id for q in spark.range(len(rows)).where(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(2**31)) < cut).collect()}
    best = None
    for columns, size in rules.FORESTS:
        forest = rules.Forest(x[[i for i in learned if i in drawn]], columns, rows=size)
        lengths = [0.0, 0.0, 1.0] + [2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n for n in range(3, size + 1)]
        total, paths = np.zeros(len(learned)), []
        for axis, split in zip(forest.axis, forest.cut):
            leaf = []
            for v in x[learned][:, list(columns)]:
                slot = 1
                while axis[slot] >= 0:
                    slot = 2 * slot + int(v[axis[slot]] >= split[slot])
                leaf.append(slot)
            n = np.bincount(leaf) * size / len(learned)
            paths.append({s: len(bin(s)) - 3 + np.interp(n[s], range(size + 1), lengths) for s in set(leaf)})
            total += [paths[-1][s] for s in leaf]
        score = dict(zip(learned, 2.0 ** (-total / len(paths) / lengths[size])))
        good, bad = (np.array([score[i] for i in learned if rows[i][2] == k]) for k in (1, 0))
        for c in sorted(c for c in {*good, *bad} if c >= np.quantile(good, 1 - rules.MOST_LOST, method="higher")):
            gain = (bad > c).mean() - (good > c).mean()
            if best is None or gain > best[0] + 1e-12:
                best = gain, columns, c, paths
    forest, threshold = rules.fit_rules(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert tuple(forest.columns) == best[1] and abs(threshold - best[2]) < 1e-9
    assert all(abs(path[s] - p) < 1e-9 for path, tree in zip(forest.path, best[3]) for s, p in tree.items())
    assert rules.fit_rules(docs.select("doc_id", "text"), docs.where("quality = 1"))[0] is None


def test_merges_that_differ_are_told():
    """The fast encoder is used only where joining by tokens is following the merges."""
    one = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4}
    assert packing._same_merges(one, [(b"a", b"b"), (b"ab", b"c")])
    assert not packing._same_merges(one | {b"bc": 5}, [(b"a", b"b"), (b"ab", b"c")])
    assert not packing._same_merges({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5}, [(b"b", b"c"), (b"a", b"b"), (b"ab", b"c")])
    assert packing._ranked(BYTES) is not None


def test_languages(spark, corpus):
    r = random.Random(2)
    vocab = {"aa": "der die und nicht haus wasser straße grün".split(), "bb": "el la que casa niño río agua señor".split(), "cc": "the and that house water stream light".split()}
    say = lambda lang, n: " ".join(r.choices(vocab[lang], k=n))
    rows = [(i, say(lang, r.randint(20, 60)), lang) for i in range(120) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id < 60"))
    got = langid.identify_languages(docs.where("doc_id >= 60"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(x.lang_pred == x.lang and x.score > 0.9 for x in got)
    mixed = spark.createDataFrame([(1, say("aa", 60) + " " + say("bb", 30)), (2, "12 -- 3"), (3, None), (4, "")], "doc_id long, text string")
    out = {x.doc_id: x for x in langid.identify_languages(mixed, model).collect()}
    assert [m.lang for m in out[1].mixture] == ["aa", "bb"] and abs(out[1].score - 2 / 3) < 0.1
    several = {1: mixed.first().text, 5: say("cc", 40) + " " + say("aa", 40) + " " + say("bb", 40), 6: say("cc", 3), 7: "xyz"}
    for x in langid.identify_languages(spark.createDataFrame(list(several.items()), "doc_id long, text string"), model).collect():
        want = mixture(model, several[x.doc_id])
        assert {m.lang: pytest.approx(m.share, abs=1e-4) for m in x.mixture} == {name: v for name, v in zip(model.names, want) if v > 0}
    assert all((out[k].lang_pred, out[k].score) == ("und", 0.0) for k in (2, 3, 4))
    assert langid.identify_languages(corpus, model).count() == corpus.count()
    assert langid.keep_identified(mixed, model).count() == 1
    with pytest.warns(UserWarning, match="no language"):
        assert langid.keep_identified(mixed, langid.fit_languages(docs.limit(0))).count() == 1
    none = langid.fit_languages(docs.limit(0))
    assert {x.lang_pred for x in langid.identify_languages(docs, none).collect()} == {"und"}
