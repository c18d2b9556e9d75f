import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import _components, ngramjoin, substrdedup, suffixdedup
from sheaf.llm._induced import suffix_order
from sheaf.llm._text import Texts

from .brute import WORD, left, repeats, sha, similar


@pytest.mark.parametrize("most, block", [(4096, 1_500_000), (2, 64)])
def test_jaccard_join(corpus, texts, most, block):
    """The second case sends shared n-grams the salted way and cuts the clusters in blocks."""
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngramjoin.similar_documents(corpus, most=most, block=block).collect()}
    assert got == similar(texts)


def test_keep_one(corpus, texts):
    left = ngramjoin.keep_one(corpus)
    assert left.columns == corpus.columns
    want = {i for i, (_, _, c) in similar(texts).items() if c == i}
    assert {r.doc_id for r in left.collect()} == want | {None}


def test_components_both_ways(spark):
    r = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)], "a long, b long")
    one, two = (sorted(map(tuple, _components.components(edges, n).collect())) for n in (10**6, 0))
    assert one == two and (1040, 1000) in one


def covered(flags):
    return int(sum(flags)), int(sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags)))


@pytest.mark.parametrize("most, keep_first", [(8192, False), (8192, True), (1, True)])
def test_suffix_dedup(corpus, texts, most, keep_first):
    """most = 1 counts every string by its hash."""
    want = {i: (len(texts[i].encode()), *covered(gone), sha(left(texts[i], gone))) for i, gone in repeats(texts, keep_first=keep_first).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(corpus, most=most, keep_first=keep_first, shard_bytes=4000).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1500


def test_suffix_dedup_memory():
    """The arrays of a chunk's segments and of a shard's sort stay under so many bytes for each byte of text, all of it distinct."""
    data = np.random.default_rng(4).integers(97, 117, 1 << 20).astype(np.uint8)
    raw = [data[i : i + 300].tobytes() for i in range(0, len(data) - 299, 300)]
    shard = pa.table({"doc_id": np.arange(len(raw)), "at": np.zeros(len(raw), np.int64), "raw": pa.array(raw, pa.binary())})

    def peak(f, *args):
        tracemalloc.start()
        try:
            f(*args)
            return tracemalloc.get_traced_memory()[1] / len(data)
        finally:
            tracemalloc.stop()

    assert peak(suffixdedup.segments, Texts(data, np.arange(0, len(data) + 1, 4096)), 200) < 50
    for keep_first in (False, True):
        assert peak(suffixdedup._sort_shard(200, keep_first), (), shard) < 40


def test_cleaned_keeps_columns(corpus):
    left = suffixdedup.cleaned(corpus)
    assert left.columns == corpus.columns and left.where("doc_id is null").count() == 1
    assert left.where("n_chars <> length(coalesce(text, ''))").isEmpty()


def test_substring_dedup(corpus, texts):
    words, first = {i: WORD.findall(t) for i, t in texts.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrdedup.remove_repeats(corpus).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 300


def test_empty_tables(corpus):
    none = corpus.limit(0)
    assert ngramjoin.similar_documents(none).count() == suffixdedup.remove_repeats(none).count() == substrdedup.remove_repeats(none).count() == 0


def test_suffix_order():
    r = np.random.default_rng(0)
    for _ in range(100):
        t = np.append(r.integers(1, r.integers(2, 6), r.integers(1, 60)), 0).astype(np.uint16)
        assert suffix_order(t, 300).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    runs = np.append(np.repeat([3, 1, 3, 2, 3], [20_000, 5, 20_000, 3, 9]), 0).astype(np.uint16)
    order = suffix_order(runs, 10**6)
    text = bytes(runs.astype(np.uint8))
    assert sorted(order.tolist()) == list(range(len(text))) and all(text[i:] < text[j:] for i, j in zip(order[:-1], order[1:]))
