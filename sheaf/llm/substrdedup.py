"""Substring dedup of word sequences with fixed-block anchors.

Half windows anchor the search: each document's non-overlapping blocks of k words are indexed, and
every rolling window of k words probes the index. A repeat of 2k words holds one whole block of
the document it repeats, wherever it starts, so each repeat has an anchor. From an anchor's hits
every window of 2k words that holds it is taken, in both documents, and compared as a whole: this
extends the hits to the maximal runs of windows that repeat. The least document of each window
keeps it.

Documents with the same words are one class, whose least document stands for it: the others lose
all their words, if a window fits. No step pairs the members of a group; the least document of a
window comes from an aggregate with partial sums, and hot keys are split by the skew join.

Defined results: null, empty and white space texts have no words and lose none; documents shorter
than a window lose none; a document's own repeats don't count; rows without a doc_id are left out;
rows of one doc_id are one document, the one with most words; the input's other columns are
ignored. Anchors are compared as 64-bit hashes, windows and documents as 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._filters import bitmap, bits_for, by_key, maybe, rows_of, sparse
from ._store import discard, scratch, written
from ._text import ODD, U64, Texts, Words, chunks, covered, mix, texts_of, window_hashes

SECOND = 0xC2B2AE3D27D4EB4F | 1


def _signatures(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, place = [], np.arange(len(h)) - np.repeat(words.first[:-1], words.count)
    for salt in (0x1234567, 0x7654321):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(h + mix(place.astype(np.uint64) * U64(2) + U64(salt))))])
        out.append(mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _joined(texts: Texts, words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's words (those of keep), joined by one space."""
    start, end, count = words.start, words.end, words.count
    if keep is not None:
        start, end = start[keep], end[keep]
        count = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
    size = end - start + 1
    ends = np.cumsum(size)
    flat = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    flat[inner] = texts.data[(np.arange(len(flat)) + np.repeat(start - (ends - size), size))[inner]]
    to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
    return [flat[a : max(a, b - 1)].tobytes() for a, b in zip(to[:-1], to[1:])]


def _profile(k: int, bits: int):
    """A row for each document, and the places of its blocks in the index's bitmap."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.binary()), ("slice", pa.int32()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                texts = texts_of(part.column(1))
                words = Words(texts)
                h = words.hashes()
                hi, lo = _signatures(words, h)
                m = len(part)
                sha = [hashlib.sha256(x).digest() for x in _joined(texts, words)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(words.count.astype(np.int64)), pa.array(hi), pa.array(lo), pa.array(sha, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=out)
                win, at, _ = _windows(words, h, k)
                blocks.append(win[at % k == 0])
                held += len(blocks[-1])
            if held > 4_000_000:
                yield slices(blocks)
                blocks, held = [], 0
        if blocks:
            yield slices(blocks)

    def slices(blocks):
        found = sparse(np.concatenate(blocks), bits)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(found), f.type) for f in list(out)[:5]), *found.columns], schema=out)

    return run


def _windows(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of documents that a window of 2k words fits in; their places there, and the documents."""
    win = window_hashes(h, k)
    if not len(win):
        return win, np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc[: len(win)]
    at = np.arange(len(win)) - words.first[doc]
    ok = (words.doc[k - 1 :] == doc) & (words.count[doc] >= 2 * k)
    return win[ok], at[ok], doc[ok]


def _probe(k: int, found: np.ndarray, bits: int):
    """Rolling windows that may be in the index."""
    out = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                words = Words(texts_of(part.column(1)))
                h = words.hashes()
                win, at, doc = _windows(words, h, k)
                ok = maybe(found, bits, win)
                win, at, doc = win[ok], at[ok], doc[ok]
                if len(win):
                    cls = _signatures(words, h)[0][doc]
                    yield pa.RecordBatch.from_arrays([pa.array(win.view(np.int64)), pa.array(cls), pa.array(part.column(0).to_numpy()[doc]), pa.array(at.astype(np.int32))], schema=out)

    return run


def _candidates(k: int):
    """128-bit hashes of the windows of 2k words that hold a hit."""
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                words = Words(texts_of(part.column(1)))
                h1, h2 = words.hashes(), words.hashes(base=SECOND)
                ids, hits, rows = part.column(0).to_numpy(), part.column(2), []
                near = np.zeros(len(h1) + 1, np.int32)
                for i in range(len(part)):
                    p = hits[i].values.to_numpy()
                    np.add.at(near, words.first[i] + np.maximum(p - k, 0), 1)
                    np.add.at(near, words.first[i] + np.minimum(p + 1, words.count[i]), -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                rows = starts[words.first[words.doc[starts]] + words.count[words.doc[starts]] - starts >= 2 * k]
                if len(rows):
                    doc = words.doc[rows]
                    w1, w2 = window_hashes(h1, 2 * k), window_hashes(h2, 2 * k, int(ODD))
                    yield pa.RecordBatch.from_arrays([pa.array(w1[rows].view(np.int64)), pa.array(w2[rows].view(np.int64)), pa.array(ids[doc]), pa.array((rows - words.first[doc]).astype(np.int32))], schema=out)

    return run


def _cut(k: int):
    """What is left of the texts whose repeated windows are given."""
    out = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                texts = texts_of(part.column(1))
                words = Words(texts)
                starts = [words.first[i] + part.column(2)[i].values.to_numpy() for i in range(len(part))]
                gone = covered(np.concatenate(starts), 2 * k, len(words.start))
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                left = _joined(texts, words, ~gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array([x.decode() for x in left], pa.string())], schema=out)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; with keep_text also kept, null where nothing was removed."""
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    with scratch() as keep:
        return keep(written(_remove(docs, window, keep_text), "left"))


def _remove(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    k = window // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bits_for(n_bytes // (6 * k))
    found = written(docs.mapInArrow(_profile(k, bits), "doc_id long, n long, hi long, lo long, sha binary, slice int, places binary"), "profiles")
    index = bitmap(by_key(found), bits)
    known = found.where("slice is null").groupBy("doc_id").agg(F.max(F.struct("n", "hi", "lo", "sha")).alias("s")).select("doc_id", "s.*")
    first = known.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"))
    known = written(known.join(first, ["n", "hi", "lo"]).select("doc_id", "n", "lo", "sha", (F.col("rep") == F.col("doc_id")).alias("own")), "known")
    reps = known.where("own").select("doc_id")

    probes = written(docs.mapInArrow(_probe(k, index, bits), "h long, cls long, doc_id long, pos int"), "probes")
    # a hit: a block of one document that is a window of another. All of an anchor's places are hits, without making pairs of them.
    is_block = F.col("pos") % k == 0
    shared = probes.groupBy("h").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.bool_or(is_block).alias("block")).where("block and x <> y").select("h")
    hits = probes.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("hits")).join(reps, "doc_id")
    hits = written(hits, "hits")
    discard(probes)

    part = rows_of(docs, hits.select("doc_id")).join(hits, "doc_id").select("doc_id", "text", "hits")
    windows = written(part.mapInArrow(_candidates(k), "k1 long, k2 long, doc_id long, pos int"), "windows")
    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    again = windows.join(least, ["k1", "k2"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    again = written(again, "repeats")
    discard(windows)

    cut = rows_of(docs, again.select("doc_id")).join(again, "doc_id").select("doc_id", "text", "starts").mapInArrow(_cut(k), "doc_id long, n_removed long, kept_sha256 string, kept string")
    if not keep_text:
        cut = cut.drop("kept")
    cut = written(cut.dropDuplicates(["doc_id"]), "cut")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = ~F.col("own") & (F.col("n") >= window)
    out = known.join(cut, "doc_id", "left")
    sha = F.when(copy, F.lit(nothing)).when(F.col("n_removed").isNull(), F.lower(F.hex("sha"))).otherwise(F.col("kept_sha256"))
    gone = F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_words"), gone.alias("n_removed"), sha.alias("kept_sha256"), *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))
