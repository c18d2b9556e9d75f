"""Exact substring dedup of bytes with sorted suffixes.

A string of `length` bytes goes to the shard of the least hash of the 24-byte strings in it, so
equal strings meet, whichever documents they stand in. Consecutive strings with one such hash
travel as one segment. Hashes that come once in the corpus need no shard; the others' segments are
cut into shards of bounded size, and each shard's suffixes are sorted by induction; equal strings
are neighbours then. A hash with over `most` segments isn't given to one shard: its strings are
counted by their own 128-bit hashes, in aggregates with partial sums.

Documents with equal bytes are one class: every byte of its members goes, if a string fits (or, where first
occurrences stay, of all but the least), and one member represents the class as a place where others' strings start.

Defined results: null is the empty text; texts shorter than `length` bytes lose nothing; matches
never cross documents, but may overlap in one; rows without a doc_id are left out; rows of one
doc_id are one document, the longest; the input's other columns are ignored. What is left of a text
may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._filters import rows_of, without
from ._induced import equal_groups, words_at
from ._store import discard, scratch, written
from ._text import U64, Texts, chunks, mix, release, texts_of

GRAM = 24
RUNS = 2_000  # looked through at once


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    w = words_at(data)
    n = len(data) - GRAM + 1
    h = w[:n] * U64(0x9E3779B97F4A7C15)
    h += w[8 : 8 + n]
    h = mix(h)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h += w[16 : 16 + n]
    return mix(h)


def segments(texts: Texts, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one least hash of a GRAM-byte string in them: the hash, the text, the first string's place in it,
    the number of strings, and whether the hash comes twice, without which no string can come twice in the run."""
    if len(texts.data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    grams = gram_hashes(texts.data)
    least = _sliding_min(grams, length - GRAM + 1)
    n = np.maximum(texts.lens - length + 1, 0)
    keep = n > 0
    doc = np.repeat(np.flatnonzero(keep).astype(np.int32), n[keep])
    local = np.arange(len(doc), dtype=np.int32)
    local -= np.repeat((np.cumsum(n[keep]) - n[keep]).astype(np.int32), n[keep])
    value = least[texts.bounds[doc] + local]
    del least
    heads = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    m, doc, local, n = value[heads], doc[heads].astype(np.int64), local[heads].astype(np.int64), np.diff(np.append(heads, len(doc)))
    del value
    twice = np.zeros(len(m), bool)
    for lo in range(0, len(m), RUNS):
        size = n[lo : lo + RUNS] + length - GRAM
        ends = np.cumsum(size)
        begin = texts.bounds[doc[lo : lo + RUNS]] + local[lo : lo + RUNS]
        same = grams[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)] == np.repeat(m[lo : lo + RUNS], size)
        twice[lo : lo + RUNS] = np.add.reduceat(same, ends - size, dtype=np.int32) > 1
    return m, doc, local, n, twice


def byte_signatures(texts: Texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """128 bits for each text, and its SHA-256."""
    sha = [hashlib.sha256(texts.one(i)).digest() for i in range(len(texts))]
    both = np.frombuffer(b"".join(sha), np.int64).reshape(-1, 4)
    return both[:, 0].copy(), both[:, 1].copy(), sha


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.binary())])
    for batch in batches:
        for part in chunks(batch, 8 << 20):
            texts = texts_of(part.column(1))
            hi, lo, sha = byte_signatures(texts)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts.lens), pa.array(hi), pa.array(lo), pa.array(sha, pa.binary())], schema=out)


def _segment_rows(length: int):
    out = pa.schema([("m", pa.int64()), ("cls", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20):
                texts = texts_of(part.column(1))
                m, doc, at, n, twice = segments(texts, length)
                if len(m):
                    cls = byte_signatures(texts)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(cls[doc]), pa.array(part.column(0).to_numpy()[doc]), pa.array(at), pa.array(n.astype(np.int32)), pa.array(twice)], schema=out)

    return run


def _segment_bytes(length: int):
    """The segments asked for, with their bytes; of hot ones the hashes of their strings."""
    out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("raw", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20, 2_000):
                texts, ids = texts_of(part.column(1)), part.column(0).to_numpy()
                wanted = part.column(2)
                rows = wanted.values[wanted.offsets[0].as_py() : wanted.offsets[-1].as_py()]
                doc = np.repeat(np.arange(len(part)), np.diff(wanted.offsets.to_numpy()))
                at, n, shard = (rows.field(k).to_numpy() for k in ("at", "n", "shard"))
                place = texts.bounds[doc] + at
                cold = np.flatnonzero(shard >= 0)
                data = texts.data.tobytes()
                raw = [data[place[i] : place[i] + n[i] - 1 + length] for i in cold]
                if len(cold):
                    yield pa.RecordBatch.from_arrays([pa.array(shard[cold]), pa.array(ids[doc[cold]]), pa.array(at[cold]), pa.array(raw, pa.binary()), pa.nulls(len(cold), pa.int64()), pa.nulls(len(cold), pa.int64())], schema=out)
                hot = np.flatnonzero(shard < 0)
                if len(hot):
                    words = words_at(texts.data)
                    size = n[hot].astype(np.int64)
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    start, owner, local = np.repeat(place[hot], size) + step, np.repeat(doc[hot], size), np.repeat(at[hot], size) + step
                    k1, k2 = np.zeros(len(start), np.uint64), np.full(len(start), 7, np.uint64)
                    for k in range(0, length, 8):
                        w = words[start + k]
                        k1, k2 = mix(k1 + w), mix((k2 ^ w) * U64(0x9E3779B97F4A7C15) + U64(k))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(start), pa.int32()), pa.array(ids[owner]), pa.array(local), pa.nulls(len(start), pa.binary()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], schema=out)

    return run


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places as runs: document, first place, number."""
    order = np.lexsort((at, doc))
    return _ordered_runs(doc[order], at[order])


def _ordered_runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    return doc[heads], at[heads], np.diff(np.append(heads, len(at)))


SPANS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def _shard_spans(rows: pa.Table, length: int, keep_first: bool) -> pa.Table:
    coded = rows.column("raw").combine_chunks().dictionary_encode()
    codes, pieces = coded.indices.to_numpy(), texts_of(coded.dictionary)
    doc, at = rows.column("doc_id").to_numpy(), rows.column("at").to_numpy()
    times = np.bincount(codes, minlength=len(pieces))
    n = pieces.lens - length + 1
    first = np.concatenate([[0], np.cumsum(n)])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), n)
    local = np.arange(first[-1], dtype=np.int32)
    local -= first[piece].astype(np.int32)
    order, same = equal_groups(pieces.data, pieces.bounds[1:], (pieces.bounds[piece] + local).astype(np.int32), length)
    found = np.repeat(times > 1, n)
    found[order[same]] = found[order[np.flatnonzero(same) - 1]] = True
    by_place = np.lexsort((at, doc, codes))
    lowest = by_place[np.searchsorted(codes[by_place], np.arange(len(pieces)))]  # each piece's first segment
    own = np.zeros(first[-1], bool)
    if keep_first and len(order):
        # of each group of equal strings the one that stands first in the corpus, in its piece's first segment; segments of a document share no place
        turn = np.empty(len(pieces), np.int64)
        turn[np.lexsort((at[lowest], doc[lowest]))] = np.arange(len(pieces))
        stands = turn[piece[order]] * (int(n.max()) + 1)
        stands += local[order]
        heads = np.flatnonzero(~same)
        own[order[stands == np.repeat(np.minimum.reduceat(stands, heads), np.diff(np.append(heads, len(order))))]] = True
        del stands, heads
    del order, same
    # runs within the pieces, then for each segment with that piece
    p, a, k = _ordered_runs(piece[found], local[found])
    order = np.argsort(codes, kind="stable")
    lo, size = np.searchsorted(codes[order], p), times[p]
    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    seg = order[np.repeat(lo, size) + each]
    a, k = np.repeat(a, size), np.repeat(k, size)
    if keep_first:
        others = seg != lowest[codes[seg]]
        found &= ~own
        p, b, m = _ordered_runs(piece[found], local[found])
        seg, a, k = np.concatenate([seg[others], lowest[p]]), np.concatenate([a[others], b]), np.concatenate([k[others], m])
    return pa.Table.from_arrays([pa.array(doc[seg]), pa.array(at[seg] + a), pa.array(k)], schema=SPANS)


def _sort_shard(length: int, keep_first: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        release()
        spans = _shard_spans(rows, length, keep_first)
        release()
        return spans

    return run


def _hot_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, a, n = _runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(n)], schema=SPANS)


def _cut(length: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                texts, spans, rows = texts_of(part.column(1)), part.column(2), []
                for i in range(len(part)):
                    s = spans[i].values
                    at, n = s.field("at").to_numpy(), s.field("n").to_numpy()
                    change = np.zeros(texts.lens[i] + 1, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    left = texts.one(i)[~gone].tobytes()
                    rows.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[1:]))], schema=out)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, keep_text: bool = True, keep_first: bool = False, most: int = 8192, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256; with keep_text also kept, null where nothing was removed.

    keep_first: a string that comes several times stays where it starts first, by doc_id and place; of documents with equal bytes, the least stays.
    """
    if length % 8 or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of 8 and {2 * GRAM} at least")
    with scratch() as keep:
        return keep(written(_remove(docs, length, keep_text, keep_first, most, shard_bytes), "left"))


def _remove(docs: DataFrame, length: int, keep_text: bool, keep_first: bool, most: int, shard_bytes: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    known = docs.mapInArrow(_profile, "doc_id long, n long, hi long, lo long, sha binary")
    known = written(known.groupBy("doc_id").agg(F.max(F.struct("n", "hi", "lo", "sha")).alias("s")).select("doc_id", "s.*"), "profiles")
    classes = known.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    known = written(known.join(classes, ["n", "hi", "lo"]).select("doc_id", "n", "hi", "sha", "members", (F.col("rep") == F.col("doc_id")).alias("own")), "known")

    rows = written(docs.mapInArrow(_segment_rows(length), "m long, cls long, doc_id long, at long, n int, twice boolean"), "segments")
    where = F.struct("cls", "at")
    shared = rows.groupBy("m").agg(F.min(where).alias("x"), F.max(where).alias("y"), F.count("*").alias("times"), F.bool_or("twice").alias("twice"))
    shared = shared.where((F.col("x") != F.col("y")) | F.col("twice")).select("m", "times")
    reps = known.where(F.col("own") & (F.col("n") >= length)).select("doc_id", F.col("hi").alias("cls"))
    wanted = written(rows.join(shared, "m").join(reps, ["doc_id", "cls"]).select("m", "times", "doc_id", "at", "n"), "wanted")
    discard(rows)
    total = wanted.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0))).first()[0]
    shard = F.when(F.col("times") > most, F.lit(-1)).otherwise(F.pmod(F.xxhash64("m"), F.lit(max(1, -(-total // shard_bytes))))).cast("int")
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", shard.alias("shard"))).alias("wanted"))
    part = rows_of(docs, wanted.select("doc_id").distinct()).join(lists, "doc_id").join(known.select("doc_id", F.col("n").alias("size")), "doc_id")
    part = part.where("octet_length(text) = size").select("doc_id", "text", "wanted")
    pieces = part.mapInArrow(_segment_bytes(length), "shard int, doc_id long, at long, raw binary, k1 long, k2 long")
    if wanted.where(F.col("times") > most).isEmpty():
        spans = pieces.groupBy("shard").applyInArrow(_sort_shard(length, keep_first), "doc_id long, at long, n long")
    else:
        pieces = written(pieces, "pieces")
        spans = pieces.where("shard is not null").groupBy("shard").applyInArrow(_sort_shard(length, keep_first), "doc_id long, at long, n long")
        hot = pieces.where("shard is null").select("k1", "k2", "doc_id", "at")
        twice = hot.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("x"), F.max(F.struct("doc_id", "at")).alias("y")).where("x <> y").select("k1", "k2", "x")
        found = hot.join(twice, ["k1", "k2"])
        if keep_first:
            found = found.where(F.struct("doc_id", "at") != F.col("x"))
        found = found.select("doc_id", "at").mapInArrow(_hot_runs, "doc_id long, at long, n long")
        spans = spans.unionByName(found)
    spans = written(spans.join(known.where("own" if keep_first else "members = 1").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    discard(wanted)
    cut = rows_of(docs, spans.select("doc_id")).join(spans, "doc_id").join(known.select("doc_id", F.col("n").alias("size")), "doc_id").where("octet_length(text) = size").select("doc_id", "text", "spans")
    cut = cut.mapInArrow(_cut(length), "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not keep_text:
        cut = cut.drop("kept")
    cut = written(cut, "cut").dropDuplicates(["doc_id"])
    copy = (F.col("members") > 1) & (F.col("n") >= length)
    if keep_first:
        copy &= ~F.col("own")
    out = known.join(cut, "doc_id", "left")
    sha = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("n_removed").isNull(), F.lower(F.hex("sha"))).otherwise(F.col("kept_sha256"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        sha.alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )


def cleaned(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows of docs, with all columns; text is what is left of it, without characters that lost some of their bytes.

    Each string that comes twice stays where it starts first. Rows that lose their whole text go. A column n_chars is counted anew. Rows without a doc_id stay as they are.
    """
    with scratch() as keep:
        changed = keep(written(remove_repeats(docs, length, keep_first=True).where("n_removed > 0").select("doc_id", "kept"), "changed"))
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.as_buffer().to_pybytes().decode("utf-8", "ignore") for x in batch.column(1)], pa.string())], schema=out)

    left = changed.where("octet_length(kept) > 0").mapInArrow(decode, "doc_id long, text string")
    left = docs.drop("text").join(left, "doc_id")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return without(docs, changed.select("doc_id")).unionByName(left.select(docs.columns))
