"""SentencePiece encoding and decoding for merge-type vocabularies.

The adjacent symbol pairs of a batch's distinct words form one agenda, ordered by score, then by
place. What has the best score is taken from it for all words at once; merging a pair enters the
pairs beside it. Within a word this is the library's order: pairs of one score are merged
together only where the new pairs all come later, else the leftmost alone. A word's length doesn't matter.
Every text is also encoded by the library, a batch in one call; a difference stops the job.

Defined results: null is the empty text, which has only the begin and end ids; equal texts give
equal results; repeated rows, and rows without a doc_id, have a result each; an empty table gives an
empty result; the input's other columns are ignored. Characters without a piece give the ids of
their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._pieces import NONE, Pieces, apart, characters, distinct_words, gather, pieces
from ._text import chunks


class Agenda:
    """Places of pairs by rank, lowest first. A place may be there several times, and under ranks it no longer has."""

    def __init__(self, rank: np.ndarray):
        live = np.flatnonzero(rank != NONE)
        order = live[np.argsort(rank[live], kind="stable")]
        keys, heads = np.unique(rank[order], return_index=True)
        self.parts = {k: [x] for k, x in zip(keys.tolist(), np.split(order, heads[1:]))} if len(order) else {}
        self.heap = list(self.parts)  # sorted, so a heap

    def enter(self, places: np.ndarray, rank: np.ndarray) -> None:
        if len(places) > 1:
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
        ends = np.flatnonzero(np.append(rank[1:] != rank[:-1], True)) + 1
        at = 0
        for to in ends.tolist():
            k = int(rank[at])
            if k in self.parts:
                self.parts[k].append(places[at:to])
            else:
                self.parts[k] = [places[at:to]]
                heapq.heappush(self.heap, k)
            at = to

    def take(self) -> tuple[int, np.ndarray]:
        k = heapq.heappop(self.heap)
        parts = self.parts.pop(k)
        return k, np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def merged(model: Pieces, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbols of words from first[i] to first[i + 1] when no pair merges any more, each where it begins; -1 elsewhere."""
    n = len(symbols)
    sym = symbols.astype(np.int32)
    # nowhere is n: it has no symbol, and no pair begins there
    sym, after, before = np.append(sym, model.size), np.arange(1, n + 2), np.arange(-1, n)
    after[n], before[0] = n, n
    inner = first[1:-1]
    ends = np.unique(first[1:]) - 1
    after[ends[ends >= 0]] = n
    heads = inner[inner < n]
    before[heads] = n
    before[n] = n
    word = np.append(np.repeat(np.arange(len(first) - 1), np.diff(first)), -1)
    to, rank = np.zeros(n + 1, np.int32), np.full(n + 1, NONE)
    starts = np.flatnonzero(after[:n] < n)
    to[starts], rank[starts] = model.pairs(sym[starts], sym[starts + 1])
    agenda = Agenda(rank)

    def look(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made, r = model.pairs(sym[i], sym[j])
        return made, np.where((i == n) | (j == n), NONE, r)

    while agenda.heap:
        k, hit = agenda.take()
        hit = hit[rank[hit] == k]
        if len(hit) > 1:
            hit, left = apart(model, hit, sym, to, word, after, before, k, n)
            if len(left):
                agenda.enter(left, np.full(len(left), k, rank.dtype))
        if not len(hit):
            continue
        gone = after[hit]
        sym[hit] = to[hit]
        sym[gone], rank[gone] = -1, NONE
        far = after[gone]
        after[hit] = far
        back = far < n
        before[far[back]] = hit[back]
        prev = before[hit]
        for i, j in ((hit, far), (prev, hit)):
            made, r = look(i, j)
            real = i < n
            to[i[real]], rank[i[real]] = made[real], r[real]
            new = real & (r != NONE)
            if new.any():
                agenda.enter(i[new], r[new])
    return sym[:n]


def encode_words(model: Pieces, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and where each word's begin."""
    points, first = characters(words)
    left = merged(model, model.symbol[points], first)
    bare = np.flatnonzero(left >= model.size)
    size = (left >= 0).astype(np.int64)
    raw = [chr(points[j]).encode() for j in bare]
    size[bare] = [len(x) for x in raw]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(ends[-1], np.int32)
    keep = (left >= 0) & (left < model.size)
    flat[ends[:-1][keep]] = left[keep]
    for j, x in zip(bare, raw):
        flat[ends[j] : ends[j + 1]] = model.byte_ids[list(x)]
    return flat, ends[first]


@lru_cache(2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a column with begin and end ids, and where each text's begin."""
    model = pieces(path)
    words, place, first = distinct_words(column)
    flat, starts = encode_words(model, words)
    size = np.diff(starts)
    n_ids = np.concatenate([[0], np.cumsum(size[place])])[first]
    bounds = n_ids + 2 * np.arange(len(n_ids))
    out = np.empty(bounds[-1], np.int32)
    inner = np.ones(len(out), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    out[inner] = gather(flat, starts[:-1][place], size[place])
    out[bounds[:-1]], out[bounds[1:] - 1] = model.bos, model.eos
    return out, bounds


def encode_decode(docs: DataFrame, path: str, check: bool = True, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids, their number and digest, and the digest of what decode() makes of them; without ids and text where keep_ids is false.

    check: every text's ids are compared with the library's.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * keep_ids
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for batch in batches:
            for part in chunks(batch, 8 << 20, 20_000):
                ids, bounds = encode_batch(path, part.column(1))
                own = [ids[bounds[i] : bounds[i + 1]] for i in range(len(part))]
                lists = [x.tolist() for x in own]
                if check:
                    theirs = lib.encode([t or "" for t in part.column(1).to_pylist()], add_bos=True, add_eos=True, num_threads=1)
                    if theirs != lists:
                        i = next(i for i, (x, y) in enumerate(zip(theirs, lists)) if x != y)
                        raise ValueError(f"the library encodes the text of doc_id {part.column(0)[i]} differently")
                text = lib.decode(lists, num_threads=1)
                columns = [part.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in own]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text])]
                if keep_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
