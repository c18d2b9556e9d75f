"""Token counts by rank-synchronous array merging.

The distinct words of a batch of texts stand one after another in one array of symbols. In each
step every word merges its pairs of lowest rank, all words at once, and words without a pair that
merges leave the array. The symbols that survive are the tokens; a character without a piece counts
as many as it has UTF-8 bytes. No ids are made of symbols. A long word takes about as many steps as
it has ranks of pairs, in an array that holds it and other long ones alone.

Defined results: null counts as the empty text, which has no token; equal texts have equal counts;
repeated rows, and rows without a doc_id, are counted each; an empty table gives an empty result; the
input's other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._pieces import NONE, Pieces, apart, characters, distinct_words, pieces, utf8_size
from ._text import chunks, texts_of


def surviving(model: Pieces, points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of tokens of each word, given as code points from first[i] to first[i + 1]."""
    lens = np.diff(first)
    sym = model.symbol[points]
    word = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    bare = sym >= model.size
    count = lens + np.bincount(word[bare], weights=utf8_size(points[bare]) - 1, minlength=len(lens)).astype(np.int64)
    if len(sym) < 2:
        return count
    to, rank = model.pairs(sym[:-1], sym[1:])
    to, rank = np.append(to, 0), np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)
    while len(sym):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.minimum.reduceat(rank, heads)
        size = np.diff(np.append(heads, len(sym)))
        if (lowest == NONE).any():
            stay = np.repeat(lowest != NONE, size)
            sym, word, to, rank = sym[stay], word[stay], to[stay], rank[stay]
            size, lowest = size[lowest != NONE], lowest[lowest != NONE]
            if not len(sym):
                break
        n = len(sym)
        lowest = np.repeat(lowest, size)
        hit = np.flatnonzero(rank == lowest)
        if len(hit) > 1 and (word[hit[1:]] == word[hit[:-1]]).any():
            # the places beside each one, n for none
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            ends = np.flatnonzero(np.append(word[1:] != word[:-1], True))
            after[ends], after[n], before[0], before[n] = n, n, n, n
            before[ends[:-1] + 1] = n
            hit, _ = apart(model, hit, np.append(sym, model.size), to, word, after, before, lowest[hit], n)
        sym[hit] = to[hit]
        np.subtract.at(count, word[hit], 1)
        stay = np.ones(n, bool)
        stay[hit + 1] = False
        rank[hit] = NONE
        sym, word, to, rank = sym[stay], word[stay], to[stay], rank[stay]
        hit = hit - np.arange(len(hit))
        again = np.concatenate([hit, hit[hit > 0] - 1])
        again = again[again < len(sym) - 1]
        again = again[word[again] == word[again + 1]]
        to[again], rank[again] = model.pairs(sym[again], sym[again + 1])
    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in chunks(batch, 8 << 20, 40_000):
                words, place, first = distinct_words(part.column(1))
                each = surviving(model, *characters(words)) if len(words) else np.zeros(0, np.int64)
                n = np.concatenate([[0], np.cumsum(each[place])])[first]
                n = np.diff(n)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts_of(part.column(1)).lens), pa.array(n), pa.array(n > limit)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
