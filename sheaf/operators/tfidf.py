"""TF-IDF of word n-grams, and sparse rows of it.

Terms are lower-case words of two characters at least, and pairs of neighbours among them. Weight:
(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to length 1 for each text. The vocabulary is the most
frequent terms by count in the corpus; ties go to the term that sorts first.

A text's terms are counted in Arrow batches, each text on its own: nothing is shuffled but words and pairs that
may be in the vocabulary, with sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import let

TOKEN = r"[\p{L}\p{N}_]{2,}"
VOCABULARY = "term string, total long, df long, idf double, idx int"
#: Words whose pairs are counted by number; with more, all pairs are counted by name.
MOST_WORDS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def pairs(text: Column) -> Column:
    """Pairs of neighbouring words."""

    def both(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    return let(words(text), both)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a batch's lists, and the list that each is in."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(n)), n)


def _numbers(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of words in known, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(number: np.ndarray, owner: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """first * base + second of neighbours that both have a number, and their text."""
    a, b = number[:-1], number[1:]
    keep = np.flatnonzero((a >= 0) & (b >= 0) & (owner[1:] == owner[:-1]))
    return a[keep] * base + b[keep], owner[keep]


def _counts(owner: np.ndarray, term: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, term (under base) and count of distinct pairs, in order."""
    keys = np.sort(owner * base + term)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads] // base, keys[heads] % base, np.diff(np.append(heads, len(keys)))


def _lists(owner: np.ndarray, rows: int, **columns: pa.Array) -> pa.Array:
    """A list of structs for each row, from columns in order of owner."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _totals(texts: DataFrame, kind: str, terms: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, int, Callable]]) -> DataFrame:
    """term, total and df. terms gives the terms of a batch of lists as numbers, their texts, a number over all, and what makes terms of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, owner, base, named = terms(batch.column(0))
            _, term, n = _counts(owner, term, base)
            order = np.argsort(term, kind="stable")
            term, n = term[order], n[order]
            heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            if len(heads):
                df = np.diff(np.append(heads, len(term)))
                yield pa.RecordBatch.from_arrays([named(term[heads]), pa.array(np.add.reduceat(n, heads), pa.int64()), pa.array(df, pa.int64())], names=["term", "total", "df"])

    each = texts.mapInArrow(run, f"term {kind}, total long, df long")
    return each.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _by_name(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, int, Callable]:
    flat, owner = _flat(lists)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner, max(1, len(coded.dictionary)), lambda x: coded.dictionary.take(pa.array(x))


def vocabulary(texts: DataFrame, size: int, text: str = "text") -> list[Row]:
    """The `size` most frequent terms with total, df, idf and idx, their place in the vocabulary.

    A pair occurs no more often than each of its words. So once `size` words occur `least` times, only pairs
    of such words can be among the terms, and only these are counted.
    """
    texts = texts.select(F.col(text).alias("text"))
    single = _totals(texts.select(words(F.col("text"))), "string", _by_name).persist()
    try:
        order = [F.desc("total"), F.asc("term")]
        top = single.orderBy(*order).limit(size).collect()  # `size` rows
        least = top[-1]["total"] if len(top) == size and top else 0
        known = [r["term"] for r in single.where(F.col("total") >= least).select("term").limit(MOST_WORDS + 1).collect()]
    finally:
        single.unpersist()
    if len(known) <= MOST_WORDS:
        known.sort()
        base = max(1, len(known))

        def by_number(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, int, Callable]:
            flat, owner = _flat(lists)
            pair, owner = _pairs(_numbers(flat, pa.array(known, pa.string())), owner, base)
            return pair, owner, base * base, lambda x: pa.array(x, pa.int64())

        found = _totals(texts.select(words(F.col("text"))), "long", by_number).where(F.col("total") >= least).withColumnRenamed("term", "pair")
        names = texts.sparkSession.createDataFrame(list(enumerate(known)), "at long, word string")
        first, second = (names.select(F.col("at").alias(k), F.col("word").alias(f"{k}_word")) for k in ("one", "two"))
        found = found.withColumn("one", F.expr(f"pair div {base}")).withColumn("two", F.expr(f"pair % {base}L"))
        found = found.join(F.broadcast(first), "one").join(F.broadcast(second), "two")  # MOST_WORDS rows at most
        found = found.select(F.concat_ws(" ", "one_word", "two_word").alias("term"), "total", "df")
    else:
        found = _totals(texts.select(pairs(F.col("text"))), "string", _by_name)
    top += found.orderBy(*order).limit(size).collect()  # `size` rows
    top.sort(key=lambda r: (-r["total"], r["term"].encode()))
    n = texts.count()
    return [Row(term=r["term"], total=r["total"], df=r["df"], idf=float(np.log((1.0 + n) / (1.0 + r["df"])) + 1.0), idx=k) for k, r in enumerate(top[:size])]


def cells(text: Column, vocab: list[Row]) -> Column:
    """The (idx, weight) of a text's terms in the vocabulary, in order of idx."""
    split = [r["term"].split(" ") for r in vocab]
    known = sorted({w for term in split for w in term})
    at, base = {w: k for k, w in enumerate(known)}, max(1, len(known))
    # words, then pairs, by number
    code = np.array([at[t[0]] if len(t) == 1 else base + at[t[0]] * base + at[t[1]] for t in split], np.int64)
    order = np.argsort(code)
    code, idx, idf = code[order], np.array([r["idx"] for r in vocab], np.int64)[order], np.zeros(len(vocab))
    idf[idx] = np.array([r["idf"] for r in vocab])[order]

    @F.arrow_udf("array<struct<idx:int,weight:double>>")
    def run(lists: pa.Array) -> pa.Array:
        flat, owner = _flat(lists)
        number = _numbers(flat, pa.array(known, pa.string()))
        pair, of = _pairs(number, owner, base)
        inside = number >= 0
        term, owner = np.concatenate([number[inside], base + pair]), np.concatenate([owner[inside], of])
        place = np.minimum(np.searchsorted(code, term), max(0, len(code) - 1))
        hit = np.flatnonzero(code[place] == term) if len(code) else np.zeros(0, np.int64)
        owner, term, n = _counts(owner[hit], idx[place[hit]], max(1, len(idx)))
        w = (1.0 + np.log(n)) * idf[term]
        length = np.sqrt(np.bincount(owner, w * w, minlength=len(lists)))
        return _lists(owner, len(lists), idx=pa.array(term, pa.int32()), weight=pa.array(w / length[owner], pa.float64()))

    return run(words(text))


@F.arrow_udf(DoubleType())
def cosine(prev: pa.Array, curr: pa.Array) -> pa.Array:
    """Sum over common idx of the products of two texts' weights."""
    parts = []
    for lists in (prev, curr):
        flat, owner = _flat(lists)
        idx, weight = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("idx", "weight"))
        parts.append((owner << 32 | idx.astype(np.int64), weight))
    (a, x), (b, y) = parts
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return pa.array(np.bincount(common >> 32, x[i] * y[j], minlength=len(prev)).astype(np.float64))
