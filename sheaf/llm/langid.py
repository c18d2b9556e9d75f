"""Language ID by mixture inference.

Each language is a distribution over hashed byte trigrams of case-folded text. A document is a
mixture of languages; expectation-maximisation estimates the proportions, and a language joins the
document's set only if the penalised likelihood rises.

Defined results: null text or a text without a letter gives `und` with score 0 and an empty mixture; no usable
labelled row gives `und` for every document; repeated rows, and rows without a doc_id, have a result each; an empty
table gives an empty result; the input's other columns, whatever their names, are ignored. Texts are used whole. The candidate that joins a set next is the
one with the steepest likelihood; ties go to the language that sorts first.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, texts_of

BUCKETS = 8192
#: Consecutive trigrams share two bytes, so three of them count as one observation.
OVERLAP = 3.0
FOLD = np.arange(256, dtype=np.uint32)
FOLD[:65] = 32
FOLD[65:91] += 32
FOLD[91:97] = 32
FOLD[123:128] = 32


def trigram_counts(texts, rows: slice) -> np.ndarray:
    """Documents by buckets, float32."""
    lo, hi = texts.bounds[rows.start], texts.bounds[rows.stop]
    n = rows.stop - rows.start
    if hi - lo < 3:
        return np.zeros((n, BUCKETS), np.float32)
    b = FOLD[texts.data[lo:hi]]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(19)
    doc = np.repeat(np.arange(n, dtype=np.int32), texts.lens[rows])
    ok = (doc[:-2] == doc[2:]) & (code != 0x202020)
    flat = doc[:-2][ok].astype(np.int64) * BUCKETS + bucket[ok]
    return np.bincount(flat, minlength=n * BUCKETS).astype(np.float32).reshape(n, BUCKETS)


class LanguageModel:
    """names, sorted; probs: languages by buckets."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        c = counts + smoothing
        self.probs = (c / c.sum(1, keepdims=True)).astype(np.float32)
        self.log = np.log(self.probs)

    def infer(self, counts: np.ndarray, rounds: int = 12, penalty: float = 2.0) -> np.ndarray:
        """Proportions, documents by languages; 0 for languages outside a document's set."""
        n, total = len(counts), counts.sum(1)
        theta = np.zeros((n, len(self.names)), np.float32)
        if n == 0 or not self.names:
            return theta
        single = counts @ self.log.T
        theta[np.arange(n), single.argmax(1)] = 1
        best = single.max(1) / OVERLAP
        active = np.flatnonzero(total > 0)
        size = 1
        while len(active) and size < len(self.names):
            mixed = theta[active] @ self.probs
            gain = (counts[active] / mixed) @ self.probs.T / total[active, None]
            gain[theta[active] > 0] = -np.inf
            new = gain.argmax(1)
            go = gain[np.arange(len(active)), new] > 1.0
            active, new = active[go], new[go]
            if not len(active):
                break
            t = theta[active] * np.float32(size / (size + 1))
            t[np.arange(len(active)), new] = np.float32(1 / (size + 1))
            c, m = counts[active], total[active, None]
            for _ in range(rounds):
                t *= (c / np.maximum(t @ self.probs, 1e-30)) @ self.probs.T / m
            t /= t.sum(1, keepdims=True)
            fit = (c * np.log(np.maximum(t @ self.probs, 1e-30))).sum(1) / OVERLAP
            cost = penalty + 0.5 * np.log(np.maximum(m[:, 0] / OVERLAP, 2))
            better = fit - best[active] > cost
            active = active[better]
            theta[active], best[active] = t[better], fit[better]
            size += 1
        return theta


def fit_languages(labelled: DataFrame, docs_per_lang: int = 1500, most_langs: int = 4096) -> LanguageModel:
    """Learns from rows (doc_id, text, lang).

    A bounded sample: of each language about docs_per_lang documents, those with the lowest hash of doc_id, with their
    whole texts. What comes to the driver is one count per language and bucket. The model grows with the number of
    languages; over most_langs values of lang are an error, none is left out.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().limit(most_langs + 1).collect()
    if len(sizes) > most_langs:
        raise ValueError(f"lang has over {most_langs} values")
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    names = sorted(r["lang"] for r in sizes)
    span = 2**31
    share = {r["lang"]: int(span * min(1.0, docs_per_lang / r["count"])) for r in sizes}
    cut = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    pick = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < cut[F.col("lang")])
    schema = "lang int, bucket int, n long"
    code = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(code), BUCKETS), np.int64)
        for batch in batches:
            for part in chunks(batch, 1 << 20, 256):
                texts, langs = texts_of(part.column(1)), part.column(2).to_pylist()
                c = trigram_counts(texts, slice(0, len(texts)))
                for i, lang in enumerate(langs):
                    total[code[lang]] += c[i].astype(np.int64)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    got = pick.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS))
    counts[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel(names, counts)


def mixtures(names: list[str], theta: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Each row's languages of a share over 0, largest first, ties by name."""
    row, lang = np.nonzero(theta)
    order = np.lexsort((lang, -theta[row, lang], row))
    row, lang = row[order], lang[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(theta)))]).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(theta[row, lang].astype(float))], names=["lang", "share"])
    return pa.ListArray.from_arrays(pa.array(bounds), parts).cast(kind)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs' doc_id with lang_pred, score (its proportion) and mixture (language and proportion, largest first)."""
    schema = "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.names
        for batch in batches:
            for part in chunks(batch, 2 << 20, 256):
                texts = texts_of(part.column(1))
                letters = pc.match_substring_regex(part.column(1), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                theta = model.infer(trigram_counts(texts, slice(0, len(texts))))
                if names:
                    top = theta.argmax(1)
                    score = theta[np.arange(len(top)), top].astype(float)
                else:
                    letters, top, score = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([names[k] if ok else "und" for k, ok in zip(top, letters)], pa.string()),
                        pa.array(np.where(letters, np.clip(score, 0, 1), 0.0)),
                        mixtures(names, np.where(letters[:, None], theta, 0), out.field(3).type),
                    ],
                    schema=out,
                )

    return docs.select("doc_id", "text").mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text has a letter and a language of least_share of it at least.

    A model that has learned no language rejects none: rows whose text has a letter stay.
    """
    column = docs.columns.index("text")
    if not model.names:
        warnings.warn("no language was learned, so none is rejected", stacklevel=2)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 256):
                texts = texts_of(part.column(column))
                letters = pc.match_substring_regex(part.column(column), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                share = model.infer(trigram_counts(texts, slice(0, len(texts)))).max(1, initial=0) if model.names else np.ones(len(texts))
                yield part.filter(pa.array(letters & (share >= least_share)))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether crc32 of doc_id as text leaves fold when divided by folds; false for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
