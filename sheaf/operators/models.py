"""Boundary models: fit(pages) on labelled streams, predict(pages) -> stream_id, pos, prob, pred.

pages are in long form with a column text, and with layout, visual or embedding where a model uses
them. prob is 1 for the first page of a stream. Trees are those of `boosting`; the linear model is
Spark's logistic regression, with the regularisation that C = 1 means elsewhere.
"""

from __future__ import annotations

import json
import zlib
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..functions import vectors as V
from . import boosting, decode, streams, tfidf
from .sampling import kfold

KEY = ["stream_id", "pos"]


@runtime_checkable
class Model(Protocol):
    name: str

    def predict(self, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class TrainableModel(Model, Protocol):
    def fit(self, pages: DataFrame) -> TrainableModel: ...


def compact(data: DataFrame, rows: int = 20_000) -> DataFrame:
    """data in partitions of about `rows` rows, no more than it has: learners run a job for each step, and small tasks cost most of it."""
    return data.coalesce(max(1, data.count() // rows))


class EveryPage:
    name = "every_page"

    def predict(self, pages: DataFrame) -> DataFrame:
        return pages.select(*KEY, F.lit(1.0).alias("prob"), F.lit(True).alias("pred"))


class NeverSplit:
    name = "never_split"

    def predict(self, pages: DataFrame) -> DataFrame:
        first = F.col("pos") == 0
        return pages.select(*KEY, first.cast("double").alias("prob"), first.alias("pred"))


class TextSimilarity:
    """A boundary where consecutive pages share few 4-grams: similarity under the threshold."""

    name = "text_similarity"

    def __init__(self, at: float = 0.15, n: int = 4):
        self.at, self.n = at, n

    def probs(self, pages: DataFrame) -> DataFrame:
        texts = pages.select(*KEY, F.coalesce("text", F.lit("")).alias("text"))
        pairs = texts.select(*KEY, F.lag("text").over(streams.in_order()).alias("prev"), "text")
        return pairs.select(*KEY, F.when(F.col("pos") == 0, 1.0).otherwise(1 - T.gram_similarity(F.col("prev"), F.col("text"), self.n)).alias("prob"))

    def predict(self, pages: DataFrame) -> DataFrame:
        return decode.threshold(self.probs(pages), 1 - self.at)


class PairTrees:
    """Gradient-boosted trees over TF-IDF of a page and the one before, and more features of the pair.

    blocks: any of page (the 8 page features), layout (with their cosine), layout_pairs, position, cross, embedding
    (pairs), embedding_cosine, visual. Learns from all labelled pages.
    """

    def __init__(self, name: str, blocks: tuple[str, ...] = (), vocab: int = 20_000, trees: int = 100, depth: int = 4, rate: float = 0.1, at: float = 0.5, use_text: bool = True):
        self.name, self.blocks, self.vocab_size, self.at, self.use_text = name, blocks, vocab, at, use_text
        self.trees, self.depth, self.rate = trees, depth, rate
        self.model: boosting.Trees | LogisticRegressionModel | None = None
        self.vocab: DataFrame | None = None

    def features(self, pages: DataFrame) -> DataFrame:
        """stream_id, pos, boundary and features of the pages after the first: sparse ones as idx and val, the others in dense."""
        base, w = pages, streams.in_order()
        arrays = []
        lagged = lambda c: (F.lag(c).over(w), F.col(c))
        base = streams.positions(base)
        for block in self.blocks:
            if block == "page":
                base = base.withColumn("page_f", T.page_features(F.col("text")))
                arrays.append(V.pair_difference(*lagged("page_f")))
            elif block in ("layout", "layout_pairs"):
                base = base.withColumn("layout", F.coalesce(V.doubles(F.col("layout")), V.zeros(14)) if "layout" in pages.columns else V.zeros(14))
                arrays.append(V.pair_difference(*lagged("layout")))
                if block == "layout":
                    arrays.append(F.array(V.cosine(*lagged("layout"))))
            elif block == "visual":
                arrays.append(V.pair_difference(*lagged("visual")))
            elif block == "position":
                arrays.append(F.array(F.col("relative"), F.col("remaining"), F.col("n_pages").cast("double")))
            elif block == "cross":
                arrays.append(T.cross_features(*lagged("text")))
            elif block == "embedding":
                arrays.append(V.pair_product(*lagged("embedding")))
            elif block == "embedding_cosine":
                arrays.append(F.array(V.cosine(*lagged("embedding"))))
            else:
                raise ValueError(f"there are no {block} features")
        sparse = F.array().cast("array<struct<idx:int,weight:double>>")
        if self.use_text:
            base = base.withColumn("cells", tfidf.cells(T.truncate(F.col("text")), self.vocab.collect()))  # vocab_size rows at most
            shifted = F.transform("cells", lambda c: F.struct((c["idx"] + self.vocab_size).alias("idx"), c["weight"].alias("weight")))
            sparse = F.concat(F.lag("cells").over(w), shifted)
        dense = F.concat(*arrays) if arrays else F.array().cast("array<double>")
        rows = base.withColumn("both", sparse).withColumn("dense", dense).where("pos >= 1")
        keep = [*KEY, *(["boundary"] if "boundary" in pages.columns else [])]
        return rows.select(*keep, F.col("both.idx").alias("idx"), F.col("both.weight").alias("val"), "dense")

    def fit(self, pages: DataFrame) -> PairTrees:
        streams.require_streams(pages, labelled=True)
        if self.use_text:
            rows = tfidf.vocabulary(pages.select(T.truncate(F.col("text")).alias("text")), self.vocab_size)
            self.vocab = pages.sparkSession.createDataFrame(rows, tfidf.VOCABULARY)
        self.model = self._learn(self.features(pages).withColumn("label", F.col("boundary").cast("double")), pages.count())
        return self

    def _learn(self, data: DataFrame, rows: int):
        return boosting.learned(data, boosting.Trees(self.trees, self.depth, self.rate), 2 * self.vocab_size, rows)

    def _scored(self, pages: DataFrame) -> DataFrame:
        return boosting.scored(self.features(pages), self.model, 2 * self.vocab_size, *KEY)

    def predict(self, pages: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError(f"{self.name} must be fitted first")
        probs = pages.select(*KEY).join(self._scored(pages), KEY, "left").withColumn("prob", F.when(F.col("pos") == 0, 1.0).otherwise(F.col("prob")))
        return decode.threshold(probs, self.at)

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError(f"{self.name} must be fitted first")
        spark = SparkSession.active()
        if isinstance(self.model, boosting.Trees):
            self.model.frame(spark).write.mode("overwrite").parquet(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        if self.vocab is not None:
            self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        spec = {"kind": type(self).__name__, "name": self.name, "blocks": list(self.blocks), "vocab": self.vocab_size, "trees": self.trees, "depth": self.depth, "rate": self.rate, "at": self.at, "use_text": self.use_text}
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


class PairLogistic(PairTrees):
    """Logistic regression over the pair's dense features instead of trees."""

    def __init__(self, name: str, blocks: tuple[str, ...], **options):
        super().__init__(name, blocks, **options | {"use_text": False})

    def _vectors(self, data: DataFrame) -> DataFrame:
        return data.withColumn("features", array_to_vector(F.col("dense")))

    def _learn(self, data: DataFrame, rows: int):
        data = data.persist()
        try:
            return LogisticRegression(regParam=1.0 / max(1, data.count()), elasticNetParam=0.0, standardization=False, maxIter=1000).fit(compact(self._vectors(data)))
        finally:
            data.unpersist()

    def _scored(self, pages: DataFrame) -> DataFrame:
        return self.model.transform(self._vectors(self.features(pages))).select(*KEY, vector_to_array("probability")[1].alias("prob"))


def load_model(spark, path: str) -> PairTrees:
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    kind = {"PairTrees": PairTrees, "PairLogistic": PairLogistic}[spec.pop("kind")]
    spec["blocks"] = tuple(spec["blocks"])
    made = kind(**spec)
    if kind is PairLogistic:
        made.model = LogisticRegressionModel.load(f"{path}/model")
    else:
        made.model = boosting.Trees.of(spark.read.parquet(f"{path}/model"), made.trees, made.depth, made.rate)
    if made.use_text:
        made.vocab = spark.read.parquet(f"{path}/vocab")
    return made


class Ensemble:
    """Weighted mean of models' probabilities."""

    def __init__(self, name: str, models: list, weights: list[float] | None = None, at: float = 0.5):
        self.name, self.models, self.weights, self.at = name, models, weights, at

    def fit(self, pages: DataFrame) -> Ensemble:
        for m in self.models:
            if hasattr(m, "fit"):
                m.fit(pages)
        return self

    def predict(self, pages: DataFrame) -> DataFrame:
        return decode.threshold(decode.late_ensemble([m.predict(pages) for m in self.models], self.weights), self.at)


class Smoothed:
    """A model's probabilities, decoded as a sequence."""

    def __init__(self, model, rates: decode.Rates = decode.Rates()):
        self.model, self.rates, self.name = model, rates, f"viterbi_{model.name}"

    def fit(self, pages: DataFrame) -> Smoothed:
        self.rates = decode.calibrate(pages, self.rates)
        if hasattr(self.model, "fit"):
            self.model.fit(pages)
        return self

    def predict(self, pages: DataFrame) -> DataFrame:
        probs = self.model.predict(pages).select(*KEY, "prob")
        return probs.join(decode.smooth(probs, self.rates), KEY)


class Stacked:
    """Logistic regression over a model's probabilities around each page.

    folds = 0 learns from the model's answers about its own training pages; folds of 2 or more learn from
    answers of models fitted without the fold, and fit the model on everything afterwards.
    """

    FEATURES = ["tail_max", "tail_mean", "tail_std", "n_pages", "relative"]

    def __init__(self, model, window: int = 2, folds: int = 0, seed: int = 0, at: float = 0.5):
        self.model, self.window, self.folds, self.seed, self.at = model, window, folds, seed, at
        self.name = f"{'oof' if folds else 'lr'}_{model.name}"
        self.top: LogisticRegressionModel | None = None

    def _rows(self, probs: DataFrame) -> DataFrame:
        near = [f"near_{k}" for k in range(2 * self.window + 1)]
        return VectorAssembler(inputCols=near + self.FEATURES, outputCol="features").transform(streams.neighbours(probs, window=self.window).withColumn("n_pages", F.col("n_pages").cast("double")))

    def fit(self, pages: DataFrame) -> Stacked:
        streams.require_streams(pages, labelled=True)
        if self.folds:
            folds, probs = kfold(pages, self.folds, self.seed), None
            for k in range(self.folds):
                held = pages.join(folds.where(F.col("fold") == k), "stream_id", "left_semi")
                if hasattr(self.model, "fit"):
                    self.model.fit(pages.join(folds.where(F.col("fold") != k), "stream_id", "left_semi"))
                part = self.model.predict(held).select(*KEY, "prob")
                probs = part if probs is None else probs.unionByName(part)
        if hasattr(self.model, "fit"):
            later = self.model.fit(pages)
            if not self.folds:
                probs = later.predict(pages).select(*KEY, "prob")
        elif not self.folds:
            probs = self.model.predict(pages).select(*KEY, "prob")
        data = self._rows(probs).join(pages.select(*KEY, F.col("boundary").cast("double").alias("label")), KEY).where("pos >= 1").persist()
        try:
            self.top = LogisticRegression(regParam=1.0 / max(1, data.count()), elasticNetParam=0.0, standardization=False, maxIter=2000).fit(compact(data))
        finally:
            data.unpersist()
        return self

    def predict(self, pages: DataFrame) -> DataFrame:
        if self.top is None:
            raise RuntimeError(f"{self.name} must be fitted first")
        out = self.top.transform(self._rows(self.model.predict(pages).select(*KEY, "prob")))
        probs = out.select(*KEY, F.when(F.col("pos") == 0, 1.0).otherwise(vector_to_array("probability")[1]).alias("prob"))
        return decode.threshold(probs, self.at)


DENSE = ("page", "layout", "position", "cross")
_TREES = {"tfidf-xgb": ("tfidf_xgb", (), 100, 4, 0.1), "tfidf-xgb-rich": ("tfidf_xgb_rich", ("page",), 200, 5, 0.1), "tfidf-xgb-layout": ("tfidf_xgb_layout", DENSE, 300, 6, 0.05)}
_TREES |= {"tfidf-xgb-layout-sem": ("tfidf_xgb_layout_sem", ("page", "layout_pairs", "position", "cross", "embedding_cosine"), 300, 6, 0.05), "tfidf-xgb-all": ("tfidf_xgb_all", ("page", "layout_pairs", "position", "cross", "embedding_cosine", "visual"), 300, 6, 0.05), "minilm-xgb": ("minilm_xgb", ("embedding", "page"), 150, 5, 0.1)}
MODELS = ["trivial:every-page", "trivial:never-split", "text-similarity", *_TREES, "multilingual-minilm", "ensemble:text-sim+tfidf-xgb", "ensemble:text-sim+tfidf-xgb-rich", "ensemble:text-sim+tfidf-xgb-layout", "ensemble:rich+minilm", "viterbi:text-similarity", "viterbi:tfidf-xgb", "viterbi:ensemble", "seq-lr:text-similarity", "oof:tfidf-xgb"]


def build_model(name: str, at: float = 0.5, trees: int | None = None, vocab: int | None = None):
    """A model by its command-line name. trees, vocab: instead of the model's own number of trees and terms."""
    if name == "trivial:every-page":
        return EveryPage()
    if name == "trivial:never-split":
        return NeverSplit()
    if name == "text-similarity":
        return TextSimilarity()
    if name in _TREES:
        own, blocks, n, depth, rate = _TREES[name]
        return PairTrees(own, blocks, vocab or (10_000 if name == "minilm-xgb" else 20_000), trees or n, depth, rate, at if name == "tfidf-xgb-layout" else 0.5)
    if name == "multilingual-minilm":
        return PairLogistic("multilingual_minilm", ("embedding",))
    sub = lambda x: build_model(x, 0.5, trees, vocab)
    if name.startswith("ensemble:text-sim+"):
        return Ensemble(name.replace(":", "_"), [sub("text-similarity"), sub(name.split("+")[1])])
    if name == "ensemble:rich+minilm":
        return Ensemble("ensemble_rich+minilm", [sub("tfidf-xgb-rich"), sub("multilingual-minilm")])
    if name == "viterbi:ensemble":
        return Smoothed(sub("ensemble:text-sim+tfidf-xgb"))
    if name.startswith("viterbi:") and name in MODELS:
        return Smoothed(sub(name.split(":")[1]))
    if name == "seq-lr:text-similarity":
        return Stacked(sub("text-similarity"))
    if name == "oof:tfidf-xgb":
        return Stacked(sub("tfidf-xgb"), folds=3)
    raise ValueError(f"there is no model {name!r}")


@F.arrow_udf(ArrayType(DoubleType()))
def hashed_encoder(text: pa.Array) -> pa.Array:
    """A stand-in for a sentence encoder: 384 signed sums of hashed character 3- to 5-grams of the words, scaled to length 1."""
    out = np.zeros((len(text), 384))
    for row, t in zip(out, text.to_pylist()):
        t = " " + " ".join((t or "").lower().split()) + " "
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                h = zlib.crc32(t[i : i + n].encode())
                row[h % 384] += 1 - 2 * (h >> 31)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 384), pa.array(out.reshape(-1)))


def encode_distinct(pages: DataFrame, encoder=hashed_encoder, column: str = "embedding") -> DataFrame:
    """pages with an embedding of text; encoder is a column function such as a pandas UDF, applied once to each distinct text."""
    known = pages.select(T.truncate(F.col("text")).alias("cut")).distinct().withColumn(column, encoder(F.col("cut")))
    return pages.withColumn("cut", T.truncate(F.col("text"))).join(known, "cut").drop("cut")


def needs_embedding(name: str) -> bool:
    """Whether a model of this name reads a column embedding."""
    return name in ("multilingual-minilm", "ensemble:rich+minilm") or any("embedding" in b for b in _TREES.get(name, ("", ()))[1])


__all__ = ["MODELS", "EveryPage", "Ensemble", "Model", "NeverSplit", "PairLogistic", "PairTrees", "Smoothed", "Stacked", "TextSimilarity", "TrainableModel", "build_model", "encode_distinct", "hashed_encoder", "load_model", "needs_embedding"]
