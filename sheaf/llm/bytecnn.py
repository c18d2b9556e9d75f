"""Quality classifier: a byte-level convolutional network in numpy.

A chunk's filters are of two kinds, learned together: linear ones over the learned values of 16
bytes, and lag filters, which weigh how much the learned echo values of bytes agree with those 2 to
16 bytes before. Chunks start every 8 bytes, overlap and cover the whole document; their filters' sums are rectified and
max-pooled over the document, and a logistic layer makes one probability of them. Trained by Adam;
only the chunks that win a maximum pass a gradient on.

Defined results: a null or empty text is scored as 16 zero bytes; without labelled rows, or with
labels of one kind only, every score is their share (0.5 without any). Equal texts get equal scores,
whatever stands beside them: nothing reaches over a document's ends, and sums are exact.
Repeated rows and rows without a doc_id are scored each; an empty table gives an empty result. The input's other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Texts, chunks, texts_of

WIDTH, STRIDE, EMBED, FILTERS = 16, 8, 6, 24
LAGS = np.arange(2, 17)
SPAN, ECHO, REACH = 32, 3, 16  # bytes a lag filter looks at, values of each, bytes it reaches back
NOTHING = 256  # stands before each document; its values are 0
TILE = 4096  # chunks of one matrix product
#: What weights are rounded to, and clipped at, after training. Sums of their products are exact then, in any order.
GRID = {"embed": (2**-6, 4), "filters": (2**-8, 2), "echo": (2**-5, 4), "lags": (2**-8, 4), "bias": (2**-14, 64)}


class Chunks:
    """Documents cut in chunks: flat has REACH times NOTHING before each document, its bytes, then zeros up to its last chunk's end.

    A document of n bytes has the chunks that start at 0, 8, .. and reach its last byte.
    """

    def __init__(self, texts: Texts):
        n = np.maximum(1, -(-(np.maximum(texts.lens, 1) - WIDTH) // STRIDE) + 1)
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        ends = np.cumsum((n - 1) * STRIDE + WIDTH + REACH)
        begin = np.concatenate([[0], ends[:-1]]) + REACH
        self.flat = np.zeros(ends[-1], np.uint16)
        self.flat[(begin[:, None] - REACH + np.arange(REACH)).reshape(-1)] = NOTHING
        self.flat[np.repeat(begin - texts.bounds[:-1], texts.lens) + np.arange(len(texts.data))] = texts.data
        self.start = np.repeat(begin - self.first[:-1] * STRIDE, n) + np.arange(n.sum()) * STRIDE
        self.size = np.minimum(self.start + SPAN, np.repeat(ends, n)) - self.start

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, rows: np.ndarray | slice) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.flat, WIDTH)[self.start[rows]]

    def echoes(self, values: np.ndarray) -> np.ndarray:
        """Chunks by lags: the mean agreement of the bytes of a span with those so far before."""
        e = values[self.flat]
        blocks = len(self.flat) // STRIDE
        lo, hi = self.start // STRIDE, (self.start + self.size) // STRIDE
        total = np.zeros((blocks + SPAN // STRIDE, len(LAGS)), np.float32)
        width = STRIDE * ECHO
        for at in range(0, blocks, 4096):  # a part stays in the cache for all lags
            to = min(at + 4096, blocks)
            own = e[at * STRIDE : to * STRIDE].reshape(-1, width)
            skip = -(-REACH // STRIDE) if at == 0 else 0  # nothing stands there
            for j, lag in enumerate(LAGS):
                total[at + skip : to, j] = np.einsum("ij,ij->i", own[skip:], e[(at + skip) * STRIDE - lag : to * STRIDE - lag].reshape(-1, width))
        out = np.zeros((len(self), len(LAGS)), np.float32)
        for k in range(SPAN // STRIDE):
            out += total[lo + k] * (lo + k < hi)[:, None]
        return out / self.size[:, None].astype(np.float32)


class ByteCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.w = {"embed": f(NOTHING + 1, EMBED, scale=0.5), "filters": f(WIDTH * EMBED, FILTERS, scale=0.1), "echo": f(NOTHING + 1, ECHO, scale=0.6), "lags": f(len(LAGS), FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32), "out": f(FILTERS, scale=0.2), "base": np.zeros(1, np.float32)}
        self.w["echo"][NOTHING] = 0
        self.fixed: float | None = None

    def responses(self, made: Chunks, echoes: np.ndarray, kind: type) -> np.ndarray:
        """Chunks by filters, rectified."""
        w, z = self.w, np.empty((len(made), FILTERS), kind)
        lags, bias = w["lags"].astype(kind), w["bias"].astype(kind)
        for at in range(0, len(made), TILE):
            x = w["embed"][made.windows(slice(at, at + TILE))].reshape(-1, WIDTH * EMBED)
            z[at : at + TILE] = x @ w["filters"] + (echoes[at : at + TILE].astype(kind) @ lags + bias)
        return np.maximum(z, 0, out=z)

    def score(self, texts: Texts) -> np.ndarray:
        if self.fixed is not None or len(texts) == 0:
            return np.full(len(texts), self.fixed or 0.0)
        made = Chunks(texts)
        echoes = np.rint(made.echoes(self.w["echo"]) * 256) / 256
        top = np.maximum.reduceat(self.responses(made, echoes, np.float64), made.first[:-1], axis=0)
        total = (top * self.w["out"].astype(float)).sum(1) + float(self.w["base"][0])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def _echo_gradient(self, made: Chunks, rows: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of the echo values, given those of chunks' lag means (back: rows by lags)."""
        at = made.start[rows][:, None] + np.arange(-REACH, SPAN)
        there = np.arange(-REACH, SPAN) < made.size[rows][:, None]
        byte = np.where(there, made.flat[np.minimum(at, len(made.flat) - 1)], NOTHING)
        scale = back / made.size[rows][:, None].astype(np.float32)
        out = np.zeros_like(self.w["echo"])
        for k in range(ECHO):
            e = self.w["echo"][:, k][byte]
            d = np.zeros_like(e)
            for j, lag in enumerate(LAGS):
                s = scale[:, j, None]
                early = slice(REACH - lag, REACH - lag + SPAN)
                d[:, REACH:] += s * e[:, early]
                d[:, early] += s * e[:, REACH:]
            out[:, k] = np.bincount(byte.reshape(-1), weights=d.reshape(-1), minlength=NOTHING + 1)
        out[NOTHING] = 0
        return out

    def _gradient(self, made: Chunks, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss. Documents that are decided already hardly count, and pass none to the filters."""
        w = self.w
        echoes = made.echoes(w["echo"])
        z = self.responses(made, echoes, np.float32)
        top = np.maximum.reduceat(z, made.first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(top @ w["out"] + w["base"], -30, 30)))
        d = (p - labels).astype(np.float32) * weight / len(labels)
        g = {"out": top.T @ d + 1e-4 * w["out"], "base": d.sum(keepdims=True)}
        docs = np.flatnonzero(np.abs(d) > 0.01 * np.abs(d).max())
        b = (d[docs, None] * w["out"] * (top[docs] > 0)).reshape(-1)
        chunk = np.concatenate([made.first[i] + z[made.first[i] : made.first[i + 1]].argmax(0) for i in docs])
        used = np.flatnonzero(b)
        chunk, k, b = chunk[used], np.tile(np.arange(FILTERS), len(docs))[used], b[used]
        byte = made.windows(chunk)
        x = w["embed"][byte].reshape(-1, WIDTH * EMBED)
        pick = np.zeros((len(b), FILTERS), np.float32)
        pick[np.arange(len(b)), k] = b
        g["filters"], g["lags"], g["bias"] = x.T @ pick, echoes[chunk].T @ pick, pick.sum(0)
        back = (pick @ w["filters"].T).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(byte.reshape(-1), weights=back[:, j], minlength=NOTHING + 1) for j in range(EMBED)], 1)
        g["echo"] = self._echo_gradient(made, chunk, pick @ w["lags"].T)
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, least_steps: int = 250, batch: int = 32, rate: float = 0.01, seed: int = 3) -> ByteCnn:
        """epochs over the texts, or as many as make least_steps steps."""
        if len(labels) == 0 or labels.min() == labels.max():
            self.fixed = float(labels.mean()) if len(labels) else 0.5
            return self
        r, w = np.random.default_rng(seed), self.w
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        share, step = labels.mean(), 0
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        epochs = max(epochs, -(-least_steps * batch // len(texts)))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                some = [texts[i] for i in rows]
                made = Chunks(Texts(np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])])))
                g = self._gradient(made, labels[rows], weight[rows])
                step += 1
                now = rate * (1 - epoch / epochs)
                for name, v in w.items():
                    m, s = moments[name]
                    m += 0.1 * (g[name] - m)
                    s += 0.01 * (g[name] ** 2 - s)
                    v -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        # the weighting above moved the odds; this puts them back to the labels' own share
        w["base"] += np.float32(np.log(share / (1 - share)))
        for name, (grid, most) in GRID.items():
            w[name] = (np.rint(np.clip(w[name], -most, most) / grid) * grid).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, most_docs: int = 1500, most_bytes: int = 12 << 20) -> ByteCnn:
    """Learns from docs (doc_id, text) and labels (doc_id, quality).

    A bounded sample: the most_docs labelled documents of lowest hash, half of each kind where both have so many, with whole
    texts. Each kind has half of most_bytes; a document that doesn't fit into what is left of it is passed over. Of a
    kind of which none fits, the smallest is taken. Warns if no text has a label of one kind, though there are such labels.
    """
    few = None
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    for kind in (0, 1):
        part = labels.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs // 2)
        few = part if few is None else few.unionByName(part)
    ids = {r["doc_id"]: r["quality"] for r in few.collect()}
    if not ids:
        return ByteCnn().fit([], np.zeros(0))
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(list(ids.items()), "doc_id long, quality int"))  # most_docs rows at most
    got = docs.select("doc_id", "text").join(few, "doc_id").withColumn("h", F.xxhash64("doc_id")).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    sizes = got.groupBy("h", "doc_id", "quality").agg(F.sum(F.col("size") + WIDTH).alias("size")).collect()  # most_docs rows at most
    keep = []
    for kind in sorted(set(ids.values())):
        own, left = sorted((r["h"], r["doc_id"], r["size"]) for r in sizes if r["quality"] == kind), most_bytes // 2
        if not own:
            warnings.warn(f"no document has one of the labels {kind}", stacklevel=2)
        elif min(size for _, _, size in own) > left:
            keep.append(min(own, key=lambda r: r[2])[1])
        else:
            for _, doc_id, size in own:
                if size <= left:
                    keep.append(doc_id)
                    left -= size
    rows = got.where(F.col("doc_id").isin(keep)).select("doc_id", "text").toArrow().sort_by("doc_id")
    texts = texts_of(rows.column("text"))
    return ByteCnn().fit([texts.one(i) for i in range(len(texts))], np.array([ids[i] for i in rows.column("doc_id").to_pylist()], np.float32))


def score_quality(docs: DataFrame, model: ByteCnn, threshold: float = 0.3) -> DataFrame:
    """docs' doc_id with score (the probability of label 1) and predicted (1 from threshold on)."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20, 5_000):
                score = model.score(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: ByteCnn, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, that score threshold at least."""
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20, 5_000):
                yield part.filter(pa.array(model.score(texts_of(part.column(column))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
