"""Quality rules: an isolation forest on rule statistics.

`statistics` counts what the rules look at. A text fails the base rules with fewer than 20 words or
with over 30 % of its words in 8-word windows that come twice. Of the others, a forest of random
splits isolates the unusual ones in few steps. As the method has it, a tree draws the few rows
that its splits are made on, from all documents; how many documents a leaf holds is counted over
all of them. The threshold on the anomaly score is set on all labelled rows: of those that reject
MOST_LOST of the good rows at most, the one that tells the labels apart best.

Defined results: a null or empty text has no words and fails the base rules; without labelled rows
of both kinds nothing but the base rules rejects; equal texts get equal results, whatever their
rows hold else; repeated rows, and rows without a doc_id, have a result each, though a doc_id is learned from
once; an empty table gives an empty result; the input's other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import scratch, written
from ._text import BYTE_KEYS, ODD, Texts, Words, chunks, covered, mix, powers, texts_of, window_hashes

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, DIGIT, POINT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91], DIGIT[48:58] = True, True
POINT[list(b"!?,.;:")] = True
MOST_LOST = 0.005
TREES, ROWS = 100, 256
FEATURES = 9
#: Sets of features and rows a tree is grown on, from which the labelled rows choose.
FORESTS = [(columns, rows) for columns in ((0, 1, 2, 3, 4, 5, 6, 7, 8), (1, 2, 3), (2, 3), (2, 3, 5), (2, 3, 4, 5), (1, 3, 6, 8), (6, 8), (4, 5)) for rows in (64, 256)]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _seen_before(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key stood earlier in the same text, and whether it stands there twice at all."""
    both = keys ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return before, twice


def statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features, a row for each text."""
    n, data, bounds = len(texts), texts.data, texts.bounds
    words = Words(texts)
    letters = _per_text(((data & 0xC0) != 0x80) & ~np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8)), bounds)
    symbols = _per_text(SYMBOL[data], bounds)
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(bounds[:-1][texts.lens > 0], breaks + 1)
    begin = begin[begin < len(data)]
    dup_lines, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(begin):
        owner = np.searchsorted(bounds, begin, side="right") - 1
        size = np.diff(np.append(begin, len(data)))
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), size)
        values = np.where(data == 10, np.uint64(0), BYTE_KEYS[data])
        values *= powers(int(ODD), int(size.max()))[place]
        keys = mix(np.add.reduceat(values, begin))
        used = np.diff(np.searchsorted(words.start, np.append(begin, len(data)))) > 0
        owner, keys = owner[used], keys[used]
        before, _ = _seen_before(owner, keys)
        dup_lines, lines = np.bincount(owner[before], minlength=n), np.bincount(owner, minlength=n)
        del values, place
    hashes = words.hashes()
    windows = window_hashes(hashes, 8)
    repeat = np.zeros(n, np.int64)
    if len(windows):
        at = np.flatnonzero(words.doc[7:] == words.doc[: len(words.doc) - 7])
        _, twice = _seen_before(words.doc[at], windows[at])
        repeat = np.bincount(words.doc[covered(at[twice], 8, len(hashes))], minlength=n)
    counts = np.stack([words.count, letters, symbols, dup_lines, repeat], 1).astype(np.int64)
    w, size = np.maximum(words.count, 1), np.maximum(texts.lens, 1)
    features = np.stack([np.log1p(words.count), letters / w, np.log1p(symbols) / np.log1p(w), symbols / w, dup_lines / np.maximum(lines, 1), repeat / w, _per_text(UPPER[data], bounds) / size, _per_text(DIGIT[data], bounds) / size, _per_text(POINT[data], bounds) / w], 1)
    return counts, features


class Forest:
    """Isolation trees, as arrays of equal size over all trees. Each splits `rows` rows of its own, as far as there are so many; `weigh` sets the path lengths."""

    def __init__(self, sample: np.ndarray, columns: tuple[int, ...], trees: int = TREES, rows: int = ROWS, seed: int = 11):
        r = np.random.default_rng(seed)
        self.columns, sample = list(columns), sample[:, list(columns)]
        self.size = min(rows, len(sample))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        slots = 2 ** (self.depth + 1)
        self.axis, self.cut, self.path = np.full((trees, slots), -1), np.zeros((trees, slots)), np.zeros((trees, slots))
        order = r.permutation(len(sample))
        for t in range(trees):
            if len(sample) >= (t + 1) * rows:
                x = sample[order[t * rows : (t + 1) * rows]]
            else:
                x = sample[r.permutation(len(sample))[:rows]]
            self._grow(t, 1, x, 0, r)
        self.norm = max(self._average(self.size), 1e-9)

    @staticmethod
    def _average(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, slot: int, x: np.ndarray, level: int, r) -> None:
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if level >= self.depth or not len(spread):
            return
        k = int(r.choice(spread))
        cut = r.uniform(x[:, k].min(), x[:, k].max())
        self.axis[t, slot], self.cut[t, slot] = k, cut
        self._grow(t, 2 * slot, x[x[:, k] < cut], level + 1, r)
        self._grow(t, 2 * slot + 1, x[x[:, k] >= cut], level + 1, r)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The rows' leaves, tree by tree."""
        x, rows = x[:, self.columns], np.arange(len(x))
        for axis, cut in zip(self.axis, self.cut):
            slot = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                a = axis[slot]
                slot = np.where(a < 0, slot, 2 * slot + (x[rows, np.maximum(a, 0)] >= cut[slot]))
            yield slot

    def weigh(self, counts: np.ndarray) -> None:
        """Path lengths by the number of all documents in each leaf; their share stands for so many of a tree's rows."""
        level = np.frexp(np.arange(counts.shape[1]))[1] - 1
        size = counts * (self.size / counts.sum(1, keepdims=True))
        self.path = level + np.interp(size, range(self.size + 1), [self._average(n) for n in range(self.size + 1)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: higher, the fewer splits isolate a row."""
        total = np.zeros(len(x))
        for path, slot in zip(self.path, self.leaves(x)):
            total += path[slot]
        return 2.0 ** (-total / len(self.axis) / self.norm)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def fit_rules(docs: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """A forest and its threshold, from the documents that pass the base rules, one row a doc_id.

    Each tree splits ROWS of them, drawn by hash from all: TREES * ROWS as an expected number, or all where there are fewer;
    only these reach the driver. All documents are counted in the leaves of each forest, and all labelled ones are scored by
    each and set its threshold; both are aggregates.
    """
    with scratch():
        return _fit(docs, labels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                counts, features = statistics(texts_of(part.column(1)))
                passed = ~base_failed(counts)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).filter(pa.array(passed)), pa.array(list(features[passed]), pa.list_(pa.float64()))], names=["doc_id", "features"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(measure, "doc_id long, features array<double>")
    rows = rows.groupBy("doc_id").agg(F.max("features").alias("features")).join(labels, "doc_id", "left")
    rows = written(rows.select("doc_id", "features", F.coalesce("quality", F.lit(-1)).alias("quality")), "statistics")
    sizes = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if not {0, 1} <= set(sizes):
        return None, 1.0
    n, span = sum(sizes.values()), 2**31
    cut = span if n <= TREES * ROWS else int(span * TREES * ROWS / n)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("tree")), F.lit(span)) < cut).select("doc_id", "features").toPandas().sort_values("doc_id")
    sample = np.stack(drawn.features.to_list())
    forests = [Forest(sample, columns, rows=size) for columns, size in FORESTS]
    _weigh(forests, rows)
    k, threshold = _choose(forests, rows, sizes[0], sizes[1])
    return forests[k], threshold


def _weigh(forests: list[Forest], rows: DataFrame) -> None:
    """Counts all rows in the leaves of every tree."""
    bounds = np.cumsum([0, *(f.axis.size for f in forests)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bounds[-1], np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for forest, at in zip(forests, bounds):
                slots = forest.axis.shape[1]
                for t, slot in enumerate(forest.leaves(x)):
                    total[at + t * slots : at + (t + 1) * slots] += np.bincount(slot, minlength=slots)
        leaf = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total[leaf])], names=["leaf", "n"])

    got = rows.select("features").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(bounds[-1], np.int64)
    total[got.column("leaf").to_numpy()] = got.column("n").to_numpy()
    for forest, at in zip(forests, bounds):
        forest.weigh(total[at : at + forest.axis.size].reshape(forest.axis.shape))


def _choose(forests: list[Forest], rows: DataFrame, n_bad: int, n_good: int) -> tuple[int, float]:
    """Number and threshold of the forest that tells all labelled rows apart best, the first of equal ones, with the lowest threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            for k, forest in enumerate(forests):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(forest.score(x)), batch.column(1).cast(pa.int64())], names=["forest", "score", "quality"])

    scored = rows.where("quality >= 0").select("features", "quality").mapInArrow(score, "forest int, score double, quality long")
    levels = scored.groupBy("forest", "score").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    above = Window.partitionBy("forest").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("forest", "score", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("good", "bad")))
    most = n_good - 1 - int(np.ceil((n_good - 1) * (1 - MOST_LOST)))
    gain = F.col("bad") / n_bad - F.col("good") / n_good
    best = levels.where(F.col("good") <= most).orderBy(gain.desc(), "forest", "score").first()
    return best["forest"], best["score"]


def apply_rules(docs: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """doc_id, the counts of every text, its anomaly score and the verdicts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2 << 20, 5_000):
                counts, features = statistics(texts_of(part.column(1)))
                failed = base_failed(counts)
                score = forest.score(features) if forest else np.zeros(len(failed))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score <= threshold)), pa.array(score)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")
