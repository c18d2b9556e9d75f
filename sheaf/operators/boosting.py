"""Gradient-boosted trees on sparse rows, in numpy: logistic loss, second-order gain, values cut into bins.

A feature that a row lacks (or that is 0) is missing: each split sends missing rows to the side that gains more.
Learning takes all rows, in one barrier stage: each task holds the cells of its features and the gradients of all rows (some 40
bytes a row), finds the best splits among its features, and tells the others its best gains and on which side of a split the rows
are. So what passes between tasks is a bit a row and level. Scoring is an Arrow batch function that every executor runs.
"""

from __future__ import annotations

import pickle
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import exchange

BINS = 32
#: An L2 penalty on leaves, and the least curvature on each side of a split.
PENALTY, LEAST = 1.0, 1.0
#: Each task's features are cut into bins in so many groups, one after another.
GROUPS = 16
#: Cells whose gradients are summed at once.
CELLS = 1 << 20
#: Rows that pay for one more task.
TASK_ROWS = 1000

Gather = Callable[[bytes], list[bytes]]


class Rows:
    """Sparse rows: the cells of row i are start[i] to start[i + 1], each a feature and a value other than 0."""

    def __init__(self, start: np.ndarray, feature: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.value = start, feature, value

    def __len__(self) -> int:
        return len(self.start) - 1


def rows_of(batch: pa.RecordBatch | pa.Table, width: int) -> Rows:
    """Columns idx, val (sparse cells) and dense, whose features come after the width sparse ones."""

    def flat(name: str):
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    idx, n_sparse = flat("idx")
    val, _ = flat("val")
    dense, n_dense = flat("dense")
    owner = np.concatenate([np.repeat(np.arange(len(n_sparse)), n_sparse), np.repeat(np.arange(len(n_dense)), n_dense)])
    place = np.arange(len(dense)) - np.repeat(np.cumsum(n_dense) - n_dense, n_dense)
    feature = np.concatenate([idx.astype(np.int64), width + place])
    value = np.concatenate([val, dense]).astype(np.float64)
    keep = np.flatnonzero((value != 0) & ~np.isnan(value))
    keep = keep[np.argsort(owner[keep], kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(n_sparse)))])
    return Rows(start, feature[keep], value[keep])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .., sizes[0] of them, then starts[1], .."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Cells:
    """The binned cells of some features for all rows, by feature and by row. Groups of features are added one by one."""

    def __init__(self, rows: int):
        self.rows = rows
        self.count = np.zeros(rows, np.int32)
        self._bins: list[tuple[np.ndarray, np.ndarray]] = []  # feature and largest value
        self._columns: list[tuple[np.ndarray, np.ndarray]] = []  # row and bin of cells
        self._first = 0

    def add(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
        """All cells of some features. Bins hold about as many cells each; equal values share a bin, which is that of the first of them."""
        order = np.lexsort((row, value, feature))
        f = feature[order]
        heads = _runs(f)
        size = np.diff(np.append(heads, len(f)))
        # a row's curvature is 1/4 at most, so features of fewer rows can't carry a split
        useful = np.repeat(size >= 4 * LEAST, size)
        order, f = order[useful], f[useful]
        if not len(f):
            return
        heads = _runs(f)
        size = np.diff(np.append(heads, len(f)))
        v = value[order]
        new = np.zeros(len(f), bool)
        new[heads] = True
        level = (np.arange(len(f)) - np.repeat(heads, size)) * BINS // np.repeat(size, size)
        group = np.cumsum(new | np.append(True, v[1:] != v[:-1])) - 1
        first = _runs(group)
        opens = new[first] | np.append(True, level[first][1:] != level[first][:-1])
        place = (np.cumsum(opens) - 1)[group]
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        self._bins.append((f[last], v[last]))
        self._columns.append((row[order].astype(np.int32), (place + self._first).astype(np.int32)))
        self._first += len(last)
        self.count += np.bincount(row[order], minlength=self.rows).astype(np.int32)

    def close(self) -> Cells:
        """Numbers the bins by feature and value, and puts the cells in order of rows."""
        of = np.concatenate([b[0] for b in self._bins]) if self._bins else np.zeros(0, np.int64)
        edge = np.concatenate([b[1] for b in self._bins]) if self._bins else np.zeros(0)
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(of), np.int32)
        rank[order] = np.arange(len(of), dtype=np.int32)
        self.of, self.edge = of[order], edge[order]
        self.heads = _runs(self.of)
        self.sizes = np.diff(np.append(self.heads, len(self.of)))
        self.start = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])
        self.bin = np.empty(self.start[-1], np.int32)
        fill = self.start[:-1].copy()
        self.columns: list[tuple[np.ndarray, np.ndarray]] = []  # by group
        self.column: dict[int, tuple[int, int, int]] = {}  # feature: group, from, to
        for row, place in self._columns:
            place = rank[place]
            feature = self.of[place]
            heads = _runs(feature)
            for f, a, b in zip(feature[heads].tolist(), heads.tolist(), np.append(heads[1:], len(feature)).tolist()):
                self.column[f] = len(self.columns), a, b
            self.columns.append((row, place))
            by_row = np.argsort(row, kind="stable")
            r = row[by_row]
            heads = _runs(r)
            n = np.diff(np.append(heads, len(r)))
            self.bin[_spread(fill[r[heads]], n)] = place[by_row]
            fill[r[heads]] += n
        self._columns, self._bins = [], []
        return self

    def sums(self, slot: np.ndarray, slots: int, weights: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """For each of slots and each bin, the sums of the weights of its rows; rows of slot -1 don't count."""
        bins = len(self.of)
        out = [np.zeros(slots * bins) for _ in weights]
        most = max(CELLS, 2 * slots * bins)
        cuts = [0]
        while cuts[-1] < self.rows:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.start, self.start[cuts[-1]] + most, side="right")) - 1))
        for a, b in zip(cuts, cuts[1:]):
            at, n = slot[a:b], self.count[a:b]
            cell = self.bin[self.start[a] : self.start[b]]
            mine = at >= 0
            if not mine.all():
                cell = cell[np.repeat(mine, n)]
            rows = np.flatnonzero(mine)
            n = n[rows]
            key = cell + np.repeat(at[rows].astype(np.int64) * bins, n)
            for x, w in zip(out, weights):
                found = np.bincount(key, np.repeat(w[a:b][rows], n), minlength=slots * bins)
                x += found
        return [x.reshape(slots, bins) for x in out]

    def best(self, g: np.ndarray, h: np.ndarray, sg: float, sh: float) -> tuple | None:
        """-gain, whether missing rows go left, feature, its bin's number, and the bin's largest value: the least such tuple is the best split.

        Gains are compared in single precision, so that ties don't depend on the order of sums.
        """
        carried = np.add.reduceat(h, self.heads) if len(self.heads) else np.zeros(0)
        keep = np.flatnonzero(carried >= LEAST * (1 - 1e-9))
        if not len(keep):
            return None
        size = self.sizes[keep]
        at = _spread(self.heads[keep], size)
        head = np.cumsum(size) - size
        left = []
        for x in (g[at], h[at]):
            total = np.cumsum(x)
            left.append(total - np.repeat(total[head] - x[head], size))
        lg, lh = left
        end = head + size - 1
        fg, fh = np.repeat(lg[end], size), np.repeat(lh[end], size)  # all rows that have the feature
        rest = sg * sg / (sh + PENALTY)
        found = []
        # missing rows to the right, then to the left; the last bin with missing right separates them alone
        for missing_left, a, b in ((False, lg, lh), (True, fg - lg, fh - lh)):
            gain = a * a / (b + PENALTY) + (sg - a) ** 2 / (sh - b + PENALTY) - rest
            gain = np.where((b >= LEAST) & (sh - b >= LEAST), gain, 0.0).astype(np.float32)
            k = int(gain.argmax())
            bin_ = int(at[k])
            found.append((-float(gain[k]), missing_left, int(self.of[bin_]), bin_, float(self.edge[bin_])))
        return min(found)


class Trees:
    """depth levels of splits in arrays; the children of node k are 2k + 1 and 2k + 2."""

    def __init__(self, trees: int, depth: int, rate: float):
        self.depth, self.rate = depth, rate
        slots = 2 ** (depth + 1) - 1
        self.feature = np.full((trees, slots), -1, np.int64)
        self.cut, self.leaf = np.zeros((trees, slots)), np.zeros((trees, slots))
        self.missing_left = np.zeros((trees, slots), bool)

    def fit(self, rows: Rows, labels: np.ndarray) -> Trees:
        """Learns from rows of this process."""
        cells = Cells(len(rows))
        cells.add(np.repeat(np.arange(len(rows)), np.diff(rows.start)), rows.feature, rows.value)
        return self.grow(cells.close(), labels)

    def grow(self, cells: Cells, labels: np.ndarray, task: int = 0, gather: Gather = lambda message: [message]) -> Trees:
        """Grows each tree level by level on the gradients that the trees before it leave. gather gives the messages of all tasks, in order; task is this one's place."""
        margin = np.zeros(len(labels))
        for t in range(len(self.feature)):
            p = 1 / (1 + np.exp(-margin))
            self._grow(t, cells, p - labels, p * (1 - p), margin, task, gather)
        return self

    def _grow(self, t: int, cells: Cells, g: np.ndarray, h: np.ndarray, margin: np.ndarray, task: int, gather: Gather) -> None:
        nodes, slot = [0], np.zeros(len(g), np.int16)
        sums = [list(x) for x in cells.sums(slot, 1, (g, h))]
        for level in range(self.depth + 1):
            known = slot >= 0
            sg, sh = (np.bincount(slot[known], x[known], minlength=len(nodes)) for x in (g, h))
            chosen = [None] * len(nodes)
            if level < self.depth:
                mine = [cells.best(sums[0][s], sums[1][s], sg[s], sh[s]) if sh[s] >= 2 * LEAST else None for s in range(len(nodes))]
                offers = [pickle.loads(m) for m in gather(pickle.dumps(mine))]
                for s in range(len(nodes)):
                    chosen[s] = min((o[s][:3] + (k,) + o[s][3:] for k, o in enumerate(offers) if o[s] and o[s][0] < -1e-6), default=None)
            leaf = np.zeros(len(nodes) + 1)
            for s, node in enumerate(nodes):
                if chosen[s] is None:
                    leaf[s] = self.leaf[t, node] = -self.rate * sg[s] / (sh[s] + PENALTY)
                else:
                    _, missing_left, feature, _, _, edge = chosen[s]
                    self.feature[t, node], self.cut[t, node], self.missing_left[t, node] = feature, edge, missing_left
            margin += leaf[slot]  # the last is 0, for rows that have met their leaf
            split = [s for s in range(len(nodes)) if chosen[s]]
            if not split:
                return
            left = self._sides(cells, slot, chosen, task, gather)
            child = np.full((len(nodes) + 1, 2), -1, np.int16)
            for k, s in enumerate(split):
                child[s] = 2 * k, 2 * k + 1
            slot = child[slot, 1 - left]
            nodes = [2 * nodes[s] + 1 + side for s in split for side in (0, 1)]
            if level + 1 < self.depth:
                # the smaller child of each pair is summed, the other is what remains of their parent
                size = np.bincount(slot[slot >= 0], minlength=len(nodes)).reshape(-1, 2)
                few = size.argmin(axis=1)
                place = np.full(len(nodes) + 1, -1, np.int16)
                place[2 * np.arange(len(split)) + few] = np.arange(len(split))
                part = cells.sums(place[slot], len(split), (g, h))
                for x in range(2):
                    pairs = zip(few, part[x], (np.subtract(sums[x][s], part[x][k], out=sums[x][s]) for k, s in enumerate(split)))
                    sums[x] = [one for small, own, rest in pairs for one in ((own, rest) if small == 0 else (rest, own))]

    @staticmethod
    def _sides(cells: Cells, slot: np.ndarray, chosen: list, task: int, gather: Gather) -> np.ndarray:
        """1 for rows that go left. The task that has a split's feature knows, and tells the others."""
        winner = np.full(len(chosen) + 1, -1, np.int16)  # a task; the last is for rows in no slot
        missing = np.zeros(len(chosen) + 1, np.int8)
        for s, c in enumerate(chosen):
            if c:
                missing[s], winner[s] = c[1], c[3]
        left, owner = missing[slot], winner[slot]
        for s, c in enumerate(chosen):
            if c and c[3] == task:
                group, a, b = cells.column[c[2]]
                row, place = (x[a:b] for x in cells.columns[group])
                inside = slot[row] == s
                left[row[inside]] = place[inside] <= c[4]
        for k, message in enumerate(gather(np.packbits(left[owner == task]).tobytes())):
            if k != task and message:
                theirs = owner == k
                left[theirs] = np.unpackbits(np.frombuffer(message, np.uint8), count=int(theirs.sum()))
        return left

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities of label 1."""
        used = np.unique(self.feature[self.feature >= 0])
        margin = np.zeros(len(rows))
        if len(used):
            node_feature = np.searchsorted(used, self.feature)
        for at in range(0, len(rows), 2048):
            to = min(at + 2048, len(rows))
            x = np.full((to - at, max(1, len(used))), np.nan)
            if len(used):
                lo, hi = rows.start[at], rows.start[to]
                f = np.minimum(np.searchsorted(used, rows.feature[lo:hi]), len(used) - 1)
                hit = used[f] == rows.feature[lo:hi]
                owner = np.repeat(np.arange(to - at), np.diff(rows.start[at : to + 1]))
                x[owner[hit], f[hit]] = rows.value[lo:hi][hit]
            r = np.arange(to - at)
            for t in range(len(self.feature)):
                node = np.zeros(to - at, np.int64)
                for _ in range(self.depth):
                    split = self.feature[t, node] >= 0
                    if not split.any():
                        break
                    v = x[r, node_feature[t, node] * split]
                    left = np.where(np.isnan(v), self.missing_left[t, node], v <= self.cut[t, node])
                    node = np.where(split, 2 * node + 2 - left, node)
                margin[at:to] += self.leaf[t, node]
        return 1 / (1 + np.exp(-margin))

    def frame(self, spark) -> DataFrame:
        """The trees as rows, for saving."""
        t, k = np.nonzero((self.feature >= 0) | (self.leaf != 0))
        rows = zip(t.tolist(), k.tolist(), self.feature[t, k].tolist(), self.cut[t, k].tolist(), self.missing_left[t, k].tolist(), self.leaf[t, k].tolist())
        return spark.createDataFrame(list(rows), "tree int, node int, feature long, cut double, missing_left boolean, leaf double")

    @staticmethod
    def of(frame: DataFrame, trees: int, depth: int, rate: float) -> Trees:
        made = Trees(trees, depth, rate)
        for r in frame.collect():  # trees * 2 ** (depth + 1) rows at most
            at = r["tree"], r["node"]
            made.feature[at], made.cut[at], made.missing_left[at], made.leaf[at] = r["feature"], r["cut"], r["missing_left"], r["leaf"]
        return made


def scored(features: DataFrame, model: Trees, width: int, *key: str) -> DataFrame:
    """key and prob of rows with the columns idx, val and dense."""
    schema = ", ".join(f"`{k}` {features.schema[k].dataType.simpleString()}" for k in key) + ", prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = model.predict(rows_of(batch, width))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(prob)], names=[*key, "prob"])

    return features.select(*key, "idx", "val", "dense").mapInArrow(run, schema)


def _blocks(width: int, tasks: int):
    """Arrow function: for each batch of rows, their keys and labels to every task, and their cells to the tasks and groups of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            rows = rows_of(batch, width)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            out = [(task, -1, source, number, labels.tobytes(), b"", b"", b"") for task in range(tasks)]
            shelf = rows.feature % tasks * GROUPS + rows.feature // tasks % GROUPS
            order = np.lexsort((rows.feature, shelf))
            shelf, feature = shelf[order], rows.feature[order]
            owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(rows.start))[order]
            value = rows.value[order]
            heads = _runs(feature)
            sizes = np.diff(np.append(heads, len(feature))).astype(np.int32)
            shelves = _runs(shelf)
            for a, b in zip(shelves.tolist(), np.append(shelves[1:], len(shelf)).tolist()):
                x, y = np.searchsorted(heads, (a, b))
                out.append((int(shelf[a]) // GROUPS, int(shelf[a]) % GROUPS, source, number, feature[heads[x:y]].tobytes(), sizes[x:y].tobytes(), owner[a:b].tobytes(), value[a:b].tobytes()))
            for at in range(0, len(out), GROUPS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + GROUPS]), _TYPES)], names=_NAMES)

    return run


_NAMES = ["task", "shelf", "source", "number", "feature", "size", "owner", "value"]
_TYPES = [pa.int32()] * 4 + [pa.binary()] * 4


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[Cells, np.ndarray]:
    """A task's cells, and the labels of all rows, from its blocks in order of shelf, source and number."""
    labels: list[np.ndarray] = []
    before: dict[tuple[int, int], int] = {}
    rows, cells, shelf, parts = 0, None, -1, []

    def flush() -> None:
        if parts:
            cells.add(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()

    for batch in batches:
        for task, at, source, number, feature, size, owner, value in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            if at < 0:  # of all blocks these come first
                before[source, number] = rows
                labels.append(np.frombuffer(feature))
                rows += len(labels[-1])
                continue
            cells = cells or Cells(rows)
            if at != shelf:
                flush()
                shelf = at
            feature = np.repeat(np.frombuffer(feature, np.int64), np.frombuffer(size, np.int32))
            parts.append((np.frombuffer(owner, np.int32) + np.int32(before[source, number]), feature, np.frombuffer(value)))
    cells = cells or Cells(rows)
    flush()
    return cells.close(), np.concatenate(labels) if labels else np.zeros(0)


def _slots(spark) -> int:
    """How many tasks can run at once."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def learned(features: DataFrame, model: Trees, width: int, rows: int, tasks: int | None = None) -> Trees:
    """model, learned from all rows: columns stream_id, pos, idx, val, dense and label. rows: about how many there are.

    tasks: how many work at once, by default one for each TASK_ROWS rows and no more than can run.
    """
    tasks = tasks or min(_slots(features.sparkSession), max(1, rows // TASK_ROWS))
    # whole streams, in order: a repeated task gives the same blocks
    parts = max(1, min(4096, rows // 5000))
    ordered = features.select("stream_id", "pos", "idx", "val", "dense", "label").repartition(parts, "stream_id").sortWithinPartitions("stream_id", "pos")
    blocks = ordered.mapInArrow(_blocks(width, tasks), "task int, shelf int, source int, number int, feature binary, size binary, owner binary, value binary")
    mine = blocks.repartitionById(tasks, "task").sortWithinPartitions("shelf", "source", "number")

    at = f"{exchange.folder(features.sparkSession)}/trees-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, labels = _received(batches)
        if tasks == 1:
            model.grow(cells, labels)
        else:
            others = exchange.Exchange(at)
            if len(set(others.gather(b"%d %d" % (len(labels), zlib.crc32(labels.tobytes()))))) > 1:
                raise RuntimeError("the tasks have different rows")
            model.grow(cells, labels, others.task, others.gather)
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    try:
        return pickle.loads(mine.mapInArrow(run, "model binary", barrier=tasks > 1).collect()[0]["model"])
    finally:
        shutil.rmtree(at, ignore_errors=True)
