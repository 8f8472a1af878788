"""Regression trees over tables of any size.

MLlib looks at all open nodes of a level in every task: a forest of 100 trees of depth 15 sends the sums of millions of nodes
with a handful of rows each, from every task of every pass. Here the rows are put into bins once, in blocks, and

* a node with more than ``LOCAL_ROWS`` rows is split from sums that the tasks send, one set per node and task;
* the rows of a smaller node are sent to one task, which grows the rest of that branch.

So what is sent grows with the rows and the trees, whatever the depth. Boosted trees have few nodes and are split from
sums alone. The law is MLlib's: at most 32 bins by quantiles of a sample of at least 10,000 rows, the split of greatest gain in
variance, Poisson weights for bagging, squared loss, means in the leaves, importances by gain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from math import exp, factorial, prod
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyra.plans.tables import write_out

BINS = 32
SAMPLE_ROWS = 10_000
#: Rows of a block: large ones hold many rows of a node.
BLOCK_ROWS = {"random_forest": 131_072, "boosted_trees": 131_072}
#: The most rows, with repeats, of a node that one task grows to its end.
LOCAL_ROWS = 2_000_000
#: Bytes of sums that a task holds in a pass, and of rows that are on their way to their tasks at once, in so many jobs.
SUM_BYTES, WAVE_BYTES, WAVES = 64 << 20, 3 << 30, 2
#: The most tasks that grow branches in a job.
MOST_BRANCHES = 1024
#: Nodes of one tree whose sums travel together.
CHUNK = 64
#: Boosted trees after which the running predictions are made from the blocks again, which cuts their lineage.
ANCHOR = 5
#: The most joint bins of features that are counted together, and the rows of a node from which on that pays.
JOINT, JOINT_ROWS = 1024, 1_200
#: Nodes of a branch that are grown together, and nodes and rows whose sums stay in the cache of a core.
BRANCH_NODES, CACHED_NODES, CACHED_ROWS = 256, 16, 65_536
#: The share of the rows that a tree draws at least once.
DRAWN = 1 - exp(-1)
#: A gain that is a smaller part of the squares of a node is rounding.
LEAST_SHARE = 1e-12

BLOCKS = "block long, bins binary, label binary"
SUMS = "tree int, lo int, part int, sums binary"
ROWS = "place int, tree int, node long, block long, bins binary, label binary, weight binary"
BRANCH = "tree int, ids binary, feature binary, cut binary, value binary, importance binary"


@dataclass
class Tree:
    """Nodes in the order of their heap numbers (1, then 2i and 2i + 1). A leaf leads to itself."""

    ids: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(ids, feature, cut, value) -> Tree:
        order = np.argsort(ids)
        ids, feature, cut = np.asarray(ids, np.int64)[order], np.asarray(feature, np.int16)[order], np.asarray(cut, np.uint8)[order]
        inner = feature >= 0
        left = np.where(inner, np.searchsorted(ids, 2 * ids), np.arange(len(ids)))
        cut = np.where(inner, cut, np.uint8(255))  # no bin is higher
        return Tree(ids, feature, cut, np.asarray(value, np.float64)[order], left.astype(np.int32))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node, by position, where each row ends."""
        flat, rows = bins.reshape(-1), np.arange(bins.shape[1])
        start, left = np.maximum(self.feature, 0).astype(np.intp) * len(rows), self.left.astype(np.intp)
        at = np.zeros(len(rows), np.intp)
        for _ in range(int(self.ids[-1]).bit_length() - 1):
            cell = start.take(at)
            cell += rows
            right = flat.take(cell) > self.cut.take(at)
            at = left.take(at)
            at += right
        return at


# ------------------------------------------------------------------ rows in blocks


def cut_points(rows: DataFrame, seed: int, total: int) -> list[np.ndarray]:
    """At most ``BINS - 1`` thresholds of each feature, between values, by quantiles; all of them if values are few."""
    some = rows if total <= SAMPLE_ROWS else rows.sample(min(1.0, SAMPLE_ROWS / total), seed)
    values = some.select(vector_to_array("features").alias("v")).toArrow()["v"].combine_chunks()
    made = np.sort(values.flatten().to_numpy().reshape(len(values), -1), axis=0)
    return [_thresholds(made[:, f]) for f in range(made.shape[1])]


def _thresholds(ordered: np.ndarray) -> np.ndarray:
    values, counts = np.unique(ordered, return_counts=True)
    middles = (values[:-1] + values[1:]) / 2
    if len(values) <= BINS:
        return middles
    stride = len(ordered) / BINS
    target, before, kept = stride, counts[0], []
    for i in range(1, len(values)):
        now = before + counts[i]
        if abs(before - target) < abs(now - target):
            kept.append(middles[i - 1])
            target += stride
        before = now
    return np.array(kept[: BINS - 1])


def in_bins(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A row of bins for each feature; a value up to ``cuts[k]`` lies in bin ``k`` or below."""
    return np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], size: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bins, labels, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            bins.append(in_bins(values, cuts))
            labels.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= size:
                yield _block(number, np.concatenate(bins, axis=1), np.concatenate(labels))
                number, bins, labels, held = number + 1, [], [], 0
        if held:
            yield _block(number, np.concatenate(bins, axis=1), np.concatenate(labels))

    return rows.select(vector_to_array("features").alias("v"), "label").mapInArrow(build, BLOCKS)


def _block(number: int, bins: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": number, "bins": bins.tobytes(), "label": label.tobytes()}], _arrow(BLOCKS))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``number, bins, label`` of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            number, bins, label = (batch.column(c)[i] for c in range(3))
            label = np.frombuffer(label.as_buffer(), np.float64)
            yield number.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(label)), label


# ------------------------------------------------------------------ splits


def best_splits(cells: np.ndarray, totals: np.ndarray, least: int) -> tuple:
    """``feature, cut, gain, left count, left sum`` of nodes from ``cells``, counts and sums by (node, feature, bin); feature -1
    if none gains. ``totals`` are the count, sum and sum of squares of each node."""
    n, t, q = totals
    nodes = cells.shape[1]
    top, place, left_n, left_t = np.empty(nodes), np.empty(nodes, np.int64), np.empty(nodes), np.empty(nodes)
    for lo in range(0, nodes, CACHED_NODES):
        some = slice(lo, lo + CACHED_NODES)
        c, s = cells[0, some].cumsum(2), cells[1, some].cumsum(2)
        rest, other = n[some, None, None] - c, t[some, None, None] - s
        ruled_out = (c < least) | (rest < least)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = s * s
            score /= c
            other *= other
            other /= rest
            score += other
        score[ruled_out] = -np.inf
        score = score.reshape(len(score), -1)
        at = (score >= (score.max(1) - LEAST_SHARE * q[some])[:, None]).argmax(1)  # of equal ones the first, as if without rounding
        rows = np.arange(len(score))
        top[some], place[some] = score[rows, at], at
        left_n[some], left_t[some] = (x.reshape(len(score), -1)[rows, at] for x in (c, s))
    base = t * t / np.maximum(n, 1)
    # no split gains more than the squares about the mean, which the sums of a cell may hide in their rounding
    gains = (top - base > LEAST_SHARE * q) & (q - base > LEAST_SHARE * q)
    with np.errstate(invalid="ignore"):
        gain = np.where(gains, (top - base) / np.maximum(n, 1), 0.0)
    return np.where(gains, place // BINS, -1), place % BINS, gain, left_n, left_t


def packs(n_cuts: list[int]) -> list[list[int]]:
    """The features that have cuts in groups of at most ``JOINT`` joint bins."""
    made: list[list[int]] = []
    for f in sorted((f for f, k in enumerate(n_cuts) if k), key=lambda f: -n_cuts[f]):
        fits = (g for g in made if prod(n_cuts[x] + 1 for x in g) * (n_cuts[f] + 1) <= JOINT)
        if (group := next(fits, None)) is None:
            made.append([f])
        else:
            group.append(f)
    return made


class _Cells:
    """Rows of bins, of which counts and sums are made for any rows and nodes. ``single`` are the bins of each feature and ``joint``
    those of each pack, both by (feature, row)."""

    def __init__(self, bins: np.ndarray, n_cuts: list[int]):
        self.single, self.n_cuts, self.packs = bins, n_cuts, packs(n_cuts)
        self.joint = np.empty((len(self.packs), bins.shape[1]), np.uint16)
        for code, group in zip(self.joint, self.packs):
            code[:] = bins[group[0]]
            for f in group[1:]:
                code *= np.uint16(n_cuts[f] + 1)
                code += bins[f]

    def taken(self, rows: np.ndarray, many: bool) -> Iterator[np.ndarray]:
        return (x.take(rows) for x in (self.joint if many else self.single))

    def summed(self, rows: np.ndarray, at: np.ndarray, weight: np.ndarray | None, value: np.ndarray, nodes: int) -> np.ndarray:
        """Counts and sums by (node, feature, bin) of ``rows``; the other three go with them. Without ``weight`` a row counts once.

        A node of many rows is counted by joint bins of several features, which are then added up for each: one pass over the
        rows for all features of a pack."""
        made = np.zeros((2, nodes, len(self.n_cuts), BINS))
        for lo in range(0, len(rows), CACHED_ROWS):
            some = slice(lo, lo + CACHED_ROWS)
            first = at[some].min()
            here = at[some] - first
            m = int(here.max()) + 1
            part = made[:, first : first + m]
            many = len(here) >= JOINT_ROWS * m
            values = (None if weight is None else weight[some], value[some])
            base: dict[int, np.ndarray] = {}
            for group, code in zip(self.packs if many else [[f] for f in range(len(self.n_cuts))], self.taken(rows[some], many)):
                if not self.n_cuts[group[0]]:
                    continue
                widths = [self.n_cuts[f] + 1 for f in group]
                size = prod(widths)
                if m == 1:
                    cell = code.astype(np.intp)
                else:
                    if size not in base:
                        base[size] = here * size
                    cell = base[size] + code
                for i, v in enumerate(values):
                    joint = np.bincount(cell, v, m * size).reshape(m, *widths)
                    for j, f in enumerate(group):
                        part[i, :, f, : widths[j]] += joint.sum(tuple(x + 1 for x in range(len(group)) if x != j)) if many else joint
        return made


class _RowCells(_Cells):
    """The same with the bins of a row side by side, for rows that are no neighbours."""

    def __init__(self, bins: np.ndarray, n_cuts: list[int]):
        super().__init__(bins, n_cuts)
        self.single, self.joint = np.ascontiguousarray(self.single.T), np.ascontiguousarray(self.joint.T)

    def of(self, rows: np.ndarray) -> _RowCells:
        made = copy(self)
        made.single, made.joint = self.single.take(rows, axis=0), self.joint.take(rows, axis=0)
        return made

    def taken(self, rows: np.ndarray, many: bool) -> Iterator[np.ndarray]:
        return iter((self.joint if many else self.single).take(rows, axis=0).T)


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, root: int, levels: int, n_cuts: list[int], least: int) -> tuple:
    """``ids, feature, cut, value, importance`` of the branch below ``root`` over the rows given.

    The rows of a node lie together. Of two children the one with fewer rows is counted; the other has what is left of its
    parent's sums. Nodes of a level go on together, up to a number of nodes and rows; the others wait."""
    value = weight * label
    found, importance = [], np.zeros(len(n_cuts))
    waiting: list[tuple] = []

    def go_on(ids, rows, sizes, totals, level, data, cells_for) -> None:
        """Record what stays a leaf, and let the others wait with their cells."""
        n, t, q = totals
        may = (n >= 2 * least) & (q - t * t / n > LEAST_SHARE * q) & (level < levels)
        leaf = ~may
        found.append((ids[leaf], np.full(leaf.sum(), -1), np.zeros(leaf.sum(), np.int64), t[leaf] / n[leaf]))
        if not may.any():
            return
        cells = cells_for(may)
        if leaf.any():
            rows = rows[np.repeat(may, sizes)]
            ids, sizes, totals = ids[may], sizes[may], totals[:, may]
        ends = sizes.cumsum()
        hi = 0
        while hi < len(ids):
            lo, start = hi, ends[hi] - sizes[hi]
            hi = min(lo + BRANCH_NODES, max(lo + 1, int(np.searchsorted(ends, start + CACHED_ROWS, "right"))))
            waiting.append((ids[lo:hi], rows[start : ends[hi - 1]], sizes[lo:hi], totals[:, lo:hi], level, data, cells[:, lo:hi]))

    data = _RowCells(bins, n_cuts), weight, value, value * label
    everything = np.arange(len(label))
    go_on(
        np.array([root], np.int64), everything, np.array([len(label)]), np.array([[x.sum()] for x in data[1:]]), 0, data,
        lambda may: data[0].summed(everything, np.zeros(len(label), np.intp), weight, value, 1),
    )
    while waiting:
        ids, rows, sizes, totals, level, data, cells = waiting.pop()
        feature, cut, gain, _, _ = best_splits(cells, totals, least)
        found.append((ids, feature, cut, totals[1] / totals[0]))
        split = feature >= 0
        np.add.at(importance, feature[split], (gain * totals[0])[split])
        if not split.any():
            continue
        if not split.all():
            rows = rows[np.repeat(split, sizes)]
            ids, sizes, cells, feature, cut = ids[split], sizes[split], cells[:, split], feature[split], cut[split]
        if 4 * len(rows) < len(data[1]):  # few of the rows at hand: bring them together
            data, rows = (data[0].of(rows), *(x.take(rows) for x in data[1:])), np.arange(len(rows))
        m, single = len(ids), data[0].single
        bin_at = single.reshape(-1).take(np.repeat(feature, sizes) + single.shape[1] * rows)
        right = bin_at > np.repeat(cut.astype(np.uint8), sizes)
        n_right = np.add.reduceat(right, sizes.cumsum() - sizes, dtype=np.intp)
        below_sizes = np.concatenate([sizes - n_right, n_right])  # all left children, then all right ones
        below = np.concatenate([rows[~right], rows[right]])
        parts = [x.take(below) for x in data[1:]]
        below_totals = np.stack([np.add.reduceat(x, below_sizes.cumsum() - below_sizes) for x in parts])

        def cells_below(may: np.ndarray) -> np.ndarray:
            asked = np.flatnonzero(may[:m] | may[m:])
            small = asked + m * (below_sizes[asked] > below_sizes[asked + m])
            counted = np.zeros(2 * m, bool)
            counted[small] = True
            kept = np.flatnonzero(np.repeat(counted, below_sizes))
            at = np.repeat(np.arange(len(small)), below_sizes[counted])
            some = data[0].summed(below.take(kept), at, parts[0].take(kept), parts[1].take(kept), len(small))
            rank = np.empty(m, np.intp)
            rank[np.flatnonzero(counted) % m] = np.arange(len(small))
            wanted = np.flatnonzero(may)
            made, other = some[:, rank[wanted % m]], ~counted[wanted]
            made[:, other] = cells[:, wanted[other] % m] - made[:, other]
            made[1][made[0] == 0] = 0.0  # no rounding where there are no rows
            return made

        go_on(np.concatenate([2 * ids, 2 * ids + 1]), below, below_sizes, below_totals, level + 1, data, cells_below)
    return *(np.concatenate(x) for x in zip(*found)), importance


# ------------------------------------------------------------------ growing


class _Growing:
    """What the driver knows of a tree: its nodes so far, those that are still open by their counts, and the sums of those that
    it splits next."""

    def __init__(self, features: int, rows: float):
        self.ids, self.feature, self.cut, self.value, self.at = [1], [-1], [0], [0.0], {1: 0}
        self.open: dict[int, float] = {1: rows}
        self.sizes: dict[int, float] = {1: rows}
        self.cells: dict[int, np.ndarray] = {}
        self.importance = np.zeros(features)

    def tree(self) -> Tree:
        return Tree.of(self.ids, self.feature, self.cut, self.value)

    def asked(self, limit: float) -> list[tuple[int, int]]:
        """Pairs of children of which one has more than ``limit`` rows, the one of fewer rows first; the root has no other."""
        parents = sorted({node // 2 for node, n in self.open.items() if n > limit})
        pairs = ((2 * p, 2 * p + 1) if p else (1, 0) for p in parents)
        return [(a, b) if not b or self.sizes[a] <= self.sizes[b] else (b, a) for a, b in pairs]

    def split(self, node: int, feature: int, cut: int, gain: float, totals, left_n: float, left_t: float, levels: int, least: int) -> None:
        del self.open[node]
        n, t, k = totals[0], totals[1], self.at[node]
        if node == 1:
            self.value[0] = t / n
        if feature < 0:
            del self.cells[node]
            return
        self.feature[k], self.cut[k] = feature, cut
        self.importance[feature] += gain * n
        for child, count, total in ((2 * node, left_n, left_t), (2 * node + 1, n - left_n, t - left_t)):
            self.at[child], self.sizes[child] = len(self.ids), count
            self.ids.append(child)
            self.feature.append(-1)
            self.cut.append(0)
            self.value.append(total / count)
            if child.bit_length() <= levels and count >= 2 * least:
                self.open[child] = count


@dataclass
class _Work:
    """The rows and the rules of a fit."""

    blocks: DataFrame
    n_cuts: list[int]
    levels: int
    least: int
    weights: Callable


def _summed(work: _Work, growing: dict[int, _Growing], pairs: dict[int, list[tuple[int, int]]]) -> Iterator[tuple]:
    """``tree, totals, cells`` over all rows: totals of the first of all pairs and then of the others, cells of the first."""
    n_cuts, weights, width = work.n_cuts, work.weights, len(work.n_cuts)
    asked = [(t, growing[t].tree(), np.array(some).T) for t, some in pairs.items()]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros((3, some.size)), np.zeros((2, some.shape[1], width, BINS))) for _, _, some in asked]
        ranks = []
        for _, tree, some in asked:
            rank = np.full(len(tree.ids), -1, np.intp)
            nodes = some.reshape(-1)
            rank[np.searchsorted(tree.ids, nodes[nodes > 0])] = np.flatnonzero(nodes)
            ranks.append(rank)
        for number, bins, y in _opened(batches):
            block = _Cells(bins, n_cuts)
            for (t, tree, some), rank, (totals, cells) in zip(asked, ranks, held):
                at, w = rank.take(tree.places(bins)), weights(t, number, len(y))
                kept = np.flatnonzero(at >= 0 if w is None else (at >= 0) & (w > 0))
                at, label = (at, y) if len(kept) == len(y) else (at.take(kept), y.take(kept))
                w = None if w is None else w.take(kept).astype(np.float64)
                value = label if w is None else w * label
                totals += np.stack([np.bincount(at, v, some.size) for v in (w, value, value * label)])
                first = np.flatnonzero(at < some.shape[1])
                if len(first):
                    w = None if w is None else w.take(first)
                    cells += block.summed(kept.take(first), at.take(first), w, value.take(first), some.shape[1])
        here = TaskContext.get().partitionId()
        for (t, _, some), (totals, cells) in zip(asked, held):
            totals = totals.reshape(3, 2, -1)
            for lo in range(0, some.shape[1], CHUNK):
                packed = np.concatenate([totals[:, :, lo : lo + CHUNK].reshape(-1), cells[:, lo : lo + CHUNK].reshape(-1)])
                yield pa.RecordBatch.from_pylist([{"tree": t, "lo": lo, "part": here, "sums": packed.tobytes()}], _arrow(SUMS))

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        packed = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table["sums"])
        return pa.Table.from_pylist([{"tree": table["tree"][0].as_py(), "lo": table["lo"][0].as_py(), "part": 0, "sums": packed.tobytes()}], _arrow(SUMS))

    chunks = sum(-(-some.shape[1] // CHUNK) for _, _, some in asked)
    sent = work.blocks.mapInArrow(summed, SUMS).repartition(min(chunks, 32), "tree", "lo")
    parts: dict[int, list] = {t: [] for t in pairs}
    for row in sorted(sent.groupBy("tree", "lo").applyInArrow(together, SUMS).collect(), key=lambda r: r["lo"]):
        packed = np.frombuffer(row["sums"], np.float64)
        m = len(packed) // (6 + 2 * width * BINS)
        parts[row["tree"]].append((packed[: 6 * m].reshape(3, 2, m), packed[6 * m :].reshape(2, m, width, BINS)))
    for t, some in parts.items():
        totals, cells = (np.concatenate(x, axis=a) for x, a in zip(zip(*some), (2, 1)))
        yield t, totals.reshape(3, -1), cells


def _split_pairs(work: _Work, growing: dict[int, _Growing], pairs: dict[int, list[tuple[int, int]]], limit: float) -> None:
    """Split the nodes of ``pairs`` that have more than ``limit`` rows. The cells of the second of a pair are what the first has
    not of those of their parent."""
    for t, totals, cells in _summed(work, growing, pairs):
        g, some = growing[t], pairs[t]
        nodes, columns, made = [], [], []
        for k, (first, other) in enumerate(some):
            if g.open.get(first, 0) > limit:
                nodes, columns, made = [*nodes, first], [*columns, k], [*made, cells[:, k]]
            if other:
                above = g.cells.pop(other // 2)
                if g.open.get(other, 0) > limit:
                    left = above - cells[:, k]
                    left[1][left[0] == 0] = 0.0  # no rounding where there are no rows
                    nodes, columns, made = [*nodes, other], [*columns, len(some) + k], [*made, left]
        totals = totals[:, columns]
        found = best_splits(np.stack(made, axis=1), totals, work.least)
        for i, node in enumerate(nodes):
            g.cells[node] = np.array(made[i])
            g.split(node, *(x[i].item() for x in found[:3]), totals[:, i], *(x[i].item() for x in found[3:]), work.levels, work.least)
        # sums that no child needs
        needed = {node // 2 for node, n in g.open.items() if n > limit}
        g.cells = {node: x for node, x in g.cells.items() if node in needed}


def _arrow(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _split_large(work: _Work, growing: dict[int, _Growing], limit: float) -> None:
    """Split until no open node has more than ``limit`` rows; the trees go in groups whose sums a task can hold, one group to
    its end before the next, so that the driver holds the sums of few trees."""
    per_node, waiting = len(work.n_cuts) * BINS * 16, [list(growing)]
    while waiting:
        pairs = {t: some for t in waiting.pop() if (some := growing[t].asked(limit))}
        names = list(pairs)
        if len(names) > 1 and sum(map(len, pairs.values())) * per_node > SUM_BYTES:
            waiting += [names[len(names) // 2 :], names[: len(names) // 2]]
        elif names:
            _split_pairs(work, growing, pairs, limit)
            waiting.append(names)


def _branches(work: _Work, growing: dict[int, _Growing], trees: list[int]) -> DataFrame:
    """The rest of each tree below its open nodes, a task for the rows of each."""
    n_cuts, levels, least, weights = work.n_cuts, work.levels, work.least, work.weights
    asked = [(t, growing[t].tree(), np.array(sorted(growing[t].open))) for t in trees if growing[t].open]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, bins, y in _opened(batches):
            for t, tree, some in asked:
                rank = np.full(len(tree.ids), -1, np.intp)
                rank[np.searchsorted(tree.ids, some)] = np.arange(len(some))
                at, w = rank[tree.places(bins)], weights(t, number, len(y))
                w = np.ones(len(y), np.uint8) if w is None else w.astype(np.uint8)
                kept = np.flatnonzero((at >= 0) & (w > 0))
                kept = kept[np.argsort(at[kept].astype(np.min_scalar_type(len(some))), kind="stable")]  # few bits, so without comparisons
                ends = np.searchsorted(at[kept], np.arange(len(some) + 1))
                made_rows = [
                    {"place": place[t, int(some[k])], "tree": t, "node": int(some[k]), "block": number, "bins": bins[:, r].tobytes(), "label": y[r].tobytes(), "weight": w[r].tobytes()}
                    for k in range(len(some))
                    if len(r := kept[ends[k] : ends[k + 1]])
                ]
                if made_rows:
                    yield pa.RecordBatch.from_pylist(made_rows, _arrow(ROWS))

    def grown(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        label, weight = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table[c]]) for c, k in (("label", np.float64), ("weight", np.uint8)))
        bins = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(len(n_cuts), -1) for x in table["bins"]], axis=1)
        node = table["node"][0].as_py()
        ids, feature, cut, value, importance = grow(bins, label, weight.astype(np.float64), node, levels + 1 - node.bit_length(), n_cuts, least)
        row = dict(ids=ids.astype(np.int64), feature=feature.astype(np.int16), cut=cut.astype(np.uint8), value=value, importance=importance)
        return pa.Table.from_pylist([{"tree": table["tree"][0].as_py(), **{k: v.tobytes() for k, v in row.items()}}], _arrow(BRANCH))

    # a task for each branch, the largest first
    sizes = sorted(((n, t, node) for t in trees for node, n in growing[t].open.items()), reverse=True)
    place = {(t, node): i % MOST_BRANCHES for i, (_, t, node) in enumerate(sizes)}
    sent = work.blocks.mapInArrow(dealt, ROWS).repartitionById(min(MOST_BRANCHES, len(place)), "place")
    return sent.groupBy("place", "tree", "node").applyInArrow(grown, BRANCH)


def _grown_locally(work: _Work, growing: dict[int, _Growing], rows: float) -> list[Tree]:
    """The trees with their branches; the rows of a few trees at a time are on their way, in two waves side by side."""
    width = len(work.n_cuts) + 9
    at_once = max(1, int(WAVE_BYTES // (WAVES * width * max(rows, 1))))
    names = sorted(growing)
    parts: dict[int, list] = {t: [] for t in names}
    waves = [[t for t in names[lo : lo + at_once] if growing[t].open] for lo in range(0, len(names), at_once)]

    def run(wave: list[int]) -> list[dict]:
        return write_out(_branches(work, growing, wave)).toArrow().to_pylist()

    with ThreadPool(WAVES) as pool:
        for made in pool.imap_unordered(inheritable_thread_target(work.blocks.sparkSession)(run), [w for w in waves if w]):
            for row in made:
                parts[row["tree"]].append(row)
    made = []
    for t in names:
        g = growing[t]
        kept = [k for k, i in enumerate(g.ids) if i not in g.open]  # a branch brings its own root
        pieces = [[np.array(x, k)[kept] for x, k in ((g.ids, np.int64), (g.feature, np.int16), (g.cut, np.uint8), (g.value, np.float64))]]
        for row in parts[t]:
            pieces.append([np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("feature", np.int16), ("cut", np.uint8), ("value", np.float64))])
            g.importance += np.frombuffer(row["importance"], np.float64)
        made.append(Tree.of(*(np.concatenate(x) for x in zip(*pieces))))
    return made


# ------------------------------------------------------------------ models


def _once(tree, number, rows):
    return None


def _bagged(seed: int) -> Callable:
    """How often each row of a block is drawn for a tree: Poisson of mean 1, the same in every pass."""
    below = np.cumsum([exp(-1) / factorial(k) for k in range(16)])

    def weights(tree: int, number: int, rows: int) -> np.ndarray:
        drawn, times = np.random.default_rng([seed, tree, number]).random(rows), np.zeros(rows, np.uint8)
        for share in below:
            times += drawn >= share
        return times

    return weights


def can_fit(kind: str, parameters: dict) -> bool:
    """Whether these parameters are among those known here."""
    known = {"maxDepth", "seed", "minInstancesPerNode"}
    known |= {"stepSize", "maxIter"} if kind == "boosted_trees" else {"numTrees", "bootstrap", "featureSubsetStrategy"}
    return set(parameters) <= known and parameters.get("featureSubsetStrategy", "all") == "all"


def fit(kind: str, rows: DataFrame, parameters: dict, total: int) -> Ensemble:
    """The model of ``kind`` over the vectors ``features`` and the numbers ``label`` of ``total`` rows."""
    seed = parameters.get("seed", 42)
    cuts = cut_points(rows, seed, total)
    blocks = _blocks(rows, cuts, BLOCK_ROWS[kind]).persist(StorageLevel.MEMORY_AND_DISK)
    work = _Work(blocks, [len(c) for c in cuts], parameters["maxDepth"], parameters.get("minInstancesPerNode", 1), _once)
    try:
        made = _boosted if kind == "boosted_trees" else _forest
        return made(work, cuts, parameters, seed, total)
    finally:
        blocks.unpersist()


def _forest(work: _Work, cuts, parameters: dict, seed: int, total: int) -> Ensemble:
    if parameters.get("bootstrap", True):
        work.weights = _bagged(seed)
    number = parameters["numTrees"]
    growing = {t: _Growing(len(cuts), total) for t in range(number)}
    _split_large(work, growing, LOCAL_ROWS)
    trees = _grown_locally(work, growing, total * DRAWN if parameters.get("bootstrap", True) else total)
    share = sum(g.importance / g.importance.sum() for g in growing.values() if g.importance.sum() > 0)
    return Ensemble(cuts, trees, [1.0 / number] * number, _whole(share, len(cuts)))


def _boosted(work: _Work, cuts, parameters: dict, seed: int, total: int) -> Ensemble:
    trees, weights, importance, base, state = [], [], np.zeros(len(cuts)), work.blocks, None
    try:
        for i in range(parameters["maxIter"]):
            if i:
                anew = state is None or i % ANCHOR == 0
                former, state = state, _advanced(base, trees, weights, True) if anew else _advanced(state, trees[-1:], weights[-1:])
                work.blocks = state.persist(StorageLevel.MEMORY_AND_DISK)
            growing = {0: _Growing(len(cuts), total)}
            _split_large(work, growing, 0)
            if i and former is not None:
                former.unpersist()
            trees.append(growing[0].tree())
            weights.append(parameters["stepSize"] if i else 1.0)
            importance += growing[0].importance
    finally:
        if state is not None:
            state.unpersist()
    return Ensemble(cuts, trees, weights, _whole(importance, len(cuts)))


def _advanced(blocks: DataFrame, trees: list[Tree], weights: list[float], first: bool = False) -> DataFrame:
    """The blocks with negative gradients of the squared loss, ``2 (label - prediction)``, after these trees; ``first`` if
    the blocks hold labels yet."""

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, bins, label in _opened(batches):
            left = 2.0 * label if first else label.copy()
            for tree, weight in zip(trees, weights):
                left -= 2.0 * weight * tree.value[tree.places(bins)]
            yield _block(number, bins, left)

    return blocks.mapInArrow(less, BLOCKS)


def _whole(share, features: int) -> np.ndarray:
    share = np.zeros(features) + share
    return share / share.sum() if share.sum() > 0 else share


class Ensemble:
    """Weighted trees over binned features, used and saved like a model of MLlib."""

    NODES = "tree int, weight double, ids binary, feature binary, cut binary, value binary, cuts array<array<double>>, importance array<double>"

    def __init__(self, cuts: list[np.ndarray], trees: list[Tree], weights: list[float], importance: np.ndarray):
        self.cuts, self.trees, self.weights, self.importance = cuts, trees, weights, importance
        self._shared = None

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.importance)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` for the vectors ``features``."""
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.trees, self.weights))
        shared = self._shared

        def predicted(vectors: pa.Array) -> pa.Array:
            cuts, trees, weights = shared.value
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(cuts))
            bins, made = in_bins(values, cuts), np.zeros(len(vectors))
            for tree, weight in zip(trees, weights):
                made += weight * tree.value[tree.places(bins)]
            return pa.array(made)

        predicted.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
        return df.withColumn("prediction", F.arrow_udf(predicted, "double")(vector_to_array("features")))

    def write(self) -> _Writer:
        return _Writer(self)

    def rows(self) -> list[tuple]:
        cuts, importance = [c.tolist() for c in self.cuts], self.importance.tolist()
        return [
            (i, float(w), *(bytearray(x.tobytes()) for x in (t.ids, t.feature, t.cut, t.value)), cuts if i == 0 else None, importance if i == 0 else None)
            for i, (t, w) in enumerate(zip(self.trees, self.weights))
        ]

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rows = sorted(spark.read.schema(Ensemble.NODES).parquet(f"{path}/trees").toArrow().to_pylist(), key=lambda r: r["tree"])
        kinds = {"ids": np.int64, "feature": np.int16, "cut": np.uint8, "value": np.float64}
        trees = [Tree.of(*(np.frombuffer(r[c], k) for c, k in kinds.items())) for r in rows]
        return Ensemble([np.array(c) for c in rows[0]["cuts"]], trees, [r["weight"] for r in rows], np.array(rows[0]["importance"]))


class _Writer:
    def __init__(self, model: Ensemble):
        self.model, self.mode = model, "errorifexists"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.model.rows(), Ensemble.NODES).write.mode(self.mode).parquet(f"{path}/trees")
