"""Random forests over few features for all folds at once, grown over cells instead of rows.

A forest of ``pyspark.ml`` sees a row only by its label and the bins of its features. Rows of one cell are alike to it,
and their Poisson weights of mean 1 add up to one Poisson weight whose mean is their number. So rows are counted by cell
in one pass, and every tree draws and grows over the cells, whose number hangs on features and bins, not on rows. How
split candidates are found (from a sample), bins, depth, impurity, features tried at a node, pruning and votes are as there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.shipping import map_arrow
from . import fitting

#: Bins of a feature, levels of splits below the root's node, rows of a fold that split candidates are found from: those of ``pyspark.ml``.
BINS, DEPTH, SAMPLE = 32, 5, 10_000
#: Features up to which cells are used: 32,768 cells of each label then.
MOST_FEATURES = 3
#: Trees that one group grows.
TOGETHER = 50
#: A vote is counted in units of this, so that sums do not hang on their order.
UNIT = float(1 << 40)


def candidates(values: np.ndarray) -> np.ndarray:
    """Where a feature may be split: between all values, or at most BINS - 1 places that part them evenly."""
    distinct, counts = np.unique(values, return_counts=True)
    middle, ends = (distinct[:-1] + distinct[1:]) / 2, np.cumsum(counts)
    if len(middle) < BINS:
        return middle
    stride, out = len(values) / BINS, []
    for i in range(1, len(distinct)):
        target = stride * (len(out) + 1)
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            out.append(middle[i - 1])
    return np.array(out)


def _gini(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = np.maximum(zeros + ones, 1)
    return 1 - (zeros / n) ** 2 - (ones / n) ** 2


class Tree:
    """A tree over bins: for each level the nodes' counts of labels, and where those that are split are split."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
        weight = rng.poisson(n)
        at = np.flatnonzero(weight)
        bins, y, weight = bins[at], y[at], weight[at].astype(float)
        node, width, tried = np.zeros(len(at), np.int64), bins.shape[1], int(np.ceil(np.sqrt(bins.shape[1])))
        self.counts, self.feature, self.last, self.leaf = [], [], [], []
        for depth in range(DEPTH + 1):
            nodes = 1 << depth
            count = np.bincount(node * 2 + y, weight, nodes * 2).reshape(nodes, 2)
            self.counts.append(count)
            if depth == DEPTH:
                self.leaf.append(np.ones(nodes, bool))
                break
            cells = np.stack([np.bincount((node * BINS + bins[:, f]) * 2 + y, weight, nodes * BINS * 2).reshape(nodes, BINS, 2) for f in range(width)], 1)
            left = np.cumsum(cells, 2)[:, :, :-1]
            right = count[:, None, None] - left
            a, b, n_all = left.sum(3), right.sum(3), np.maximum(count.sum(1), 1)[:, None, None]
            gain = _gini(count[:, 0], count[:, 1])[:, None, None] - a / n_all * _gini(left[..., 0], left[..., 1]) - b / n_all * _gini(right[..., 0], right[..., 1])
            own = rng.random((nodes, width)).argsort(1).argsort(1) < tried
            gain = np.where((a >= 1) & (b >= 1) & own[:, :, None], gain, -1.0).reshape(nodes, -1)
            best = gain.argmax(1)
            split = gain[np.arange(nodes), best] > 0
            self.feature.append(best // (BINS - 1))
            self.last.append(best % (BINS - 1))
            self.leaf.append(~split)
            at = np.flatnonzero(split[node])
            bins, y, weight, node = bins[at], y[at], weight[at], self._below(depth, bins[at], node[at])
        for depth in range(DEPTH - 1, -1, -1):  # two leaves that predict the same are one
            says = self.counts[depth + 1][:, 1] > self.counts[depth + 1][:, 0]
            self.leaf[depth] |= self.leaf[depth + 1][::2] & self.leaf[depth + 1][1::2] & (says[::2] == says[1::2])

    def _below(self, depth: int, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node * 2 + (bins[np.arange(len(node)), self.feature[depth][node]] > self.last[depth][node])

    def share(self, bins: np.ndarray) -> np.ndarray:
        """The share of ones in the leaf of each cell."""
        out, at, node = np.zeros(len(bins)), np.arange(len(bins)), np.zeros(len(bins), np.int64)
        for depth in range(DEPTH + 1):
            ends = self.leaf[depth][node]
            count = self.counts[depth][node[ends]]
            out[at[ends]] = count[:, 1] / np.maximum(count.sum(1), 1)
            if depth < DEPTH:
                at, node = at[~ends], self._below(depth, bins[at[~ends]], node[~ends])
        return out


def _code(x: np.ndarray, edges: list[np.ndarray], median: np.ndarray) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for f, edge in enumerate(edges):
        code = code * BINS + np.searchsorted(edge, np.where(np.isnan(x[:, f]), median[f], x[:, f]))
    return code


def _digits(code: np.ndarray, width: int) -> np.ndarray:
    return np.stack([code // BINS ** (width - 1 - f) % BINS for f in range(width)], 1)


def _edges(table: DataFrame, medians: list[np.ndarray], width: int, k: int) -> list[list[np.ndarray]]:
    """The split candidates of each fold's model, from a sample of its rows by their hash."""
    n = table.count()
    part = table.where(F.pmod("h", F.lit(1 << 20)) < min(1.0, SAMPLE / max(1, n) / max(0.5, 1 - 1 / k) * 1.1) * (1 << 20))
    rows = part.select("x", "fold").toArrow()  # some SAMPLE rows
    x, fold = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), rows.column("fold").to_numpy()
    return [[candidates(np.where(np.isnan(v), medians[m][f], v)) for f, v in enumerate(x[fold != m].T)] for m in range(k)]


def cells(table: DataFrame, edges: list[list[np.ndarray]], medians: list[np.ndarray]) -> DataFrame:
    """model, cell, n: the rows of a design by the bins of each fold's model, the fold being that model's own, and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold, _ = fitting._arrays(batch)
            for m, edge in enumerate(edges):
                cell, n = np.unique((_code(x, edge, medians[m]) * 2 + (fold == m)) * 2 + y[:, 0].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), m, np.int32)), pa.array(cell), pa.array(n)], ["model", "cell", "n"])

    return map_arrow(table.select("x", "y", "fold", "h"), run, "model int, cell long, n long").groupBy("model", "cell").agg(F.sum("n").alias("n"))


def votes(counted: DataFrame, width: int, trees: int, seed: int) -> DataFrame:
    """model, code, votes: what the trees of each fold's model say of the cells of the fold, in units of 1 / UNIT."""
    spark, parts = counted.sparkSession, -(-trees // TOGETHER)

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        model, part = (v.as_py() for v in key)
        cell, n = group.column("cell").to_numpy(), group.column("n").to_numpy()
        at = np.argsort(cell)  # a draw hangs on the order
        cell, n = cell[at], n[at]
        train, code = cell & 2 == 0, np.unique(cell[cell & 2 == 2] >> 2)
        bins, own, out = _digits(cell[train] >> 2, width), _digits(code, width), np.zeros(len(code), np.int64)
        for tree in range(part * TOGETHER, min(trees, (part + 1) * TOGETHER)):
            grown = Tree(bins, cell[train] & 1, n[train], np.random.default_rng([seed, model, tree]))
            out += np.rint(grown.share(own) * UNIT).astype(np.int64)
        return pa.table({"model": pa.array(np.full(len(code), model, np.int32)), "code": code, "votes": out})

    groups = counted.crossJoin(F.broadcast(spark.range(parts).withColumnRenamed("id", "part"))).repartition(3 * spark.sparkContext.defaultParallelism, "model", "part")
    return groups.groupBy("model", "part").applyInArrow(grow, "model int, code long, votes long").groupBy("model", "code").agg(F.sum("votes").alias("votes"))


def out_of_fold(table: DataFrame, width: int, k: int, trees: int, seed: int = 42) -> DataFrame:
    """key, y, fold, score, probability of the rows of a design: each by a forest of the other folds."""
    kind, draws = dict(table.dtypes)["key"], [fitting.Draw(fold=fold) for fold in range(k)]
    scales = fitting.scales(table, draws)
    medians = [scales[d].median if d in scales else np.zeros(width) for d in draws]
    edges = _edges(table, medians, width, k)
    said = stored(votes(stored(cells(table, edges, medians)), width, trees, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold, _ = fitting._arrays(batch)
            code = np.zeros(len(x), np.int64)
            for m in np.unique(fold):
                code[fold == m] = _code(x[fold == m], edges[m], medians[m])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(y[:, 0]), pa.array(fold.astype(np.int32)), pa.array(code)], ["key", "y", "fold", "code"])

    rows = map_arrow(table, run, f"key {kind}, y double, fold int, code long")
    score = F.col("votes") / UNIT
    return rows.join(F.broadcast(said.withColumnRenamed("model", "fold")), ["fold", "code"]).select("key", "y", "fold", score.alias("score"), (score / trees).alias("probability"))
