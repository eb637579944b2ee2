"""Boosted trees with Poisson loss: second-order splits over histograms, one aggregation a level for all targets.

A feature is cut into at most `bins` bins at its quantiles, so that a row is one byte a feature, with a bin of its own for
unknown values. Rows are arrays of a block each, with their margins, and stay with the executors (in memory, or on disk where
that is short). Each level is one job of one stage: tasks sum gradients and hessians by (target, node, feature, bin), and the
driver adds up what tasks give, nodes x features x bins sums, a number that parameters fix and rows don't; where tasks are many
these sums are added among executors first. Sums are whole numbers (units of 2**-24), so that they don't depend on how rows are
partitioned. A tree's values are added to the margins once, as the next tree begins; blocks are checkpointed every `EVERY` trees.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.sources.shared import settled

#: Trees between two checkpoints of the blocks, and the unit of summed gradients.
EVERY, UNIT = 50, 2**24
#: A task takes this many rows at least, since a level is a job, and four times as many once each core has a task; sums of more
#: than so many tasks are added among executors.
TASK_ROWS, DIRECT = 25_000, 64
#: The byte of an unknown value.
UNKNOWN = 255


@dataclass(frozen=True)
class Settings:
    """rounds trees of `depth` levels, each added by `step`; l1 and l2 shrink leaves, `least` is the hessian a child needs,
    `damp` bounds a leaf and swells hessians by e**damp, so that the exponential doesn't run away."""

    rounds: int = 200
    depth: int = 4
    step: float = 0.05
    l1: float = 0.1
    l2: float = 1.0
    least: float = 1.0
    damp: float = 0.7
    bins: int = 64


@dataclass
class Tree:
    """Nodes in heap order from 1; feature -1 ends a path. Values are those of every node, inner ones too."""

    feature: list[int]
    cut: list[int]
    unknown_left: list[bool]
    value: list[float]
    gain: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1)
        return Tree([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)


@dataclass
class Forest:
    """names and their cuts; by target, the first margin and the trees."""

    names: list[str]
    cuts: list[list[float]]
    base: dict[str, float]
    trees: dict[str, list[Tree]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Forest:
        d = json.loads(text)
        return Forest(d["names"], d["cuts"], d["base"], {t: [Tree(**x) for x in xs] for t, xs in d["trees"].items()})


def _steps(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """By node the feature to look at, and by node and byte the node one level below; ended paths stay."""
    feature, byte, node = np.asarray(tree.feature), np.arange(UNKNOWN + 1), np.arange(len(tree.feature))[:, None]
    left = np.where(byte == UNKNOWN, np.asarray(tree.unknown_left)[:, None], byte <= np.asarray(tree.cut)[:, None])
    return np.maximum(feature, 0), np.where(feature[:, None] >= 0, 2 * node + 1 - left, node).ravel()


def _children(steps: tuple[np.ndarray, np.ndarray], bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The nodes one level below."""
    feature, below = steps
    return below[node * (UNKNOWN + 1) + bins[feature[node], np.arange(len(node))]]


def _nodes(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    node = np.ones(bins.shape[1], dtype=np.int64)
    steps = _steps(tree) if levels else None
    for _ in range(levels):
        node = _children(steps, bins, node)
    return node


def _margins(trees: list[Tree], bins: np.ndarray, margin: np.ndarray, depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + np.asarray(tree.value)[_nodes(tree, bins, depth)]
    return margin


@dataclass
class Block:
    """Rows: bins (feature, row), targets and margins (row, target)."""

    bins: np.ndarray
    y: np.ndarray
    margin: np.ndarray


def _forward(block: Block, trees: list[list[Tree]], depth: int) -> Block:
    """The block with the trees of each target added to its margins."""
    return Block(block.bins, block.y, np.column_stack([_margins(own, block.bins, block.margin[:, t], depth) for t, own in enumerate(trees)]))


def histograms(blocks: Iterator[Block], growing: list[Tree], level: int, width: int, s: Settings) -> np.ndarray:
    """Sums of gradients and hessians (target, g or h, node of the level, feature, bin; the last bin is that of unknown values)
    over a task's rows at nodes of the level."""
    first, wide = 2**level, s.bins + 1
    sums = np.zeros((len(growing), 2, width, (first + 1) * wide), dtype=np.int64)
    for block in blocks:
        bins = np.minimum(block.bins, s.bins)
        for t, tree in enumerate(growing):
            rate = np.exp(block.margin[:, t])
            g = np.rint((rate - block.y[:, t]) * UNIT)
            h = np.rint(rate * math.exp(s.damp) * UNIT)
            node = _nodes(tree, block.bins, level) - first
            start = np.where(node >= 0, node, first) * wide  # paths that ended above count behind the last node
            for f in range(width):
                at = start + bins[f]
                for k, v in enumerate((g, h)):
                    sums[t, k, f] += np.bincount(at, v, sums.shape[3]).astype(np.int64)
    return sums.reshape(len(growing), 2, width, first + 1, wide)[:, :, :, :first].swapaxes(2, 3)


def _shrunk(g, s: Settings):
    return np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)


def _value(g: float, h: float, s: Settings) -> float:
    return float(s.step * min(max(-_shrunk(g, s) / (h + s.l2), -s.damp), s.damp))


def _score(g, h, s: Settings):
    return _shrunk(g, s) ** 2 / (h + s.l2)


def best_split(g: np.ndarray, h: np.ndarray, s: Settings):
    """(gain, feature, cut, unknown left, left sums, right sums) of a node's histograms (feature, 256), or None.

    The cut behind the last bin parts known from unknown values. Ties go to the smallest feature, then cut, then unknown
    values to the right.
    """
    total_g, total_h = g[0].sum() / UNIT, h[0].sum() / UNIT
    best = None
    for unknown_left in (False, True):
        gl, hl = (np.cumsum(x[:, :UNKNOWN], axis=1) + (x[:, UNKNOWN:] if unknown_left else 0) for x in (g, h))
        gl, hl = gl / UNIT, hl / UNIT
        gr, hr = total_g - gl, total_h - hl
        gain = _score(gl, hl, s) + _score(gr, hr, s) - _score(total_g, total_h, s)
        gain = np.where((hl >= s.least) & (hr >= s.least), gain, -np.inf)
        at = int(np.argmax(gain))
        f, c = divmod(at, UNKNOWN)
        found = (float(gain[f, c]), f, c, unknown_left, (float(gl[f, c]), float(hl[f, c])), (float(gr[f, c]), float(hr[f, c])))
        if found[0] > 1e-9 and (best is None or (-found[0], f, c) < (-best[0], best[1], best[2])):
            best = found
    return best


def _split(tree: Tree, node: int, g: np.ndarray, h: np.ndarray, s: Settings) -> None:
    if node == 1:
        tree.value[1] = _value(g[0].sum() / UNIT, h[0].sum() / UNIT, s)
    best = best_split(g, h, s)
    if best is None:
        return
    tree.gain[node], tree.feature[node], tree.cut[node], tree.unknown_left[node] = best[:4]
    for child, sums in ((2 * node, best[4]), (2 * node + 1, best[5])):
        tree.value[child] = _value(*sums, s)


def quantile_cuts(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """By feature, the distinct quantiles of its known values; a value is in the bin of as many cuts as it exceeds."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 10_000).alias(c) for c in names]).first()
    return [sorted(set(found[c] or [])) for c in names]


def _binned(columns: list[pa.Array], cuts: list[list[float]]) -> np.ndarray:
    """(feature, row)"""
    out = np.empty((len(cuts), len(columns[0])), dtype=np.uint8)
    for k, (column, cut) in enumerate(zip(columns, cuts, strict=True)):
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[k] = np.where(np.isnan(x), UNKNOWN, np.searchsorted(np.asarray(cut), x, side="left"))
    return out


def fit(rows: DataFrame, names: list[str], targets: list[str], settings: Settings = Settings()) -> Forest:
    """A forest for each target, grown together. Rows without any of the targets are left out; a null or NaN feature is
    unknown; counts below zero are an error. No rows give the rate 1e-6 and no trees."""
    s = settings
    if not 2 <= s.bins <= UNKNOWN:
        raise ValueError("bins: 2 to 255")
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in (*names, *targets)]).dropna(subset=targets)
    start = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(t).alias(t) for t in targets], F.least(*[F.min(t) for t in targets], F.lit(0.0)).alias("_least")).first()
    if start["_least"] < 0:
        raise ValueError("counts below zero")
    base = {t: math.log(max(start[t] or 0.0, 1e-6)) for t in targets}
    forest = Forest(list(names), quantile_cuts(rows, names, s.bins), base, {t: [] for t in targets})
    if start[targets[0]] is None:
        return forest

    cuts, width, first = forest.cuts, len(names), np.asarray(list(base.values()))

    def prepared(batches):
        for batch in batches:
            y = np.column_stack([batch.column(t).to_numpy(zero_copy_only=False) for t in targets])
            yield pa.record_batch({"block": [pickle.dumps((_binned([batch.column(c) for c in names], cuts), y))]})

    tasks = min(start["_n"] // TASK_ROWS + 1, max(rows.sparkSession.sparkContext.defaultParallelism, start["_n"] // (4 * TASK_ROWS) + 1))
    told = settled(rows.mapInArrow(prepared, "block binary")).coalesce(tasks).rdd

    def read(row) -> Block:
        bins, y = pickle.loads(row["block"])
        return Block(bins, y, np.tile(first, (len(y), 1)))

    blocks = told.map(read).persist(StorageLevel.MEMORY_AND_DISK)
    for k in range(s.rounds):
        growing, before = [Tree.empty(s.depth) for _ in targets], None
        if k:
            before, blocks = blocks, _moved(blocks, [forest.trees[t][-1:] for t in targets], s.depth)
            if k % EVERY == 0:
                blocks.checkpoint()
        for level in range(s.depth):
            more = _grow(blocks, growing, level, width, s)
            if before is not None:
                before.unpersist()
                before = None
            if not more:
                break
        for t, tree in zip(targets, growing, strict=True):
            forest.trees[t].append(tree)
    blocks.unpersist()
    return forest


def _moved(blocks: RDD, trees: list[list[Tree]], depth: int) -> RDD:
    return blocks.map(lambda block: _forward(block, trees, depth)).persist(StorageLevel.MEMORY_AND_DISK)


def _grow(blocks: RDD, growing: list[Tree], level: int, width: int, s: Settings) -> bool:
    """Split the nodes of a level where that gains; whether any was."""

    def task(own):
        yield histograms(own, growing, level, width, s)

    found = blocks.mapPartitions(task).treeReduce(np.add, 1 if blocks.getNumPartitions() <= DIRECT else 2)
    before = [sum(f >= 0 for f in tree.feature) for tree in growing]
    for tree, sums in zip(growing, found, strict=True):
        for node in range(2**level):
            if sums[1, node].any():
                full = np.zeros((2, width, UNKNOWN + 1), dtype=np.int64)
                full[:, :, : s.bins], full[:, :, UNKNOWN] = sums[:, node, :, : s.bins], sums[:, node, :, s.bins]
                _split(tree, 2**level + node, full[0], full[1], s)
    return before != [sum(f >= 0 for f in tree.feature) for tree in growing]


def _depth(tree: Tree) -> int:
    return int(math.log2(len(tree.value))) - 1


def rates(forest: Forest, target: str) -> Column:
    """The predicted rate of a target from the columns of the forest's names."""
    trees, base, cuts = forest.trees[target], forest.base[target], forest.cuts

    @F.pandas_udf("double")
    def rate(features):
        import pandas as pd

        bins = _binned([pa.array(features[c], from_pandas=True) for c in features.columns], cuts)
        margin = np.full(bins.shape[1], base)
        return pd.Series(np.exp(_margins(trees, bins, margin, _depth(trees[0])) if trees else margin))

    return rate(F.struct(*[F.col(c).cast("double").alias(c) for c in forest.names]))


def contributions(forest: Forest, target: str) -> Column:
    """By feature, what it adds to the log of the rate (array in the order of names), and last what holds for every row.

    A step of a path from a node to its child adds the difference of their values to the feature that decided it; the values
    of the roots and the first margin hold for every row. All of them add up to the log of rates().
    """
    trees, base, cuts, width = forest.trees[target], forest.base[target], forest.cuts, len(forest.names)

    @F.pandas_udf("array<double>")
    def parts(features):
        import pandas as pd

        bins = _binned([pa.array(features[c], from_pandas=True) for c in features.columns], cuts)
        rows = np.arange(bins.shape[1])
        out = np.zeros((len(rows), width + 1))
        out[:, width] = base + sum(tree.value[1] for tree in trees)
        for tree in trees:
            value, feature, node, steps = np.asarray(tree.value), np.asarray(tree.feature), np.ones(len(rows), dtype=np.int64), _steps(tree)
            for _ in range(_depth(tree)):
                child = _children(steps, bins, node)
                out[rows, np.maximum(feature[node], 0)] += value[child] - value[node]
                node = child
        return pd.Series(list(out))

    return parts(F.struct(*[F.col(c).cast("double").alias(c) for c in forest.names]))


def importances(forest: Forest, target: str) -> dict[str, float]:
    """By feature, the mean gain of its splits, as a share of the sum over features."""
    gains: dict[int, list[float]] = {}
    for tree in forest.trees[target]:
        for f, gain in zip(tree.feature, tree.gain, strict=True):
            if f >= 0:
                gains.setdefault(f, []).append(gain)
    means = {f: math.fsum(x) / len(x) for f, x in gains.items()}
    total = math.fsum(means.values())
    return {name: means.get(k, 0.0) / total if total else 0.0 for k, name in enumerate(forest.names)}


def factors(forest: Forest, rows: DataFrame, keys: list[str], impact, n: int = 6) -> DataFrame:
    """keys, target, rank, factor, value, contribution, importance, impact: the n features that move each row's rate most.

    Ties go by name; a feature that no path of the row meets contributes nothing and isn't told. impact is a function of the
    contribution's column.
    """
    rows = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in forest.names])
    out = []
    for target in forest.trees:
        share = importances(forest, target)
        parts = rows.withColumn("_c", contributions(forest, target))
        each = F.array(*[F.struct((-F.abs(F.col("_c")[k])).alias("_by"), F.lit(c).alias("factor"), F.col(c).alias("value"), F.col("_c")[k].alias("contribution"), F.lit(share[c]).alias("importance")) for k, c in enumerate(forest.names)])
        top = F.slice(F.array_sort(F.filter(each, lambda x: x["contribution"] != 0)), 1, n)
        told = parts.select(*keys, F.posexplode(top).alias("_rank", "x"))
        out.append(told.select(*keys, F.lit(target).alias("target"), (F.col("_rank") + 1).alias("rank"), "x.factor", "x.value", "x.contribution", "x.importance"))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both.withColumn("impact", impact(F.col("contribution")))
