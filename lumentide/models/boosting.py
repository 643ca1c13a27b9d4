"""Boosted trees from gradient histograms, with missing values, three importances and exact attributions.

The rows stay where they are: for each level of a tree every task adds up its rows' gradients by node, feature and bin, Spark adds
the tasks' sums, and the driver, which sees nodes * features * bins numbers whatever the rows, chooses the splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.operators.tables import stored

#: Rounds after which the margins so far are stored with the rows, so that a pass walks few trees.
KEEP = 10


@dataclass
class Tree:
    """A tree by its heap of nodes: node i has children 2 i + 1 and 2 i + 2. feature -1: a leaf, or no node."""

    feature: np.ndarray
    cut: np.ndarray  # at most the cut: left
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each row ends; NaN is missing."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            here, v = at[inner], x[inner, f[inner]]
            left = np.where(np.isnan(v), self.missing_left[here], v <= self.cut[here])
            at[inner] = 2 * here + 2 - left


@dataclass
class Forest:
    """Boosted trees of logistic loss over named features; base is the margin without trees."""

    features: list[str]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray, start: int = 0) -> np.ndarray:
        out = np.full(len(x), self.base if start == 0 else 0.0)
        for tree in self.trees[start:]:
            out += tree.value[tree.nodes(x)]
        return out


def _inputs(df: DataFrame, features: list[str]) -> list:
    return [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first n columns as doubles; null is NaN."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))


def best_split(g: np.ndarray, h: np.ndarray, l2: float, least_cover: float) -> tuple[float, int, int, bool]:
    """The best (gain, feature, bin, missing goes left) of a node's sums by feature and bin, the last bin being of missing values.

    Ties go to the first feature, the lowest bin, and missing values to the left.
    """
    total_g, total_h = g[0].sum(), h[0].sum()
    gl, hl = np.cumsum(g[:, :-2], axis=1), np.cumsum(h[:, :-2], axis=1)
    options = np.stack([np.stack([gl + g[:, -1:], hl + h[:, -1:]]), np.stack([gl, hl])], axis=-1)  # (g or h, feature, bin, side)
    left_g, left_h = options
    right_g, right_h = total_g - left_g, total_h - left_h
    score = lambda a, b: a * a / (b + l2)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)
    gain = np.where((left_h >= least_cover) & (right_h >= least_cover), gain, -np.inf)
    if not gain.size:
        return -np.inf, 0, 0, True
    top = gain.max()
    at = int(np.flatnonzero(gain.ravel() >= top - 1e-9 * max(1.0, abs(top)))[0]) if np.isfinite(top) else 0
    f, b, side = np.unravel_index(at, gain.shape)
    return float(gain[f, b, side]), int(f), int(b), side == 0


def fit(df: DataFrame, features: list[str], truth: str, rounds: int = 50, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least_cover: float = 1.0, least_gain: float = 1e-6, bins: int = 64, held: str | None = None, patience: int = 10) -> Forest:
    """Fits trees to a 0/1 truth. A null or NaN feature is missing: each split learns on which side missing values go.

    Rows whose truth is null are left out. Splits lie at quantiles of a feature (at most `bins` bins). With `held` (a boolean
    column) those rows aren't learned from; their loss is taken each round, and trees after the best round are dropped when
    `patience` rounds brought nothing better. A level without a split of least_gain ends a tree; no rows, or one class only, give
    a model without trees.
    """
    d = df.where(F.col(truth).isNotNull()).select(*_inputs(df, features), F.col(truth).cast("double").alias("y"), (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"))
    d = stored(d.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in d.columns[:-2]), "y", "held", F.lit(0.0).alias("m")), "boosting")
    own = d.where(~F.col("held"))
    first = own.agg(F.avg("y").alias("p"), *(F.percentile_approx(c, [i / bins for i in range(1, bins)], 20_000).alias(c) for c in d.columns[:-3])).first()
    model = Forest(list(features), float(np.log(first.p / (1 - first.p))) if first.p and first.p < 1 else 0.0)
    if not first.p or first.p == 1 or not features:
        return model
    n, edges = len(features), [np.unique(np.array(first[f"x{i}"] or [], float)) for i in range(len(features))]
    wide = bins + 1  # the last for missing values
    stored_trees = 0

    def sums(tree: Tree, level: int) -> dict[int, np.ndarray]:
        """Sums of gradients, curvatures and rows by node of a level, feature and bin; under -1 the loss of held rows."""
        known, begin = Forest(model.features, model.base, model.trees), stored_trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, count = 2**level - 1, 2**level
            total, loss = np.zeros((3, count * n * wide)), np.zeros(2)
            for batch in batches:
                x = _matrix(batch, n)
                y, out = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy(zero_copy_only=False)
                m = batch.column(n + 2).to_numpy() + (known.margin(x, begin) if begin else known.margin(x))
                p = 1 / (1 + np.exp(-m))
                if level == 0:
                    loss += [np.where(y[out] > 0.5, np.logaddexp(0, -m[out]), np.logaddexp(0, m[out])).sum(), out.sum()]
                at = tree.nodes(x)
                mine = np.flatnonzero((at >= low) & ~out)
                g, h = (p - y)[mine], (p * (1 - p))[mine]
                for f in range(n):
                    v = x[mine, f]
                    b = np.where(np.isnan(v), wide - 1, np.searchsorted(edges[f], v, side="left"))
                    code = ((at[mine] - low) * n + f) * wide + b
                    for k, w in enumerate((g, h, None)):
                        total[k] += np.bincount(code, w, count * n * wide)
            some = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(total[k][some], (*loss, 0.0)[k])) for k in range(3))], ["code", "g", "h", "n"])

        got = d.mapInArrow(run, "code long, g double, h double, n double").groupBy("code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
        out = np.zeros((3, 2**level * n * wide))
        model_loss = (0.0, 0.0)
        for r in got:
            if r.code < 0:
                model_loss = (r.g, r.h)
            else:
                out[:, r.code] = r.g, r.h, r.n
        shaped = out.reshape(3, 2**level, n, wide)
        return {-1: np.array(model_loss)} | {i: shaped[:, i] for i in range(2**level)}

    for _ in range(rounds):
        tree = Tree.empty(depth)
        for level in range(depth + 1):
            found = sums(tree, level)
            if level == 0 and held:
                loss, count = found[-1]
                model.losses.append(loss / count if count else 0.0)
            split = False
            for i in range(2**level):
                node = 2**level - 1 + i
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                g, h = found[i][0], found[i][1]
                tree.value[node], tree.cover[node] = -rate * g[0].sum() / (h[0].sum() + l2), h[0].sum()
                if level == depth:
                    continue
                gain, f, b, left = best_split(g, h, l2, least_cover)
                if gain > least_gain and b < len(edges[f]):
                    tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = f, edges[f][b], left, gain
                    split = True
            if not split:
                break
        if held and len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience:
            break
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
        if len(model.trees) - stored_trees == KEEP:
            d, stored_trees = _with_margins(d, n, Forest(model.features, model.base, model.trees), stored_trees), len(model.trees)
    if held:
        model.trees = model.trees[: int(np.argmin(model.losses))] if model.losses else model.trees
    return model


def _with_margins(d: DataFrame, n: int, model: Forest, start: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(n + 2).to_numpy() + model.margin(_matrix(batch, n), start)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(m)], batch.schema.names)

    return stored(d.mapInArrow(run, d.schema), "boosting")


def scored(df: DataFrame, model: Forest, keys: list[str]) -> DataFrame:
    """The keys with margin and probability of class 1."""
    n, kinds = len(model.features), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.margin(_matrix(batch, n))
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], pa.array(m), pa.array(1 / (1 + np.exp(-m)))], [*(f"k{i}" for i in range(len(keys))), "margin", "probability"])

    picked = df.select(*_inputs(df, model.features), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    return picked.mapInArrow(run, ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), "margin double, probability double"])).toDF(*keys, "margin", "probability")


def importances(spark: SparkSession, model: Forest) -> DataFrame:
    """Each feature's splits (weight), the gains and covers of its splits in all, and means of these; unused features have zeros."""
    rows = []
    for i, f in enumerate(model.features):
        at = [(t.gain[j], t.cover[j]) for t in model.trees for j in np.flatnonzero(t.feature == i)]
        gain, cover = (float(sum(x[k] for x in at)) for k in (0, 1))
        rows.append((f, len(at), gain, cover, gain / max(1, len(at)), cover / max(1, len(at))))
    return spark.createDataFrame(rows, "feature string, weight int, total_gain double, total_cover double, gain double, cover double")


@dataclass
class _Leaf:
    """A leaf with the features on its path, the splits (place among the features, cut, missing left, goes left), and a table of
    attributions: a row for each set of features whose splits a row of data passes."""

    features: list[int]
    splits: list[tuple[int, float, bool, bool]]
    table: np.ndarray


def _leaf_tables(tree: Tree) -> tuple[list[_Leaf], float]:
    """The leaves' tables, and the tree's mean value by cover."""
    leaves, mean = [], 0.0
    stack: list[tuple[int, list[tuple[int, bool]], float]] = [(0, [], 1.0)]
    while stack:
        node, path, share = stack.pop()
        if tree.feature[node] >= 0:
            for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                ratio = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.5
                stack.append((child, [*path, (node, left)], share * ratio))
            continue
        value = float(tree.value[node])
        mean += share * value
        names = sorted({int(tree.feature[p]) for p, _ in path})
        ratios = np.ones(len(names))
        for (p, left) in path:
            child = 2 * p + 1 if left else 2 * p + 2
            ratios[names.index(int(tree.feature[p]))] *= tree.cover[child] / tree.cover[p] if tree.cover[p] > 0 else 0.5
        m = len(names)
        table = np.zeros((2**m, m))
        for pattern in range(2**m):
            passed = [(pattern >> j) & 1 for j in range(m)]
            for i in range(m):
                sizes = np.zeros(m)  # by how many of the others are known
                sizes[0] = 1.0
                for j in range(m):
                    if j != i:
                        sizes = sizes * ratios[j] + np.append(0.0, sizes[:-1]) * passed[j]
                weight = sum(sizes[k] * factorial(k) * factorial(m - 1 - k) for k in range(m)) / factorial(m)
                table[pattern, i] = value * (passed[i] - ratios[i]) * weight
        leaves.append(_Leaf(names, [(names.index(int(tree.feature[p])), float(tree.cut[p]), bool(tree.missing_left[p]), left) for p, left in path], table))
    return leaves, mean


def attributions(df: DataFrame, model: Forest, keys: list[str]) -> DataFrame:
    """Exact path-dependent attributions of the margin: the keys, a column for each feature (phi_<feature>), and expected.

    A feature that isn't known is averaged over by the covers of a tree's branches. Of each leaf, what it gives each feature depends
    only on which features' splits a row passes, so these sums are made once, as tables, and looked up for whole batches.
    phi_* and expected add up to the row's margin.
    """
    n, kinds = len(model.features), dict(df.dtypes)
    made = [_leaf_tables(t) for t in model.trees]
    leaves, expected = [x for t, _ in made for x in t], model.base + sum(m for _, m in made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, n)
            out = np.zeros((len(x), n))
            for leaf in leaves:
                passed = np.ones((len(leaf.features), len(x)), bool)
                for j, cut, missing_left, left in leaf.splits:
                    v = x[:, leaf.features[j]]
                    passed[j] &= np.where(np.isnan(v), missing_left, v <= cut) == left
                pattern = (passed * (1 << np.arange(len(leaf.features)))[:, None]).sum(axis=0)
                out[:, leaf.features] += leaf.table[pattern]
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *(pa.array(out[:, i]) for i in range(n)), pa.array(np.full(len(x), expected))], [*(f"k{i}" for i in range(len(keys))), *(f"p{i}" for i in range(n)), "expected"])

    picked = df.select(*_inputs(df, model.features), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    schema = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), *(f"p{i} double" for i in range(n)), "expected double"])
    return picked.mapInArrow(run, schema).toDF(*keys, *(f"phi_{f}" for f in model.features), "expected")
