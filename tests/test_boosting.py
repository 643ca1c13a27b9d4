"""Boosted trees against a plain loop, attributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from lumentide.models import boosting as B
from lumentide.plans import catalogue, models  # noqa: F401


def data(n=900, seed=4):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=n), r.integers(0, 6, n).astype(float), r.random(n)], axis=1)
    p = 1 / (1 + np.exp(-(2 * x[:, 0] + (x[:, 1] > 3) - 3 * (x[:, 2] > 0.8))))
    x[r.random((n, 3)) < 0.15] = np.nan  # missing, more often where the truth is 1
    y = (r.random(n) < p).astype(float)
    x[(y > 0) & (r.random(n) < 0.3), 2] = np.nan
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = data()
    rows = [(i, *(None if np.isnan(v) else float(v) for v in a), float(t), i % 4 == 0) for i, (a, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, held boolean").repartition(5)


def plain_fit(x, y, edges, base, rounds, depth, rate, l2, least):
    """Every split of every node tried, one after another."""
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree = {}

        def grow(node, rows, level):
            value = -rate * g[rows].sum() / (h[rows].sum() + l2)
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in edges[f]:
                    for missing in (True, False):
                        left = np.where(np.isnan(x[rows, f]), missing, x[rows, f] <= cut)
                        gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                        if min(hl, hr) < least:
                            continue
                        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2)
                        if gain > best[0] + 1e-9 * max(1, abs(best[0])):
                            best = (gain, (f, cut, missing, left))
            if best[1] is None:
                margin[rows] += value
                tree[node] = (-1, value)
                return
            f, cut, missing, left = best[1]
            tree[node] = (f, cut, missing)
            grow(2 * node + 1, rows[left], level + 1)
            grow(2 * node + 2, rows[~left], level + 1)

        grow(0, np.arange(len(y)), 0)
        trees.append(tree)
    return trees


def test_trees_equal_a_plain_loop(spark, table):
    x, y = data()
    model = B.fit(table, ["a", "b", "c"], "y", rounds=12, depth=3, bins=8)
    edges = [np.unique([r for r in table.approxQuantile(c, [i / 8 for i in range(1, 8)], 0.0)]) for c in "abc"]
    want = plain_fit(x, y, edges, np.log(y.mean() / (1 - y.mean())), 12, 3, 0.1, 1.0, 1.0)
    assert len(model.trees) == 12  # more than KEEP, so margins were stored once
    for tree, plain in zip(model.trees, want):
        for node, what in plain.items():
            assert tree.feature[node] == what[0]
            if what[0] < 0:
                assert abs(tree.value[node] - what[1]) < 1e-9
            else:
                assert tree.cut[node] == what[1] and tree.missing_left[node] == what[2]
    got = {r.id: r for r in B.scored(table, model, ["id"]).collect()}
    assert all(abs(got[i].margin - m) < 1e-9 for i, m in enumerate(model.margin(x)))
    assert ((np.array([got[i].probability for i in range(len(y))]) > 0.5) == (y > 0)).mean() > 0.75
    rows = {r.feature: r for r in B.importances(spark, model).collect()}
    for i, f in enumerate("abc"):
        nodes = [(t, j) for t in model.trees for j in np.flatnonzero(t.feature == i)]
        assert rows[f].weight == len(nodes) and abs(rows[f].total_gain - sum(t.gain[j] for t, j in nodes)) < 1e-9
        assert abs(rows[f].cover * max(1, len(nodes)) - sum(t.cover[j] for t, j in nodes)) < 1e-6


def test_attributions_equal_all_subsets(spark, table):
    x, _ = data()
    model = B.fit(table, ["a", "b", "c"], "y", rounds=4, depth=4, bins=8)

    def known(tree, row, some, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in some:
            left = tree.missing_left[node] if np.isnan(row[f]) else row[f] <= tree.cut[node]
            return known(tree, row, some, 2 * node + 2 - int(left))
        return sum(tree.cover[c] / tree.cover[node] * known(tree, row, some, c) for c in (2 * node + 1, 2 * node + 2))

    got = {r.id: r for r in B.attributions(table, model, ["id"]).collect()}
    for i in range(0, 900, 45):
        for f, name in enumerate("abc"):
            others = [j for j in range(3) if j != f]
            want = sum(factorial(k) * factorial(2 - k) / 6 * sum(known(t, x[i], {*s, f}) - known(t, x[i], {*s}) for t in model.trees) for k in range(3) for s in combinations(others, k))
            assert abs(got[i][f"phi_{name}"] - want) < 1e-9
    margins = model.margin(x)
    assert all(abs(got[i].phi_a + got[i].phi_b + got[i].phi_c + got[i].expected - margins[i]) < 1e-9 for i in range(900))


def test_early_stop_and_odd_tables(spark, table):
    model = B.fit(table, ["a", "c"], "y", rounds=30, depth=4, rate=0.5, held="held", patience=3)
    assert len(model.trees) == int(np.argmin(model.losses)) < 30
    assert B.fit(table.where("false"), ["a"], "y").trees == [] and B.fit(table.where("y = 1"), ["a"], "y").trees == []
    none = table.selectExpr("id", "cast(null as double) as a", "y", "a as y2")
    assert B.fit(none, ["a"], "y", rounds=2).trees == []
    nan = spark.createDataFrame([(float("nan"), 1.0), (1.0, 0.0), (2.0, 0.0), (None, 1.0)] * 20, "a double, y double")
    model = B.fit(nan, ["a"], "y", rounds=1, depth=1, bins=4)
    assert model.trees == [] or not np.isnan(model.trees[0].cut).any()
    assert B.attributions(nan, B.Forest(["a"], 0.5), []).first().expected == 0.5


def test_queries_add_up(spark, sf_dir):
    both = catalogue.QUERIES["tree_attributions"](spark, sf_dir).collect()
    assert both and all(abs(sum(r[c] for c in r.__fields__ if c.startswith("phi_")) + r.expected - r.margin) < 1e-4 for r in both)
    rows = catalogue.QUERIES["tree_importances"](spark, sf_dir).collect()
    assert {r.feature for r in rows} == {"chars", "marks", "words"} and sum(r.weight for r in rows) > 0
