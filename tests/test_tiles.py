"""Tiled images against versions that have the image in memory."""

import numpy as np
import pandas as pd
import pytest

from lumentide.operators import morphology as M
from lumentide.operators import tiles as T
from lumentide.plans import rasters


def table(spark, *grids):
    parts = []
    for i, g in enumerate(grids):
        r, c = np.indices(g.shape)
        parts.append(pd.DataFrame({"image_id": f"i{i}", "row": (r + 5 * i).ravel().astype("int32"), "col": (c + 3 * i).ravel().astype("int32"), "label": g.ravel().astype("int32")}))
    return spark.createDataFrame(pd.concat(parts))


def grids():
    r = np.random.default_rng(2)
    noise = (r.random((70, 90)) < 0.55).astype(int)
    spiral = np.zeros((60, 60), int)
    for k in range(0, 28, 4):
        spiral[k, k : 60 - k] = spiral[k : 60 - k, 59 - k] = spiral[59 - k, k : 60 - k] = spiral[k + 4 : 60 - k, k] = 1
        spiral[k + 4, k : k + 5] = 1
    return noise, spiral, (r.random((40, 130)) < 0.02).astype(int), np.zeros((20, 20), int), np.ones((33, 50), int)


def test_components_over_tiles(spark):
    some = grids()
    got = T.tiled_components(table(spark, *some).where("label > 0"), tile=16).toPandas()
    for i, g in enumerate(some):
        mine = got[got.image_id == f"i{i}"]
        assert len(mine) == g.sum()
        want = M.components(g > 0)
        own = want[mine.row - 5 * i, mine.col - 3 * i]
        first = (mine.row.astype("int64") * 2**31 + mine.col).groupby(own).transform("min")
        assert (mine.component == first).all()
    assert T.tiled_components(table(spark, some[3]).where("label > 0")).count() == 0


def test_distances_over_stripes(spark):
    some = grids()
    got = T.distances(table(spark, *some).where("label > 0"), stripe=7).toPandas()
    for i, g in enumerate(some):
        mine = got[got.image_id == f"i{i}"]
        out = np.argwhere(np.pad(g, 1) == 0)
        here = np.argwhere(np.pad(g, 1) > 0)
        want = {tuple(p - 1): int(((out - p) ** 2).sum(axis=1).min()) for p in here}
        assert {(r - 5 * i, c - 3 * i): s for r, c, s in zip(mine.row, mine.col, mine.square)} == want


@pytest.mark.parametrize("sizes", [(2, 3, 40, 100), (0, 0, 0, 1), (1, 9, 500, 10**6), (3, 5, 10**6, 1)])
def test_colony_equals_the_one_in_memory(spark, sizes):
    some = grids()
    names = ("dilate", "close", "holes", "least")
    got = T.colony_support(table(spark, *some), **dict(zip(names, sizes)), tile=16).toPandas()
    for i, g in enumerate(some):
        mine = got[got.image_id == f"i{i}"]
        want = M.colony(g > 0, *sizes) if g.any() or sizes[2] >= 1 else g > 0
        if not g.any():
            want = np.zeros_like(g, bool)
        assert len(mine) == g.size and (mine.inside == want[mine.row - 5 * i, mine.col - 3 * i]).all()


def test_queries_equal_the_image_in_memory(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    px = rasters._image(supplier).toPandas()
    grid = np.zeros((px.row.max() + 1, px.col.max() + 1), int)
    grid[px.row, px.col] = px.label
    region = M.colony(grid > 0, 2, 3, 40, 100)
    got = rasters.colony_support(supplier).toPandas()
    assert len(got) == len(px) and (got.inside == region[got.row, got.col]).all()
    depth = M.distance(np.pad(region, 1))[1:-1, 1:-1] * 0.5
    got = rasters.edge_distances(supplier).toPandas().set_index("label")
    assert set(got.index) == set(np.unique(grid)) - {0}
    for label, row in got.iterrows():
        d = depth[grid == label]
        assert abs(row.edge_median - np.median(d)) < 1e-6 and abs(row.edge_least - d.min()) < 1e-6
        assert row.status == ("outside" if np.median(d) <= 0 else "edge_band")


def test_skeletons_over_tiles(spark):
    some = (*grids(), M.shifted_or(grids()[2] > 0, 4).astype(int))
    px = table(spark, *some).where("label > 0")
    got = T.skeleton(px, tile=16, rounds=3).toPandas()
    lines = {r.image_id: r for r in T.skeleton_continuity(px, px, tile=16).collect()}
    for i, g in enumerate(some):
        mine = got[got.image_id == f"i{i}"]
        want = M.thinned(g > 0)
        assert sorted(zip(mine.row - 5 * i, mine.col - 3 * i)) == [tuple(x) for x in np.argwhere(want).tolist()]
        if g.any():
            sizes = np.bincount(M.components(want, eight=True).ravel())[1:]
            row = lines[f"i{i}"]
            assert (row.pixels, row.lines, row.median_length) == (sizes.sum(), len(sizes), np.median(sizes))
            assert abs(row.share_20 - sizes[sizes >= 20].sum() / sizes.sum()) < 1e-12 and abs(row.per_10000 - sizes.sum() / g.sum() * 1e4) < 1e-9


def test_thinning_keeps_what_is_connected():
    r = np.random.default_rng(5)
    for _ in range(20):
        mask = M.shifted_or(r.random((40, 50)) < 0.02, int(r.integers(1, 4)))
        thin = M.thinned(mask)
        assert not (thin & ~mask).any() and M.components(thin, True).max() == M.components(mask, True).max()
        assert (M.thinned(thin) == thin).all()
    bar = np.zeros((11, 40), bool)
    bar[3:8, 3:37] = True
    thin = M.thinned(bar)
    assert thin.sum(axis=0).max() == 1 and thin[5].sum() > 25 and thin.sum() == thin[5].sum()


def test_long_chains_are_linked_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(T, "stored", lambda df, name, keep=T.stored: (written.append(name), keep(df, name))[1])
    at = np.arange(3000, dtype="int64") * 24 << 31
    got = T.linked(spark.createDataFrame(pd.DataFrame({"image_id": "f", "a": at[:-1], "b": at[1:]}))).toPandas()
    assert sorted(got.node) == sorted(at) and (got.comp == 0).all()
    assert written.count("labels") < 10  # two for each round


def test_links_over_blocks(spark):
    r = np.random.default_rng(3)
    node = np.unique(r.integers(0, 200, 700) << 31 | r.integers(0, 200, 700))
    ends = r.integers(0, len(node), (2, 500))
    edges = pd.concat([pd.DataFrame({"image_id": i, "a": node[ends[0][part]], "b": node[ends[1][part]]}) for i, part in (("f", slice(None)), ("g", slice(0, 250)))])
    got = T.linked(spark.createDataFrame(edges), side=20).toPandas()
    for i, mine in got.groupby("image_id"):
        some = edges[edges.image_id == i]
        a, b = np.searchsorted(node, some.a), np.searchsorted(node, some.b)
        own = np.unique(np.concatenate([a, b]))
        want = dict(zip(node[own], node[M.least_linked(len(node), a, b)[own]]))
        assert len(mine) == len(want) and dict(zip(mine.node, mine.comp)) == want


def test_images_of_several_stacks_of_tiles(spark):
    r = np.random.default_rng(8)
    some = ((r.random((40, 1100)) < 0.03).astype(int), (r.random((400, 15)) < 0.65).astype(int))
    sizes = (2, 3, 40, 7000)  # the first has a part as large, the second hasn't
    got = T.colony_support(table(spark, *some), *sizes, tile=16).toPandas()
    for i, g in enumerate(some):
        mine, want = got[got.image_id == f"i{i}"], M.colony(g > 0, *sizes)
        assert len(mine) == g.size and (mine.inside == want[mine.row - 5 * i, mine.col - 3 * i]).all() and (want.sum() >= 7000) == (i == 0)


def test_stacks_equal_their_images():
    r = np.random.default_rng(4)
    stack = r.random((5, 20, 31)) < 0.2
    for radius in (0, 1, 4):
        assert (M.shifted_or(stack, radius) == [M.shifted_or(g, radius) for g in stack]).all()
        assert (M.eroded(stack, radius) == [M.eroded(g, radius) for g in stack]).all()
    assert (M.thinned(M.shifted_or(stack, 1), 3) == [M.thinned(M.shifted_or(g, 1), 3) for g in stack]).all()


@pytest.mark.parametrize("eight", [False, True])
def test_components_against_a_flood(eight):
    r = np.random.default_rng(6)
    for mask in (*(r.random((17, 23)) < share for share in (0, 0.3, 0.55, 0.8, 1)), np.ones((1, 1), bool), r.random((1, 30)) < 0.5, r.random((30, 1)) < 0.5, *(g > 0 for g in grids())):
        want, many = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if want[y, x]:
                continue
            many += 1
            want[y, x], todo = many, [(y, x)]
            while todo:
                a, b = todo.pop()
                for p, q in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or abs(i) + abs(j) == 1):
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not want[p, q]:
                        want[p, q] = many
                        todo.append((p, q))
        assert (M.components(mask, eight) == want).all()
