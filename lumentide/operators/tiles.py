"""Operations on whole images of any size, cut into tiles: components, colony regions, exact distances.

Images are pixel tables (image_id, row, col, ...). A call has a tile, with a halo where an operation looks around it, or, where
tiles are small, a stack of them that are near each other; what crosses tiles is joined afterwards, so no image is in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .morphology import components, eroded, least_linked, shifted_or, thinned
from .tables import ROWS_A_TASK, parts, stored

#: Pixels of a tile's side.
TILE = 256
#: Columns or rows of an image that a task has at a time for distances.
STRIPE = 32
#: Tiles of the side of a block whose links are followed in one call.
BLOCK = 64
_KEY = ["image_id", "row", "col"]


def linked(edges: DataFrame, side: int = BLOCK * TILE) -> DataFrame:
    """(image_id, node, comp) of all nodes of edges (image_id, a, b): comp is the least node reachable. Nodes are row * 2^31 + col.

    The edges that begin in a block of side x side pixels are followed in one call; what is left are links between the least nodes of those
    trees that share a node, of which there are few, as trees are near each other.
    """
    kind = dict(edges.dtypes)["image_id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node, at = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "node": node, "root": node[least_linked(len(node), a, b)]})

    block = [F.floor(F.shiftright("a", 31) / side), F.floor(F.col("a").bitwiseAND((1 << 31) - 1) / side)]
    trees = edges.groupBy("image_id", *block).applyInPandas(run, f"image_id {kind}, node long, root long")
    trees = stored(trees.withColumn("least", F.min("root").over(Window.partitionBy("image_id", "node"))), "trees")
    between = stored(trees.where("root <> least").select("image_id", F.col("least").alias("a"), F.col("root").alias("b")).distinct(), "links")
    own = trees.select("image_id", "node", F.col("least").alias("root")).distinct()
    if between.isEmpty():
        return own.withColumnRenamed("root", "comp")
    far = _linked_in_rounds(between).withColumnRenamed("node", "root")
    return own.join(far, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("comp", "root").alias("comp"))


def _linked_in_rounds(edges: DataFrame) -> DataFrame:
    """As linked. Each round takes the least label among a node's neighbours, then that label's label, so paths shrink by more than half."""
    both = stored(edges.select("image_id", "a", "b").union(edges.select("image_id", "b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("image_id", F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = stored(labels.join(near, ["image_id", "node"]).select("image_id", "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "labels")
        far = step.select("image_id", F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = stored(step.join(far, ["image_id", "comp"]).select("image_id", "node", "old", F.col("far").alias("comp")), "labels")
        labels = step.drop("old")
        if step.where("old <> comp").isEmpty():
            return labels


def _tile(tile: int) -> list:
    return [F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx")]


def _in_stacks(rows: DataFrame, size: int, tasks: int):
    """rows of tiles (ty, tx) of size x size pixels, halos included, dealt to some tasks and grouped to what a call has: 4 TILE^2 pixels at most or one tile."""
    side = max(1, 2 * TILE // size)
    rows = rows.withColumn("by", F.floor(F.col("ty") / side)).withColumn("bx", F.floor(F.col("tx") / side))
    return rows.repartition(tasks, "image_id", "by", "bx").groupBy("image_id", "by", "bx")


def _stacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different tiles' ty and tx, and the place among them of each row's tile."""
    ty, tx = frame["ty"].to_numpy(np.int64), frame["tx"].to_numpy(np.int64)
    wide = tx.max() - tx.min() + 1
    tile, at = np.unique((ty - ty.min()) * wide + tx - tx.min(), return_inverse=True)
    return tile // wide + ty.min(), tile % wide + tx.min(), at


def tile_components(mask: DataFrame, tile: int = TILE, eight: bool = False, tasks: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The components of mask (image_id, row, col) inside each tile (image_id, row, col, component), and, if any touch over a tile's edge, the component
    comp of the image that each of those is part of (image_id, component, comp). A component of a tile has no more pixels than the tile. Without a number of tasks mask is counted."""
    kind = dict(mask.dtypes)["image_id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx, at = _stacked(frame)
        grid = np.zeros((len(ty) * (tile + 1), tile), bool)  # an empty row below each tile
        grid[at * (tile + 1) + frame["row"].to_numpy() - ty[at] * tile, frame["col"].to_numpy() - tx[at] * tile] = True
        y, x = np.nonzero(grid)
        at = y // (tile + 1)
        r, c = y % (tile + 1) + ty[at] * tile, x + tx[at] * tile
        own = components(grid, eight)[y, x]
        first = np.unique(own, return_index=True)[1]
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": r.astype("int32"), "col": c.astype("int32"), "component": (r << 31 | c)[first][own - 1]})

    tiles = mask.select(F.col("image_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumns({"ty": _tile(tile)[0], "tx": _tile(tile)[1]})
    local = stored(_in_stacks(tiles, tile, tasks or parts(tiles)).applyInPandas(run, f"image_id {kind}, row int, col int, component long"), "tile-components")
    side = lambda c, d: F.col(c) % tile == (tile - 1 if d > 0 else 0)
    border = local.where(side("row", 0) | side("row", 1) | side("col", 0) | side("col", 1))
    edges = None
    for dr, dc in ((1, 0), (0, 1), *(((1, 1), (1, -1)) if eight else ())):
        leaves = side("row", dr) if dr and not dc else side("col", dc) if dc and not dr else side("row", dr) | side("col", dc)
        here = border.where(leaves).select("image_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("component").alias("a"))
        found = here.join(border.select(*_KEY, F.col("component").alias("b")), _KEY).select("image_id", "a", "b")
        edges = found if edges is None else edges.union(found)
    edges = stored(edges.distinct(), "tile-edges")
    return local, None if edges.isEmpty() else linked(edges, BLOCK * tile).withColumnRenamed("node", "component")


def _named(local: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Rows of components of tiles with comp, the image's component."""
    if joined is None:
        return local.withColumn("comp", F.col("component"))
    return local.join(joined, ["image_id", "component"], "left").withColumn("comp", F.coalesce("comp", "component"))


def tiled_components(mask: DataFrame, tile: int = TILE, eight: bool = False) -> DataFrame:
    """The 4-connected (or 8-connected) component of each pixel of mask (image_id, row, col): component is row * 2^31 + col of its first pixel in row order.

    Tiles find their own components by runs; those that touch over a tile's edge are joined by the edge pixels alone.
    Rows and columns are not negative; repeated pixels count once; an empty table gives no rows.
    """
    return _named(*tile_components(mask, tile, eight)).select(*_KEY, F.col("comp").alias("component"))


def _with_halo(px: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each pixel with every tile (ty, tx) in which, or in whose halo, it lies."""
    px = px.select(F.col("image_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    reach = lambda c: F.explode(F.sequence(*(F.floor((F.col(c) + d) / tile).cast("int") for d in (-halo, halo))))
    return px.withColumn("ty", reach("row")).withColumn("tx", reach("col"))


def _bounds(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.min("row").cast("int").alias("r0"), F.max("row").cast("int").alias("r1"), F.min("col").cast("int").alias("c0"), F.max("col").cast("int").alias("c1"))


def closed_mask(px: DataFrame, dilate: int, close: int, tile: int = TILE) -> DataFrame:
    """Every pixel of each image's box with inside: whether it lies in the labels dilated by a disc, then closed by another.

    Outside the image nothing is dilated into, and nothing eroded from. A tile reads the labelled pixels of a halo of
    dilate + 2 close pixels around it.
    """
    kind = dict(px.dtypes)["image_id"]
    halo = dilate + 2 * close
    seeds = _with_halo(px.where("label > 0"), tile, halo)
    bounds = stored(_bounds(px), "image-bounds")
    every = bounds.select("image_id", F.explode(F.expr(f"sequence(r0 div {tile}, r1 div {tile})")).alias("ty"), "c0", "c1").select("image_id", "ty", F.explode(F.expr(f"sequence(c0 div {tile}, c1 div {tile})")).alias("tx"))
    rows = seeds.unionByName(every, allowMissingColumns=True).join(bounds, "image_id")
    inside_box = (F.col("ty") * tile <= F.col("r1")) & ((F.col("ty") + 1) * tile > F.col("r0")) & (F.col("tx") * tile <= F.col("c1")) & ((F.col("tx") + 1) * tile > F.col("c0"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx, at = _stacked(frame)
        r0, r1, c0, c1 = (int(frame[c].iloc[0]) for c in ("r0", "r1", "c0", "c1"))
        top, left, size = ty * tile - halo, tx * tile - halo, tile + 2 * halo
        r, c = top[:, None] + np.arange(size), left[:, None] + np.arange(size)
        valid = ((r >= r0) & (r <= r1))[:, :, None] & ((c >= c0) & (c <= c1))[:, None, :]
        mask = np.zeros((len(ty), size, size), bool)
        own = frame["row"].notna().to_numpy()
        at = at[own]
        mask[at, frame["row"].to_numpy()[own].astype(int) - top[at], frame["col"].to_numpy()[own].astype(int) - left[at]] = True
        region = shifted_or(shifted_or(mask, dilate) & valid, close) & valid
        region = eroded(region | ~valid, close) & valid
        at, r, c = np.nonzero(valid[:, halo : halo + tile, halo : halo + tile])
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": (r + ty[at] * tile).astype("int32"), "col": (c + tx[at] * tile).astype("int32"), "inside": region[at, r + halo, c + halo]})

    boxes = bounds.agg(F.sum((F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1))).first()[0] or 0
    tasks = max(px.sparkSession.sparkContext.defaultParallelism, -(-boxes // ROWS_A_TASK))
    return _in_stacks(rows.where(inside_box), tile + 2 * halo, tasks).applyInPandas(run, f"image_id {kind}, row int, col int, inside boolean")


def colony_support(px: DataFrame, dilate: int = 8, close: int = 12, holes: int = 20000, least: int = 15000, tile: int = TILE) -> DataFrame:
    """Adds inside to px (image_id, row, col, label): whether a pixel lies in its image's colony region.

    The region around dense objects: labels dilated and closed by discs, holes of at most `holes` pixels filled, and the largest part
    kept (the first in row order on ties) if it has `least` pixels, else the largest part of the labels themselves.
    An image without labels has no region.
    """
    region = colony_region(px, dilate, close, holes, least, tile)
    return px.join(region.withColumn("inside", F.lit(True)), _KEY, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def _sizes(local: DataFrame, joined: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The components of tiles with comp, and each comp's pixels n."""
    own = stored(_named(local.groupBy("image_id", "component").agg(F.count("*").alias("n")), joined), "tile-sizes")
    return own.drop("n"), own.groupBy("image_id", "comp").agg(F.sum("n").alias("n"))


def _largest(sizes: DataFrame, least: int = 1) -> DataFrame:
    """(image_id, comp) of each image's largest component, if it has `least` pixels."""
    best = sizes.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("s"))
    return best.where(F.col("s.n") >= least).select("image_id", (-F.col("s.c")).alias("comp"))


def _pixels_of(local: DataFrame, own: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pixels of the chosen comps (image_id, comp), met by components of tiles, so that no key has an image's pixels."""
    return local.join(own.join(chosen, ["image_id", "comp"], "left_semi"), ["image_id", "component"], "left_semi").select(*_KEY)


def colony_region(px: DataFrame, dilate: int, close: int, holes: int, least: int, tile: int = TILE) -> DataFrame:
    """The pixels (image_id, row, col) of each image's colony region, as in colony_support, label or none."""
    labelled = px.where("label > 0").select("image_id").distinct()
    mask = stored(closed_mask(px.join(labelled, "image_id", "left_semi"), dilate, close, tile), "closed")
    tasks = parts(mask)
    gaps, joined = tile_components(mask.where(~F.col("inside")).select(*_KEY), tile, tasks=tasks)
    own, sizes = _sizes(gaps, joined)
    filled = mask.where("inside").select(*_KEY).union(_pixels_of(gaps, own, sizes.where(F.col("n") <= holes)))
    whole, joined = tile_components(filled, tile, tasks=tasks)
    own, sizes = _sizes(whole, joined)
    large = stored(_largest(sizes, least), "large")
    region = _pixels_of(whole, own, large)
    rest = px.where("label > 0").join(large, "image_id", "left_anti")
    if rest.isEmpty():
        return region
    raw, joined = tile_components(rest.select(*_KEY), tile, tasks=tasks)
    own, sizes = _sizes(raw, joined)
    return region.union(_pixels_of(raw, own, _largest(sizes)))


def _lower_envelope(cost: np.ndarray, at: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The least of cost + (x - at)^2 at each x of where, by the lower envelope of the parabolas; at and where ascend."""
    keep: list[int] = []
    starts: list[float] = []
    for q in range(len(at)):
        start = -np.inf
        while keep:
            v = keep[-1]
            start = ((cost[q] + at[q] ** 2) - (cost[v] + at[v] ** 2)) / (2 * (at[q] - at[v]))
            if start > starts[-1]:
                break
            keep.pop()
            starts.pop()
            start = -np.inf
        keep.append(q)
        starts.append(start)
    v = np.array(keep)[np.searchsorted(starts, where, side="right") - 1]
    return cost[v] + (where - at[v]) ** 2


def distances(region: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """The squared Euclidean distance, in pixels, of each pixel of region (image_id, row, col) to the nearest pixel that isn't in it: adds square.

    Separable: a task first has some columns of an image and looks along them, then some rows, where the parabolas over the
    columns' distances have a lower envelope. Pixels beside the region's, in no row of the table, are outside it; so is what is
    beyond the image. Repeated pixels count once; an empty table gives no rows.
    """
    kind = dict(region.dtypes)["image_id"]

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["col", "row"])
        r, c = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        new = np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1] + 1))
        run = np.cumsum(new) - 1
        first, last = r[new][run], r[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)][run]
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": r.astype("int32"), "col": c.astype("int32"), "g": np.minimum(r - first, last - r) + 1})

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, part in frame.sort_values(["row", "col"]).groupby("row", sort=False):
            c, g = part["col"].to_numpy(np.int64), part["g"].to_numpy(np.int64)
            cut = np.flatnonzero(np.diff(c) > 1) + 1
            for x, h in zip(np.split(c, cut), np.split(g, cut), strict=True):  # what is past a pixel outside is no nearer than that
                at, cost = np.concatenate([[x[0] - 1], x, [x[-1] + 1]]), np.concatenate([[0], h * h, [0]])
                out.append(pd.DataFrame({"row": np.int32(row), "col": x.astype("int32"), "square": _lower_envelope(cost, at, x)}))
        return pd.concat(out).assign(image_id=frame["image_id"].iloc[0])[[*_KEY, "square"]]

    pixels = region.select(F.col("image_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    columns = pixels.groupBy("image_id", F.floor(F.col("col") / stripe)).applyInPandas(down, f"image_id {kind}, row int, col int, g long")
    return columns.groupBy("image_id", F.floor(F.col("row") / stripe)).applyInPandas(along, f"image_id {kind}, row int, col int, square long")


def edge_distances(px: DataFrame, um: float, diameter: float = 12.0, dilate: int = 8, close: int = 12, holes: int = 20000, least: int = 15000, tile: int = TILE) -> DataFrame:
    """Each label's median and least distance to the colony's edge in micrometres, and its status: outside, edge_band (within 2.4
    diameters or 16 um), inner (2.8 diameters or 18 um and more), or between. Pixels outside the region are at distance 0."""
    depth = distances(colony_region(px, dilate, close, holes, least, tile))
    own = px.where("label > 0").join(depth, _KEY, "left").withColumn("d", F.sqrt(F.coalesce("square", F.lit(0)).cast("double")) * um)
    out = own.groupBy("image_id", "label").agg(F.median("d").alias("edge_median"), F.min("d").alias("edge_least"))
    band, inner = max(16.0, 2.4 * diameter), max(18.0, 2.8 * diameter)
    m = F.col("edge_median")
    return out.withColumn("status", F.when(m <= 0, "outside").when(m <= band, "edge_band").when(m >= inner, "inner").otherwise("between"))


def skeleton(mask: DataFrame, tile: int = TILE, rounds: int = 16) -> DataFrame:
    """The pixels (image_id, row, col) that are left when mask is thinned to lines (morphology.thinned).

    A pass does `rounds` rounds in each tile, with a halo of two pixels for each round, in which what is beyond doesn't reach the tile; passes
    go on until nothing changes.
    """
    kind, halo = dict(mask.dtypes)["image_id"], 2 * rounds
    now = stored(mask.select("image_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct(), "skeleton")
    many = now.count()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx, at = _stacked(frame)
        grid = np.zeros((len(ty), tile + 2 * halo, tile + 2 * halo), bool)
        grid[at, frame["row"].to_numpy() - ty[at] * tile + halo, frame["col"].to_numpy() - tx[at] * tile + halo] = True
        at, r, c = np.nonzero(thinned(grid, rounds)[:, halo : halo + tile, halo : halo + tile])
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": (r + ty[at] * tile).astype("int32"), "col": (c + tx[at] * tile).astype("int32")})

    while many:
        near = -(-((tile + 2 * halo) ** 2) // tile**2)  # tiles that a pixel goes to
        now = stored(_in_stacks(_with_halo(now, tile, halo), tile + 2 * halo, parts(now, near)).applyInPandas(run, f"image_id {kind}, row int, col int"), "skeleton")
        many, before = now.count(), many
        if many == before:
            break
    return now


def skeleton_continuity(mask: DataFrame, tissue: DataFrame | None = None, tile: int = TILE, lengths: tuple[int, ...] = (20, 50)) -> DataFrame:
    """Of each image's edges, thinned to lines: pixels, the share of them in 8-connected lines of at least some lengths, the lines' median length,
    and, where the tissue's pixels are given, pixels for each 10,000 of these."""
    lines = tiled_components(skeleton(mask, tile), tile, eight=True).groupBy("image_id", "component").agg(F.count("*").alias("n"))
    share = [(F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"share_{k}") for k in lengths]
    out = lines.groupBy("image_id").agg(F.sum("n").alias("pixels"), F.count("*").alias("lines"), F.median("n").alias("median_length"), *share)
    if tissue is None:
        return out
    size = tissue.groupBy("image_id").agg(F.count("*").alias("_t"))
    return size.join(out, "image_id", "left").withColumn("per_10000", F.coalesce("pixels", F.lit(0)) * 10_000.0 / F.col("_t")).drop("_t")
