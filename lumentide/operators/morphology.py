"""Operations on an image in one place, in numpy: what tiles do inside, textures, own segmentation models (an image to a task)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def shifted_or(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a disc, of one image or of each in a stack (the last two axes are rows and columns)."""
    out = mask.copy()
    high, flat = mask.shape[-2], ((0, 0),) * (mask.ndim - 1)
    for dy in range(-radius, radius + 1):
        w = int((radius * radius - dy * dy) ** 0.5)
        row = np.zeros_like(mask)
        a, b = max(0, dy), high + min(0, dy)
        row[..., a:b, :] = mask[..., a - dy : b - dy, :]
        c = np.cumsum(np.pad(row, (*flat, (w + 1, w))), axis=-1, dtype=np.int32)
        out |= c[..., 2 * w + 1 :] > c[..., : -2 * w - 1]
    return out


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    """Erosion by a disc; outside the image counts as inside."""
    return ~shifted_or(~mask, radius)


def least_linked(many: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of the nodes 0 to many - 1 reaches by the edges a - b.

    Each round hangs every root on the least root beside it, then every node on its root.
    """
    root = np.arange(many)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """4-connected (or 8-connected) components, numbered from 1 by their first pixels in row order, by runs that touch those of the row above."""
    wide = mask.shape[1] + 1  # an empty column ends the runs of each row
    cells = np.pad(mask, ((0, 0), (0, 1))).ravel()
    edge = np.flatnonzero(np.diff(cells.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    low = np.searchsorted(end, start - wide - eight, side="right")
    many = np.maximum(np.searchsorted(start, end - wide + eight, side="left") - low, 0)
    run = np.repeat(np.arange(len(start)), many)
    above = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + low[run]
    number = np.unique(least_linked(len(start), above, run), return_inverse=True)[1] + 1
    out = np.zeros(len(cells), np.int64)
    out[cells] = np.repeat(number, end - start)
    return out.reshape(len(mask), wide)[:, :-1]


def thinned(mask: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Peels pixels off a mask, or off each in a stack, in two alternating phases until lines are left (or some rounds only); what lies outside is empty.

    A pixel goes if it has two to six neighbours in one unbroken arc, and, by the phase, an empty neighbour to the south and east or to the north and
    west (a published parallel thinning).
    """
    grid = np.pad(mask.astype(bool), (*((0, 0),) * (mask.ndim - 2), (1, 1), (1, 1)))
    done = 0
    while rounds is None or done < rounds:
        before = grid.copy()
        for phase in (0, 1):
            n, e, s, w = grid[..., :-2, 1:-1], grid[..., 1:-1, 2:], grid[..., 2:, 1:-1], grid[..., 1:-1, :-2]
            around = [n, grid[..., :-2, 2:], e, grid[..., 2:, 2:], s, grid[..., 2:, :-2], w, grid[..., :-2, :-2]]
            many = sum(x.astype(np.int8) for x in around)
            arcs = sum((~a & b).astype(np.int8) for a, b in zip(around, [*around[1:], around[0]], strict=True))
            free = ~(n & e & s) & ~(e & s & w) if phase == 0 else ~(n & e & w) & ~(n & s & w)
            grid[..., 1:-1, 1:-1] &= ~((many >= 2) & (many <= 6) & (arcs == 1) & free)
        done += 1
        if (grid == before).all():
            break
    return grid[..., 1:-1, 1:-1]


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel of the mask to the nearest pixel outside it (exact, by lower envelopes of parabolas)."""
    far = 1e12

    def line(f: np.ndarray) -> np.ndarray:
        n = len(f)
        v, z, k = np.zeros(n, np.int64), np.zeros(n + 1), 0
        z[0], z[1] = -np.inf, np.inf
        for q in range(1, n):
            while True:
                s = ((f[q] + q * q) - (f[v[k]] + v[k] * v[k])) / (2 * q - 2 * v[k])
                if s > z[k] or k == 0 and s <= z[0]:
                    break
                k -= 1
            k += 1
            v[k], z[k], z[k + 1] = q, s, np.inf
        at = np.searchsorted(z[1 : k + 1], np.arange(n))
        return (np.arange(n) - v[at]) ** 2 + f[v[at]]

    d = np.where(mask, far, 0.0)
    d = np.apply_along_axis(line, 0, d)
    return np.sqrt(np.minimum(np.apply_along_axis(line, 1, d), far))


def colony(mask: np.ndarray, dilate: int = 8, close: int = 12, holes: int = 20000, least: int = 15000) -> np.ndarray:
    """The region around dense objects: dilated, closed, small holes filled, small parts dropped, the largest kept; if none is left, the largest raw part."""
    region = eroded(shifted_or(shifted_or(mask, dilate), close), close)
    gaps = components(~region)
    size = np.bincount(gaps.ravel())
    region |= (gaps > 0) & (size[gaps] <= holes)
    parts = components(region)
    size = np.bincount(parts.ravel())
    size[0] = 0
    if len(size) > 1 and size.max() >= least:
        return parts == size.argmax()
    raw = components(mask)
    size = np.bincount(raw.ravel())
    size[0] = 0
    return raw == size.argmax() if len(size) > 1 else mask


def _grid(frame: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(frame["row"].min()), int(frame["col"].min())
    out = np.zeros((int(frame["row"].max()) - r0 + 1, int(frame["col"].max()) - c0 + 1), frame[value].dtype)
    out[frame["row"] - r0, frame["col"] - c0] = frame[value]
    return out, r0, c0


def texture(px: DataFrame, bins: int = 18, share: float = 0.5) -> DataFrame:
    """Of each image: tissue share (above the median of what has signal), entropy of gradient orientations (bits, weighted by size), and
    structure-tensor coherence."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = _grid(frame.assign(v=frame["v"].astype(float)), "v")[0]
        gy, gx = np.gradient(v) if min(v.shape) > 1 else (np.zeros_like(v), np.zeros_like(v))
        size, angle = np.hypot(gy, gx), np.mod(np.arctan2(gy, gx), np.pi)
        w = np.bincount(np.minimum((angle / np.pi * bins).astype(int), bins - 1).ravel(), size.ravel(), bins)
        p = w[w > 0] / w.sum() if w.sum() > 0 else np.ones(1)
        a, b, c = (gx * gx).mean(), (gy * gy).mean(), (gx * gy).mean()
        signal = v[v > 0]
        tissue = float((v > np.quantile(signal, share)).mean()) if len(signal) else 0.0
        coherence = float(np.hypot(a - b, 2 * c) / (a + b)) if a + b > 0 else 0.0
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "tissue": [tissue], "orientation_bits": [float(-(p * np.log2(p)).sum())], "coherence": [coherence]})

    return px.groupBy("image_id").applyInPandas(run, "image_id string, tissue double, orientation_bits double, coherence double")


def segmented(images: DataFrame, model, schema: str = "image_id string, row int, col int, label int", **parameters) -> DataFrame:
    """Label pixels by an own model: model.eval(image, **parameters) gives an integer array of the image's shape. images: pixel tables by image_id."""
    names = set(parameters)
    if clash := names & set(getattr(model, "parameters", {})):
        raise ValueError(f"parameters given twice: {sorted(clash)}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid, r0, c0 = _grid(frame, "v")
        labels = np.asarray(model.eval(grid, **parameters))
        if labels.shape != grid.shape or not np.issubdtype(labels.dtype, np.integer) or (labels < 0).any():
            raise ValueError("a segmentation must be a non-negative integer array of the image's shape")
        r, c = np.indices(labels.shape)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": (r + r0).ravel().astype("int32"), "col": (c + c0).ravel().astype("int32"), "label": labels.ravel().astype("int32")})

    return images.groupBy("image_id").applyInPandas(run, schema)
