"""Label images as pixel tables (image_id, row, col, label[, v]).

Joins of pixels or labels are merged (hint "merge"): Spark takes rows made by explode for as small as the table they are made of, and
would send them to the driver and to every executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentide.functions.cubes import CORNERS, cube_areas
from lumentide.operators.tables import dealt, parts, stored

#: Rows of an image that lie in one band.
_BAND = 64


def region_properties(px: DataFrame) -> DataFrame:
    """Area, centroid, box, axes and eccentricity from second moments, extent, and intensity of each label."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    g = px.where("label > 0").groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.avg(r).alias("centroid_row"), F.avg(c).alias("centroid_col"), F.min("row").alias("min_row"), (F.max("row") + 1).alias("max_row"), F.min("col").alias("min_col"), (F.max("col") + 1).alias("max_col"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.var_pop(r) + 1 / 12).alias("_a"), (F.var_pop(c) + 1 / 12).alias("_c"), F.covar_pop(r, c).alias("_b"),
    )
    root = F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, 2) + F.pow("_b", 2))
    big, small = (F.col("_a") + F.col("_c")) / 2 + root, (F.col("_a") + F.col("_c")) / 2 - root
    box = (F.col("max_row") - F.col("min_row")) * (F.col("max_col") - F.col("min_col"))
    return g.withColumns({"extent": F.col("area") / box, "major": 4 * F.sqrt(big), "minor": 4 * F.sqrt(F.greatest(small, F.lit(0.0))), "eccentricity": F.sqrt(F.greatest(1 - small / big, F.lit(0.0)))}).drop("_a", "_b", "_c")


def separate_touching(px: DataFrame) -> DataFrame:
    """Sets to 0 every pixel that has a pixel of another label among its eight neighbours."""
    steps = F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    near = px.where("label > 0").select("image_id", F.explode(steps).alias("s"), "row", "col", F.col("label").alias("other")).select("image_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "other")
    span = near.groupBy("image_id", "row", "col").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    hit = (F.col("label") > 0) & ((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))
    return px.join(span.hint("merge"), ["image_id", "row", "col"], "left").withColumn("label", F.when(F.coalesce(hit, F.lit(False)), F.lit(0)).otherwise(F.col("label"))).drop("lo", "hi")


def boundary(px: DataFrame) -> DataFrame:
    """Pixels that differ from the one below or the one to the right."""
    below = px.select("image_id", (F.col("row") - 1).alias("row"), "col", F.col("label").alias("_d"))
    right = px.select("image_id", "row", (F.col("col") - 1).alias("col"), F.col("label").alias("_r"))
    j = px.join(below.hint("merge"), ["image_id", "row", "col"], "left").join(right.hint("merge"), ["image_id", "row", "col"], "left")
    return j.where((F.col("label") != F.col("_d")) | (F.col("label") != F.col("_r"))).drop("_d", "_r")


def relabel(px: DataFrame) -> DataFrame:
    """Labels of each image made 1, 2, ... in order; 0 stays."""
    names = px.where("label > 0").select("image_id", "label").distinct()
    names = names.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy("label")))
    return px.join(names.hint("merge"), ["image_id", "label"], "left").withColumn("label", F.coalesce("_n", F.lit(0))).drop("_n")


def without_border(px: DataFrame, height: int, width: int) -> DataFrame:
    """Leaves out the labels that reach the image's border."""
    edge = px.where((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)).select("image_id", "label").distinct()
    return px.join(edge.hint("merge"), ["image_id", "label"], "left_anti")


def saturation_audit(px: DataFrame, by: str, v: str, top: float, floor: float, area: float) -> DataFrame:
    """Share of saturated pixels of all and of those with signal, share of empty ones, density of signal, and planes spanned."""
    x = F.col(v)
    share = lambda c: F.avg(c.cast("double"))
    signal = x > floor
    return px.groupBy(by).agg(share(x >= top).alias("saturated"), share(F.when(signal, x >= top)).alias("saturated_signal"), share(x <= floor).alias("empty"), (F.count_if(signal) * 10000 / F.lit(area)).alias("density"), (F.max("z") - F.min("z") + 1).cast("int").alias("span"))


def _offsets(steps: list[tuple[int, int]]):
    return F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in steps))


_FOUR, _DIAGONAL = [(-1, 0), (1, 0), (0, -1), (0, 1)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _banded(px: DataFrame, halo: int, copies: int) -> DataFrame:
    """Pixels with each band of rows in which, or within `halo` rows of which, they lie, dealt out by label and band.

    What is grouped by _k, label, band and more stays in its task, and no label goes through one task however high it is. _k, a hash of image, label
    and band, is what is dealt by: Spark deals again where it finds that the image's name is the same everywhere.
    """
    bands = F.array_distinct(F.array(*(F.floor((F.col("row") + d) / _BAND).cast("int") for d in (-halo, 0, halo))))
    px = px.withColumn("band", F.explode(bands))
    return dealt(px.withColumn("_k", F.xxhash64("image_id", "label", "band")), "_k", copies=copies)


def _at_home(px: DataFrame) -> DataFrame:
    return px.where(F.floor(F.col("row") / _BAND) == F.col("band"))


def _counted_neighbours(px: DataFrame, *kinds: list[tuple[int, int]]) -> DataFrame:
    """The pixels of a banded table with _n0, _n1, ...: how many of their neighbours at each kind of steps carry the same label."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, some in enumerate([[(0, 0)], *kinds]) for r, c in some))
    key = ["_k", "image_id", "label", "band"]
    shifted = px.select(*key, F.explode(steps).alias("s"), "row", "col").select(*key, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("s.k").alias("k"))
    n = shifted.groupBy(*key, "row", "col").agg(F.max(F.col("k") == 0).alias("own"), *(F.count_if(F.col("k") == i + 1).alias(f"_n{i}") for i in range(len(kinds))))
    return n.where("own").drop("own")


def border_pixels(px: DataFrame) -> DataFrame:
    """Pixels of labels that have one of their four neighbours outside the label."""
    inner = _banded(px.where("label > 0").select("image_id", "label", "row", "col"), 1, 5)
    return _at_home(_counted_neighbours(inner, _FOUR).where("_n0 < 4")).select("image_id", "label", "row", "col")


def perimeters(px: DataFrame) -> DataFrame:
    """Perimeter of each label from its border pixels, each weighted by how its border neighbours stand: straight 1, diagonal
    root 2, mixed their mean (a published 4-neighbour estimate)."""
    inner = _banded(px.where("label > 0").select("image_id", "label", "row", "col"), 2, 5)
    b = _counted_neighbours(inner, _FOUR).where("_n0 < 4").drop("_n0")
    code = 1 + 2 * F.col("_n0") + 10 * F.col("_n1")
    # The weights of the estimate.
    weight = F.when(code.isin(5, 7, 15, 17, 25, 27), 1.0).when(code.isin(21, 33), F.sqrt(F.lit(2.0))).when(code.isin(13, 23), (1 + F.sqrt(F.lit(2.0))) / 2).otherwise(0.0)
    return _at_home(_counted_neighbours(b, _FOUR, _DIAGONAL)).groupBy("image_id", "label").agg(F.sum(weight).alias("perimeter"))


def hull_areas(px: DataFrame) -> DataFrame:
    """Pixels inside the convex hull of each label. Only the ends of each label's rows travel, as many as it is high."""

    @F.pandas_udf("long")
    def area(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for r, a, b in zip(rows, first, last, strict=True):
            r, a, b = (np.asarray(x, float) for x in (r, a, b))
            # corners of pixels, as the middles of their sides
            points = np.unique(np.concatenate([np.stack(p, 1) for p in ((r - 0.5, a), (r + 0.5, a), (r, a - 0.5), (r - 0.5, b), (r + 0.5, b), (r, b + 0.5))]), axis=0)

            def chain(ps):
                hull: list = []
                for p in ps:
                    while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]) <= 0:
                        hull.pop()
                    hull.append(p)
                return np.array(hull)

            one, two = chain(points), chain(points[::-1])[::-1]
            at = np.arange(r.min(), r.max() + 1)
            ends = np.stack([np.interp(at, h[:, 0], h[:, 1]) for h in (one, two)])
            low, high = ends.min(0), ends.max(0)
            out.append(int((np.floor(high + 1e-9) - np.ceil(low - 1e-9) + 1).sum()))
        return pd.Series(out)

    rows = px.where("label > 0").groupBy("image_id", "label", "row").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    lists = rows.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("row", "a", "b"))).alias("x"))
    return lists.select("image_id", "label", area(F.col("x.row"), F.col("x.a"), F.col("x.b")).alias("hull_area"))


def shape_properties(px: DataFrame) -> DataFrame:
    """region_properties with perimeter, circularity, equivalent diameter, aspect ratio and solidity."""
    out = region_properties(px).join(perimeters(px).hint("merge"), ["image_id", "label"], "left").join(hull_areas(px).hint("merge"), ["image_id", "label"], "left")
    area, perimeter = F.col("area"), F.col("perimeter")
    return out.withColumns({"diameter": F.sqrt(4 * area / F.pi()), "circularity": F.when(perimeter > 0, 4 * F.pi() * area / F.pow(F.nullif(perimeter, F.lit(0.0)), 2)), "aspect_ratio": F.when(F.col("minor") > 0, F.col("major") / F.nullif(F.col("minor"), F.lit(0.0))), "solidity": area / F.col("hull_area")})


def solid_properties(vx: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Volume, height, largest section, effective thickness, axes (4 sqrt of the covariance's eigenvalues), exposed surface and
    sphericity of each 3-D label, from one aggregate and closed forms. spacing: z, row, col. Surface is that of
    the polygons between voxel centres inside and outside the label (functions.cubes)."""
    dz, dy, dx = spacing
    z, y, x = (F.col(c) * s for c, s in (("z", dz), ("row", dy), ("col", dx)))
    v = vx.where("label > 0")
    key = ["image_id", "label"]
    section = v.groupBy(*key, "z").agg(F.count("*").alias("_s")).groupBy(*key).agg(F.max("_s").alias("_s"))
    g = v.groupBy(*key).agg(F.count("*").alias("n"), (F.max("z") - F.min("z") + 1).alias("_h"), F.avg(z).alias("centroid_z"), F.avg(y).alias("centroid_y"), F.avg(x).alias("centroid_x"), *(F.covar_samp(a, b).alias(n) for a, b, n in ((z, z, "a"), (y, y, "b"), (x, x, "c"), (z, y, "d"), (z, x, "e"), (y, x, "f"))))
    a, b, c, d, e, f = (F.coalesce(F.col(n), F.lit(0.0)) for n in "abcdef")
    q = (a + b + c) / 3
    p = F.sqrt((F.pow(a - q, 2) + F.pow(b - q, 2) + F.pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    half = F.when(p > 0, det / F.nullif(2 * F.pow(p, 3), F.lit(0.0))).otherwise(0.0)
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    big, small = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    axis = lambda w: 4 * F.sqrt(F.greatest(w, F.lit(0.0)))
    # cubes of 2 x 2 x 2 voxels: each voxel is a corner of eight
    corners = F.array(*(F.struct(F.lit(c[0]).alias("z"), F.lit(c[1]).alias("r"), F.lit(c[2]).alias("c"), F.lit(1 << i).alias("bit")) for i, c in enumerate(CORNERS)))
    # and a cube begins in its voxel's row or the one above; each is made in the band that it begins in
    near = _banded(v.select(*key, "z", "row", "col"), 1, 8).select("_k", *key, "band", "z", "row", "col").distinct()
    cubes = near.select("_k", *key, "band", F.explode(corners).alias("s"), "z", "row", "col").withColumn("row", F.col("row") - F.col("s.r"))
    cubes = _at_home(cubes).groupBy("_k", *key, "band", (F.col("z") - F.col("s.z")).alias("z"), "row", (F.col("col") - F.col("s.c")).alias("c")).agg(F.sum("s.bit").cast("int").alias("code"))
    areas = F.array(*map(F.lit, cube_areas(dz, dy, dx)))
    surface = cubes.groupBy(*key).agg(F.sum(F.get(areas, F.col("code"))).alias("surface"))
    out = g.join(section.hint("merge"), key).join(surface.hint("merge"), key, "left")
    volume = F.col("n") * dz * dy * dx
    return out.select(*key, volume.alias("volume"), (F.col("_h") * dz).alias("height"), (F.col("_s") * dy * dx).alias("max_section"), (volume / (F.col("_s") * dy * dx)).alias("thickness"), "centroid_z", "centroid_y", "centroid_x", axis(big).alias("axis_1"), axis(3 * q - big - small).alias("axis_2"), axis(small).alias("axis_3"), "surface", (F.pow(F.pi(), 1 / 3) * F.pow(6 * volume, 2 / 3) / F.nullif(F.col("surface"), F.lit(0.0))).alias("sphericity"), F.cbrt(6 * volume / F.pi()).alias("sphere_diameter"))


def sections(vx: DataFrame) -> DataFrame:
    """Each 3-D label's plane of the largest area (the lowest on ties), that area, and the area of its projection."""
    v = vx.where("label > 0")
    planes = v.groupBy("image_id", "label", "z").agg(F.count("*").alias("area"))
    best = planes.groupBy("image_id", "label").agg(F.max(F.struct("area", -F.col("z"))).alias("s")).select("image_id", "label", (-F.col("s.col2")).alias("z"), F.col("s.area").alias("area"))
    shadow = v.select("image_id", "label", "row", "col").distinct().groupBy("image_id", "label").agg(F.count("*").alias("projection"))
    return best.join(shadow.hint("merge"), ["image_id", "label"])


def without_faces(vx: DataFrame, depth: int, height: int, width: int) -> DataFrame:
    """Leaves out 3-D labels that reach any face of the stack."""
    at = lambda c, n: (F.col(c) == 0) | (F.col(c) == n - 1)
    edge = vx.where(at("z", depth) | at("row", height) | at("col", width)).select("image_id", "label").distinct()
    return vx.join(edge.hint("merge"), ["image_id", "label"], "left_anti")


def area_filter(px: DataFrame, um: float, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Pixels of labels whose area in square micrometres lies in a closed range, and each image's number and quartiles of them."""
    area = px.where("label > 0").groupBy("image_id", "label").agg((F.count("*") * um * um).alias("um2")).where(F.col("um2").between(low, high))
    whole = F.percentile("um2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = area.groupBy("image_id").agg(F.count("*").alias("n"), F.get(whole, F.lit(1)).alias("median"), F.get(whole, F.lit(0)).alias("q25"), F.get(whole, F.lit(2)).alias("q75"))
    return px.join(area.select("image_id", "label").hint("merge"), ["image_id", "label"], "left_semi"), stats


def _nearest(reach: DataFrame, at: list[str], label: str) -> DataFrame:
    """Of each place the least _d (an int) and, among those, the least label. One long is hashed where a struct would be sorted; label is the labels' type."""
    if label in ("int", "smallint", "tinyint"):
        m = reach.groupBy(*at).agg(F.min(F.shiftleft(F.col("_d").cast("long"), 32) + F.col("label")).alias("m"))
        return m.select(*at, F.shiftright("m", 32).cast("int").alias("_d"), (F.col("m") % F.lit(1 << 32)).cast(label).alias("label"))
    m = reach.groupBy(*at).agg(F.min(F.struct("_d", "label")).alias("m"))
    return m.select(*at, F.col("m._d").alias("_d"), F.col("m.label").alias("label"))


def expanded(px: DataFrame, distance: int) -> DataFrame:
    """Each pixel within `distance` of a label, with the nearest label (ties: the lowest); a label's own pixels are its own.

    Only border pixels reach out, each to its disc of steps; no image goes through one task.
    """
    inner = px.where("label > 0").select("image_id", "row", "col", "label", F.lit(0).alias("_d"))
    if distance < 1:
        return inner.drop("_d")
    steps = [(a, b) for a in range(-distance, distance + 1) for b in range(-distance, distance + 1) if 0 < a * a + b * b <= distance * distance]
    reach = border_pixels(px).select("image_id", "label", "row", "col", F.explode(_offsets(steps)).alias("s"))
    reach = reach.select("image_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "label", (F.col("s.r") * F.col("s.r") + F.col("s.c") * F.col("s.c")).alias("_d"))
    near = _nearest(inner.unionByName(reach), ["image_id", "row", "col"], dict(px.dtypes)["label"]).drop("_d")
    return near.join(px.select("image_id", "row", "col").hint("merge"), ["image_id", "row", "col"], "left_semi")  # inside the image


def ring_labels(px: DataFrame, outer: int, inner: int = 0) -> DataFrame:
    """Pixels of each label's ring: within outer, beyond inner, of no label themselves."""
    held = expanded(px, inner).select("image_id", "row", "col").hint("merge")
    return expanded(px, outer).join(held, ["image_id", "row", "col"], "left_anti")


def far_pixels(px: DataFrame, distance: int) -> DataFrame:
    """Pixels farther than `distance` from every label: each border pixel covers one interval in each row around, and along a row the farthest end of
    those that have begun tells whether a pixel is covered."""
    from math import isqrt

    spans = F.array(*(F.struct(F.lit(d).alias("r"), F.lit(isqrt(distance * distance - d * d)).alias("w")) for d in range(-distance, distance + 1)))
    reach = border_pixels(px).select("image_id", F.explode(spans).alias("s"), "row", "col")
    reach = reach.select("image_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") - F.col("s.w")).alias("_lo"), (F.col("col") + F.col("s.w")).alias("_hi"))
    free = px.where(~F.coalesce(F.col("label") > 0, F.lit(False))).withColumn("_lo", F.col("col"))
    both = free.unionByName(reach, allowMissingColumns=True).withColumn("_k", F.xxhash64("image_id", "row")).repartition(parts(px), "_k")
    both = both.withColumn("_e", F.max("_hi").over(Window.partitionBy("_k", "image_id", "row").orderBy("_lo")))
    return both.where(F.col("_hi").isNull() & (F.col("_e").isNull() | (F.col("_e") < F.col("col")))).select(*px.columns)


def background(px: DataFrame, distance: int, least: int = 100, share: float = 0.005, floor: float = 1.0) -> DataFrame:
    """Median and noise (1.4826 MAD, at least floor) of the pixels far from all labels, of each image; null if there are too few."""
    size = px.groupBy("image_id").agg(F.count("*").alias("size"))
    far = stored(far_pixels(px, distance).groupBy("image_id", "v").agg(F.count("*").alias("n")), "background-values")
    m = stored(far.groupBy("image_id").agg(F.sum("n").alias("pixels"), F.percentile("v", 0.5, F.col("n")).alias("bg")), "background-medians")
    mad = far.join(m, "image_id").groupBy("image_id").agg(F.percentile(F.abs(F.col("v") - F.col("bg")), 0.5, F.col("n")).alias("mad"))
    j = size.join(m, "image_id", "left").join(mad, "image_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))
    ok = F.col("pixels") >= F.greatest(F.lit(least), F.ceil(share * F.col("size")))
    return j.select("image_id", "pixels", ok.alias("adequate"), F.when(ok, F.col("bg")).alias("background"), F.when(ok, F.greatest(F.lit(floor), 1.4826 * F.col("mad"))).alias("noise"))


def marker_ratios(px: DataFrame, outer: int, distance: int, inner: int = 0, saturation: float = 255.0, snr: float = 3.0, least_pixels: int = 1, background_least: int = 100, sectors: int = 8) -> DataFrame:
    """Marker of each label against the ring around it: raw and background-corrected ratios, signal to noise, angular support.

    A raw ratio needs ring pixels and positive medians; a corrected one also an adequate background. qc_reasons tells
    why there is none; warnings never take a ratio away. Sectors count as supported with 3 pixels or more of which half
    are above background + snr x noise.
    """
    key = ["image_id", "label"]
    two = lambda n: (F.count("*").alias(f"{n}_px"), F.median("v").alias(f"{n}_median"), F.avg("v").alias(f"{n}_mean"), F.avg((F.col("v") >= saturation).cast("double")).alias(f"{n}_saturated"))
    inside = px.where("label > 0")
    nucleus = inside.groupBy(*key).agg(*two("nuclear"), F.avg(F.col("row").cast("double")).alias("_r"), F.avg(F.col("col").cast("double")).alias("_c"))
    ring = ring_labels(px, outer, inner).join(px.select("image_id", "row", "col", "v").hint("merge"), ["image_id", "row", "col"])
    bg = stored(background(px, distance, background_least), "backgrounds")
    around = ring.groupBy(*key).agg(*two("ring"))
    at = ring.join(nucleus.select(*key, "_r", "_c").hint("merge"), key).join(bg.select("image_id", "background", "noise"), "image_id")
    sector = F.least(F.lit(sectors - 1), F.floor((F.atan2(F.col("row") - F.col("_r"), F.col("col") - F.col("_c")) + F.pi()) / (2 * F.pi()) * sectors).cast("int"))
    above = (F.col("v") > F.col("background") + snr * F.col("noise")).cast("double")
    by_sector = at.groupBy(*key, sector.alias("sector")).agg(F.count("*").alias("n"), F.sum(above).alias("above"))
    support = by_sector.groupBy(*key).agg(F.count_if((F.col("n") >= 3) & (F.col("above") >= 0.5 * F.col("n"))).alias("supported_sectors"), (F.sum("above") / F.sum("n")).alias("signal_fraction"))
    j = nucleus.drop("_r", "_c").join(around.hint("merge"), key, "left").join(support.hint("merge"), key, "left").join(bg.drop("pixels"), "image_id", "left")
    positive = lambda a, b: F.when((a > 0) & (b > 0), a / F.nullif(b, F.lit(0.0)))
    n, r, b = F.col("nuclear_median"), F.col("ring_median"), F.col("background")
    sampled = F.coalesce(F.col("ring_px"), F.lit(0)) >= least_pixels
    ok = sampled & F.coalesce(F.col("adequate"), F.lit(False))
    why = F.concat_ws(";", F.when(~sampled, "no_sampling_pixels"), F.when(~F.coalesce(F.col("adequate"), F.lit(False)), "background_unavailable"), F.when(ok & ~(n - b > 0), "nonpositive_corrected_nuclear_signal"), F.when(ok & ~(r - b > 0), "nonpositive_corrected_denominator"))
    low = lambda x: (x - b) / F.nullif(F.col("noise"), F.lit(0.0)) > snr
    warn = F.concat_ws(";", F.when(F.greatest("nuclear_saturated", F.coalesce("ring_saturated", F.lit(0.0))) > 0.01, "export_intensity_clipping"), F.when(~low(n), "nuclear_signal_below_noise_gate"), F.when(~low(r), "denominator_below_noise_gate"), F.when(F.col("supported_sectors") < 6, "insufficient_angular_signal_support"))
    return j.select(
        *key, "nuclear_px", F.coalesce("ring_px", F.lit(0)).cast("long").alias("ring_px"), "nuclear_median", "ring_median", F.when(sampled, positive(n, r)).alias("raw_ratio"), F.when(ok, positive(n - b, r - b)).alias("ratio"), F.log2(F.when(ok, positive(n - b, r - b))).alias("log2_ratio"),
        ((n - b) / F.col("noise")).alias("nuclear_snr"), ((r - b) / F.col("noise")).alias("ring_snr"), F.coalesce("supported_sectors", F.lit(0)).cast("long").alias("supported_sectors"), "signal_fraction",
        F.when(why == "", "corrected_ratio_available_not_quality_validated").otherwise(why).alias("qc_reasons"), F.when(warn == "", "none").otherwise(warn).alias("qc_warnings"),
        *(((n - b > s * F.col("noise")) & (r - b > s * F.col("noise"))).alias(f"pass_snr_{s}") for s in (2, 3, 5)), *(F.when(ok, positive(n - b - o * F.col("noise"), r - b - o * F.col("noise"))).alias(f"ratio_{w}_noise") for o, w in ((-1, "minus"), (1, "plus"))),
    )


def two_channels(px: DataFrame) -> DataFrame:
    """Area and the intensities of both channels (v, v2) under one mask; pixels that one channel lacks are an error."""
    v = px.where("label > 0").withColumn("v2", F.coalesce("v2", F.raise_error(F.lit("channels differ in shape")).cast("double")))
    stats = [e for c, n in (("v", "one"), ("v2", "two")) for e in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"))]
    return v.groupBy("image_id", "label").agg(F.count("*").alias("area"), *stats)


def local_fraction(px: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Share of the disc around each point (image_id, id, row, col) that labels cover; outside the image counts as empty.

    Row prefix sums make each disc 2 radius + 1 differences, so no image is convolved in one task.
    """
    from math import isqrt

    rows = F.array(*(F.struct(F.lit(d).alias("r"), F.lit(isqrt(radius * radius - d * d)).alias("w")) for d in range(-radius, radius + 1)))
    w = Window.partitionBy("image_id", "row").orderBy("col")
    sums = px.select("image_id", "row", "col", F.sum((F.col("label") > 0).cast("long")).over(w).alias("s"))
    width = px.groupBy("image_id", "row").agg(F.min("col").alias("first"), F.max("col").alias("end"))
    p = points.select("image_id", "id", F.explode(rows).alias("s"), "row", "col").select("image_id", "id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") - F.col("s.w") - 1).alias("a"), (F.col("col") + F.col("s.w")).alias("b"))
    p = p.join(width.hint("merge"), ["image_id", "row"]).withColumn("b", F.least("b", "end"))
    end = p.join(sums.select("image_id", "row", F.col("col").alias("b"), F.col("s").alias("sb")).hint("merge"), ["image_id", "row", "b"], "left").join(sums.select("image_id", "row", F.col("col").alias("a"), F.col("s").alias("sa")).hint("merge"), ["image_id", "row", "a"], "left")
    disc = sum(2 * isqrt(radius * radius - d * d) + 1 for d in range(-radius, radius + 1))
    inside = end.groupBy("image_id", "id").agg(F.sum(F.coalesce("sb", F.lit(0)) - F.coalesce("sa", F.lit(0))).alias("n"))
    return points.select("image_id", "id").join(inside.hint("merge"), ["image_id", "id"], "left").select("image_id", "id", (F.coalesce("n", F.lit(0)) / F.lit(float(disc))).alias("fraction"))


def shell(vx: DataFrame, spacing: tuple[float, float, float], near: float, far: float) -> DataFrame:
    """Background voxels at near to far micrometres from their nearest 3-D label, with that label."""
    dz, dy, dx = spacing
    reach = [int(far / s + 1e-9) for s in spacing]
    steps = [(a, b, c, (a * dz) ** 2 + (b * dy) ** 2 + (c * dx) ** 2) for a in range(-reach[0], reach[0] + 1) for b in range(-reach[1], reach[1] + 1) for c in range(-reach[2], reach[2] + 1)]
    lengths = sorted({d for *_, d in steps if 0 < d <= far * far + 1e-9})
    moves = F.array(*(F.struct(F.lit(a).alias("z"), F.lit(b).alias("r"), F.lit(c).alias("c"), F.lit(lengths.index(d)).alias("d")) for a, b, c, d in steps if 0 < d <= far * far + 1e-9))
    out = vx.where("label > 0").select("image_id", "label", F.explode(moves).alias("s"), "z", "row", "col")
    out = out.select("image_id", (F.col("z") + F.col("s.z")).alias("z"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "label", F.col("s.d").alias("_d"))
    nearest = _nearest(out, ["image_id", "z", "row", "col"], dict(vx.dtypes)["label"]).where(F.col("_d") >= sum(d < near * near - 1e-9 for d in lengths))
    empty = vx.where("label = 0").select("image_id", "z", "row", "col", "v")
    return empty.join(nearest.hint("merge"), ["image_id", "z", "row", "col"]).select("image_id", "z", "row", "col", "v", "label")


def phenotype_mask(px: DataFrame, cells: DataFrame, height: int, width: int, buffer: int = 0) -> DataFrame:
    """The pixels of the labels in cells (image_id, label); others become 0. A wanted label at the image's edge is an error."""
    keep = px.join(cells.select("image_id", "label").distinct().withColumn("_k", F.lit(True)), ["image_id", "label"], "left")
    edge = (F.least("row", "col", height - 1 - F.col("row"), width - 1 - F.col("col")) < F.greatest(F.lit(buffer), F.lit(1))) & F.col("_k")
    label = F.when(F.coalesce(edge, F.lit(False)), F.raise_error(F.lit("a wanted label touches the edge")).cast("int")).when(F.col("_k"), F.col("label")).otherwise(0)
    return keep.withColumn("label", label).drop("_k")
