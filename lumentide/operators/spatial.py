"""Neighbours of points within fields, by grid cells; never all pairs of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentide.functions.measures import safe_div
from lumentide.operators.tables import stored

#: Distances that differ by no more than this are ties.
TIE = 1e-8


def _near_pairs(points: DataFrame, others: DataFrame, side) -> DataFrame:
    """Pairs (i, j) of one field whose cells touch, with their distance; side is a length or a column of both frames.

    The join is merged, as a broadcast of the points would have to fit into the driver, whatever their file's size.
    """
    side = F.col(side) if isinstance(side, str) else F.lit(side)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    a = points.select("field", F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), side.alias("side"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    a = a.withColumn("s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("s.dx"), "cy": F.col("cy") + F.col("s.dy")}).drop("s")
    b = others.select("field", F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("cx"), cell("y").alias("cy"))
    dist = F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))
    return a.join(b.hint("merge"), ["field", "cx", "cy"]).where("i <> j").select("field", "i", "j", "side", "xi", "yi", "xj", "yj", dist.alias("d"))


def within_radius(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (field, i, j, d) no farther apart than radius; points has field, id, x, y."""
    return _near_pairs(points, points, float(radius)).where(F.col("d") <= radius).drop("side")


def within_field_radius(points: DataFrame, radii: DataFrame) -> DataFrame:
    """Pairs (field, i, j, d) no farther apart than their field's radius (field, radius > 0)."""
    p = points.join(radii.where("radius > 0"), "field")
    return _near_pairs(p, p, "radius").where(F.col("d") <= F.col("side")).drop("side")


def nearest_pairs(points: DataFrame, k: int = 6) -> DataFrame:
    """Each point's k nearest others (fewer in small fields) and all that tie with the k-th within TIE.

    Returns field, i, j, d, rank (by distance, then id), r (the k-th distance), xi, yi, xj, yj.

    Each field's cells start at a side that holds about two thirds of k points. A point is settled if its k-th distance
    is less than the side, which bounds what the nine cells around it show. The few others are tried anew against all
    points with cells three times as large, until none is left or a cell holds the field. Each pass is stored.
    """
    fields = points.groupBy("field").agg(F.count("*").alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("extent"))
    fields = fields.select("field", F.least(F.col("n") - 1, F.lit(k)).alias("want"), "extent", (F.col("extent") * F.least(F.lit(1.0), F.sqrt(2.0 * k / 3 / F.col("n")))).alias("side"))
    fields = stored(fields, "fields")
    everyone = points.select("field", "id", "x", "y").join(fields, "field")
    todo, done, factor = everyone, None, 1.0
    near, order = Window.partitionBy("field", "i"), Window.partitionBy("field", "i").orderBy("d", "j")
    while True:
        wide = lambda df: df.withColumn("side", F.col("side") * factor)  # noqa: B023, E731
        pairs = _near_pairs(wide(todo), wide(everyone), "side").withColumn("rank", F.row_number().over(order))
        pairs = pairs.withColumn("r", F.max(F.when(F.col("rank") <= k, F.col("d"))).over(near)).where(F.col("d") <= F.col("r") + TIE)
        pairs = pairs.withColumn("got", F.max("rank").over(near)).join(fields.select("field", "want", "extent"), "field")
        pairs = stored(pairs.withColumn("settled", (F.col("side") > F.col("extent")) | ((F.col("got") >= F.col("want")) & (F.col("r") + 2 * TIE < F.col("side")))), "near")
        part = pairs.where("settled").drop("got", "want", "extent", "settled", "side")
        done = part if done is None else done.unionByName(part)
        known = part.select("field", F.col("i").alias("id")).distinct()
        todo = stored(todo.where("want > 0").where(F.col("side") * factor / 3 <= F.col("extent")).join(known, ["field", "id"], "left_anti"), "todo")
        if todo.isEmpty():
            return done
        factor *= 3


def k_nearest(points: DataFrame, k: int = 6) -> DataFrame:
    """The k nearest others of each point (fewer in small fields), by distance, then id: field, i, j, d, rank."""
    return nearest_pairs(points, k).where(F.col("rank") <= k).select("field", "i", "j", "d", "rank")


def neighbour_features(points: DataFrame, k: int = 6, features: tuple[str, ...] = ("area", "circularity", "eccentricity"), radius_factor: float = 2.5, diameter: str | None = "diameter") -> DataFrame:
    """What stands around each point (field, id, x, y, area, circularity, eccentricity and the columns of features).

    nn1, knn_mean, knn_std over exactly the k nearest; the neighbours are all within the k-th distance, ties included:
    their number, density, area fraction of the disc, median disagreement in log size and in shape, angular asymmetry
    (norm of the mean unit vector, coincident points left out), mean and std of each feature (0 for one neighbour). With
    `diameter`, also the number of points within radius_factor times the field's median diameter. A lone point has
    0 neighbours and nulls.
    """
    columns = [*dict.fromkeys(("area", "circularity", "eccentricity", *features))]
    own = points.select("field", F.col("id").alias("i"), *(F.col(c).alias(f"_{c}") for c in ("area", "circularity", "eccentricity")))
    other = points.select("field", F.col("id").alias("j"), *columns)
    pairs = nearest_pairs(points, k).join(other, ["field", "j"]).join(own, ["field", "i"])
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    unit = lambda a, b: F.avg(F.when(F.col("d") > 0, (F.col(a) - F.col(b)) / F.nullif(F.col("d"), F.lit(0.0))))
    first = F.when(F.col("rank") <= k, F.col("d"))
    disc = F.nullif(F.pi() * F.pow(F.max("r"), 2), F.lit(0.0))
    agg = pairs.groupBy("field", F.col("i").alias("id")).agg(
        F.count("*").alias("neighbours"), F.min("d").alias("nn1"), F.avg(first).alias("knn_mean"), F.when(F.count(first) == 1, 0.0).otherwise(F.stddev_samp(first)).alias("knn_std"),
        (F.count("*") / disc).alias("density"), (F.sum("area") / disc).alias("area_fraction"),
        F.median(F.abs(F.log(floor("area") / floor("_area")))).alias("size_disagreement"),
        F.median(F.sqrt(F.pow(F.col("circularity") - F.col("_circularity"), 2) + F.pow(F.col("eccentricity") - F.col("_eccentricity"), 2))).alias("shape_disagreement"),
        F.sqrt(F.pow(unit("xj", "xi"), 2) + F.pow(unit("yj", "yi"), 2)).alias("asymmetry"),
        *(e for f in features for e in (F.avg(f).alias(f"nb_{f}_mean"), F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp(f)).alias(f"nb_{f}_std"))),
    )
    out = points.select("field", "id").join(agg, ["field", "id"], "left")
    out = out.withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))
    if diameter is None:
        return out
    radii = points.groupBy("field").agg((radius_factor * F.median(diameter)).alias("radius"))
    fixed = within_field_radius(points, radii).groupBy("field", F.col("i").alias("id")).agg(F.count("*").alias("within"))
    return out.join(fixed, ["field", "id"], "left").withColumn("within", F.coalesce("within", F.lit(0)).cast("long"))


def composite_features(cells: DataFrame, by: str = "image_id") -> DataFrame:
    """Adds dimensionless shape and intensity features of cells: size against the image's median, elongation, boundary
    irregularity, convexity deficit, intensity CV and range ratio, nearest spacing in diameters. Floors are 1e-12."""
    c = F.col
    tiny = lambda x: F.greatest(x, F.lit(1e-12))
    medians = cells.groupBy(by).agg(F.median("area").alias("_median"))
    out = cells.join(medians, by, "left")
    added = {
        "size_log_ratio": F.log(tiny(c("area")) / tiny(c("_median"))),
        "elongation_log": F.log(F.greatest(c("aspect_ratio"), F.lit(1.0))),
        "boundary_irregularity": c("perimeter") / (2 * F.sqrt(F.pi() * tiny(c("area")))) - 1,
        "convexity_deficit": 1 - c("solidity"),
        "intensity_cv": c("intensity_std") / tiny(F.abs(c("intensity_mean"))),
        "intensity_range_ratio": c("intensity_range") / tiny(F.abs(c("intensity_mean"))),
        "spacing_units": safe_div(c("nn1"), c("diameter")),
    }
    return out.withColumns(added).drop("_median")
