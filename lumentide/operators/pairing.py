"""Pairing of files, objects and tables: keys made alike, fallbacks, one-to-one matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentide.operators.joins import assert_unique, first_per_key


def paired(main: DataFrame, other: DataFrame, key: str, path: str = "path", name: str = "partner") -> DataFrame:
    """Every row of main with the path of its partner by key, and a status; repeated keys on either side are an error."""
    assert_unique(main, [key])
    assert_unique(other, [key])
    j = main.join(other.select(key, F.col(path).alias(name)), key, "left")
    return j.withColumn("status", F.when(F.col(name).isNull(), f"missing_{name}").otherwise("ok"))


def paired_by_name_or_key(main: DataFrame, other: DataFrame, exact: str, key: str, path: str = "path") -> DataFrame:
    """Partners by exact name first, then by key (the first path of each); status exact, key or missing."""
    first = lambda c: first_per_key(other.where(F.col(c).isNotNull()), [c], [path]).select(c, F.col(path).alias(f"_{c}"))
    j = main.join(first(exact), exact, "left").join(first(key), key, "left")
    a, b = F.col(f"_{exact}"), F.col(f"_{key}")
    return j.withColumn("partner", F.coalesce(a, b)).withColumn("status", F.when(a.isNotNull(), "exact").when(b.isNotNull(), "key").otherwise("missing")).drop(f"_{exact}", f"_{key}")


def contained(left: DataFrame, right: DataFrame, key: str, path: str, shingle: int = 4) -> DataFrame:
    """Each left key with the first path whose key contains it or is contained in it.

    Pairs are made only where the shorter key's first `shingle` characters stand in the longer one; keys shorter than
    that are held by whole key. So the candidates come from an equi-join, not from all pairs.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - shingle + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(shingle))))
    l = left.select(F.col(key).alias("l")).distinct()  # noqa: E741
    r = right.select(F.col(key).alias("r"), F.col(path).alias("path"))
    head = lambda c: F.substring(c, 1, shingle)
    inside = l.withColumn("g", head("l")).join(r.withColumn("g", F.explode(grams(F.col("r")))), "g").where(F.contains("r", "l"))
    around = l.withColumn("g", F.explode(grams(F.col("l")))).join(r.withColumn("g", head("r")), "g").where(F.contains("l", "r"))
    found = inside.select("l", "path").unionByName(around.select("l", "path")).groupBy("l").agg(F.min("path").alias("path"))
    return left.join(found.withColumnRenamed("l", key), key, "left")


def best_focus(scores: DataFrame, group: list[str], plane: str, score: str, keep_top: float = 0.5, ratio: float = 1.08, diff: float = 0.0005) -> DataFrame:
    """Best and second plane of each group, and whether the best passes: among the top share of all best ones, and ahead of the second by ratio and difference."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), plane)
    top = scores.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    at = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c)))
    best = top.groupBy(*group).agg(at(1, plane).alias("best"), at(2, plane).alias("second"), at(1, score).alias("best_score"), F.coalesce(at(2, score), F.lit(0.0)).alias("second_score"))
    best = best.withColumn("ratio", F.col("best_score") / (F.col("second_score") + 1e-12)).withColumn("diff", F.col("best_score") - F.col("second_score"))
    limit = best.agg(F.percentile("best_score", 1 - keep_top).alias("_limit"))
    return best.crossJoin(F.broadcast(limit)).withColumn("keep", (F.col("best_score") >= F.col("_limit")) & (F.col("ratio") >= ratio) & (F.col("diff") >= diff)).drop("_limit")


def overlap_matches(flat: DataFrame, plane: DataFrame, keys: list[str], fraction: float, iou: float) -> DataFrame:
    """The label of `plane` that each label of `flat` overlaps most (ties: the lower), with its share and IoU, and why it is rejected.

    Both are pixel tables: keys (image, ...), row, col, label. Rejected, in this order: nothing overlaps, too small a
    share, too small an IoU, or another object matches the same label better.
    """
    a, b = flat.where("label > 0"), plane.where("label > 0")
    area, cross = (x.groupBy(*keys, "label").agg(F.count("*").alias(n)) for x, n in ((a, "area"), (b, "cross")))
    both = a.select(*keys, "row", "col", "label").join(b.select(*keys, "row", "col", F.col("label").alias("match")), [*keys, "row", "col"])
    n = both.groupBy(*keys, "label", "match").agg(F.count("*").alias("overlap"))
    best = first_per_key(n, [*keys, "label"], [F.desc("overlap"), "match"])
    j = area.join(best, [*keys, "label"], "left").join(cross.withColumnRenamed("label", "match"), [*keys, "match"], "left")
    j = j.select(*keys, "label", F.coalesce("match", F.lit(0)).alias("match"), F.coalesce(F.col("overlap") / F.col("area"), F.lit(0.0)).alias("fraction"), F.coalesce(F.col("overlap") / (F.col("area") + F.col("cross") - F.col("overlap")), F.lit(0.0)).alias("iou"))
    why = F.when(F.col("match") == 0, "no_overlap").when(F.col("fraction") < fraction, "low_overlap_fraction").when(F.col("iou") < iou, "low_iou")
    return one_to_one(j.withColumn("reason", why), [*keys, "match"], [F.desc("iou"), F.desc("fraction"), "label"], "duplicate_match")


def one_to_one(matches: DataFrame, target: list[str], order: list, reason: str) -> DataFrame:
    """Of the accepted rows (null reason) of one target only the best stays; the others get the reason."""
    w = Window.partitionBy(*target, F.col("reason").isNull()).orderBy(*order)
    worse = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return matches.withColumn("reason", F.when(worse, reason).otherwise(F.col("reason")))


def best_plane(pixels: DataFrame, planes: DataFrame, image: str, plane: str) -> DataFrame:
    """The plane each image correlates with best over the same pixels, the second, and the margin; undefined correlations are left out."""
    j = pixels.select(image, "row", "col", F.col("v").alias("a")).join(planes.select(plane, "row", "col", F.col("v").alias("b")), ["row", "col"])
    r = j.groupBy(image, plane).agg((F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("r")).where("r IS NOT NULL")
    top = r.withColumn("_k", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(F.round("r", 12)), plane))).where("_k <= 2")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    return top.groupBy(image).agg(at(1, plane).alias("best"), at(1, "r").alias("r"), at(2, plane).alias("second"), (at(1, "r") - at(2, "r")).alias("margin"))


def checked_inner(a: DataFrame, b: DataFrame, keys: list[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """Inner join one to one; the column that both have must agree."""
    assert_unique(a, keys)
    assert_unique(b, keys)
    j = a.join(b.withColumnRenamed(column, "_again"), keys)
    off = F.abs(F.col(column) - F.col("_again")) > tolerance
    return j.withColumn(column, F.when(off, F.raise_error(F.lit(f"{column} differs"))).otherwise(F.col(column))).drop("_again")


def zipped(left: DataFrame, right: DataFrame, order: Column | str, other_order: Column | str) -> DataFrame:
    """Rows side by side in their orders; only tables of equal length, and only on demand: a key is the right way."""
    if left.count() != right.count():
        raise ValueError("tables of unequal length can't be joined by row order")
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(o)))
    return number(left, order).join(number(right, other_order), "_n").drop("_n")


def parse_folders(df: DataFrame, name: str, groups: tuple[str, ...] = ("Ctrl", "HA1", "HA2")) -> DataFrame:
    """Group, seeding density and export number from a sample folder's name, and whether it could be read."""
    pattern = rf"^({'|'.join(groups)})-(2_5|5|7_5|10)-(40)-Image Export-([0-9]+)$"
    ok = F.col(name).rlike(pattern)
    part = lambda i: F.when(ok, F.regexp_extract(name, pattern, i))
    density = 1000 * F.replace(part(2), F.lit("_"), F.lit(".")).cast("double")
    return df.withColumns({"exposure": part(1), "density": density, "export_index": part(4).cast("int"), "status": F.when(ok, "ok").otherwise("unrecognised")})


def design_grid(groups: DataFrame, densities: list[float]) -> DataFrame:
    """Every group (group_name, hours) at every density of a list."""
    return groups.withColumn("density", F.explode(F.array(*map(F.lit, densities)))).select("group_name", "density", "hours")


def by_prefix(c: Column, rules: list[tuple[str, str]], other: str = "unclassified") -> Column:
    """The category of the first prefix that fits."""
    out = F.when(c.startswith(rules[0][0]), rules[0][1])
    for prefix, name in rules[1:]:
        out = out.when(c.startswith(prefix), name)
    return out.otherwise(other)


def match_summary(scores: DataFrame, sample: str, candidate: str, score: str, least: float) -> DataFrame:
    """Best and second score of each sample and the share of candidates above a limit."""
    w = Window.partitionBy(sample).orderBy(F.desc(score), candidate)
    r = scores.withColumn("_k", F.row_number().over(w))
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    return r.groupBy(sample).agg(at(1, candidate).alias("best"), at(1, score).alias("best_score"), at(2, score).alias("second_score"), (F.count_if(F.col(score) > least) / F.count("*")).alias("matched"))
