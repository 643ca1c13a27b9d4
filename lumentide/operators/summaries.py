"""Aggregations of measurement tables by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentide.functions.measures import finite, log2_ratio
from lumentide.operators.quantiles import exact_quantiles
from lumentide.operators.tables import dealt, stored


QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def population_summary(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Per group and feature: n, mean, median, std (null if n < 2), IQR, CV, q10 to q90; NaN and inf are left out, null groups kept."""
    aggs = [F.count("*").alias("n_cells")]
    for f in features:
        x = finite(F.col(f))
        whole = F.percentile(x, F.array(*map(F.lit, QUANTILES)))  # one buffer a column for all its quantiles
        q = {p: F.get(whole, F.lit(i)) for i, p in enumerate(QUANTILES)}
        sd = F.stddev_samp(x)
        aggs += [F.count(x).alias(f"{f}_n"), F.avg(x).alias(f"{f}_mean"), q[0.5].alias(f"{f}_median"), sd.alias(f"{f}_std"), (q[0.75] - q[0.25]).alias(f"{f}_iqr"), (sd / F.nullif(F.abs(F.avg(x)), F.lit(0.0))).alias(f"{f}_cv")]
        aggs += [q[p].alias(f"{f}_q{round(p * 100)}") for p in QUANTILES]
    return df.groupBy(*by).agg(*aggs)


def category_entropy(df: DataFrame, by: str, category: str) -> DataFrame:
    """Shares' entropy (nats) and number of categories in each group."""
    n = df.where(F.col(category).isNotNull()).groupBy(by, category).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return p.groupBy(by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.count("*").alias("n_categories"))


def field_descriptive(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long table: n, median, quartiles, IQR, mean, sd of each metric."""
    long = df.select(*by, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(by, metrics, "metric", "value")
    whole = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = lambda p: F.get(whole, F.lit(int(4 * p) - 1))
    return long.groupBy(*by, "metric").agg(F.count("value").alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), (q(0.75) - q(0.25)).alias("iqr"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def composition(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """Share of each category in each group, over the whole grid of groups and categories, absent ones 0."""
    n = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    grid = total.crossJoin(df.select(category).distinct())  # one row for each group and category, no rows of df
    return grid.join(n, [*by, category], "left").select(*by, category, F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def contrasts(summary: DataFrame, stratum: str, group: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences of a summarised value between groups in the same stratum: (treated, reference)."""
    spark = summary.sparkSession
    which = F.broadcast(spark.createDataFrame(pairs, "treated string, reference string"))  # a literal table
    a = summary.select(F.col(stratum), F.col(group).alias("treated"), F.col(value).alias("a"))
    b = summary.select(F.col(stratum), F.col(group).alias("reference"), F.col(value).alias("b"))
    d = a.join(which, "treated").join(b, [stratum, "reference"])
    return d.select(stratum, "treated", "reference", (F.col("a") - F.col("b")).alias("difference"), (100 * (F.col("a") - F.col("b")) / F.nullif(F.abs("b"), F.lit(0.0))).alias("percent_change"))


def control_effects(df: DataFrame, stratum: str, group: str, control: str, feature: str) -> DataFrame:
    """Each group's median less the stratum's control median, in control IQRs."""
    whole = F.percentile(feature, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = df.groupBy(stratum, group).agg(F.get(whole, F.lit(1)).alias("median"), (F.get(whole, F.lit(2)) - F.get(whole, F.lit(0))).alias("iqr"))
    c = q.where(F.col(group) == control).select(stratum, F.col("median").alias("cm"), F.col("iqr").alias("ci"))
    return q.join(c, stratum).select(stratum, group, ((F.col("median") - F.col("cm")) / F.when(F.col("ci") > 1e-12, F.col("ci"))).alias("effect"))


def dispersion(df: DataFrame, stratum: str, group: str, control: str, feature: str) -> DataFrame:
    """Median absolute deviation from the group's median, and its gain -log2(mad / control's)."""
    by = [stratum, group]
    centres = exact_quantiles(df, by, {"_m": F.col(feature)}, (0.5,)).select(*by, F.col("_m")[0].alias("_m"))  # a row for each group, joined back
    d = exact_quantiles(df.join(centres, by), by, {"mad": F.abs(F.col(feature) - F.col("_m"))}, (0.5,)).select(*by, F.col("mad")[0].alias("mad"))
    c = d.where(F.col(group) == control).select(stratum, F.col("mad").alias("_c"))
    return d.join(c, stratum, "left").select(stratum, group, "mad", (-log2_ratio(F.col("mad"), F.col("_c"))).alias("gain"))


def panel_dispersions(df: DataFrame, stratum: str, group: str, control: str, panels: dict[str, list[str]]) -> DataFrame:
    """For each named panel of features: the median distance of cells to their group's centre over control-scaled features, and its
    gain against the control. All panels come from the same scans.
    """
    features = list(dict.fromkeys(f for fs in panels.values() for f in fs))
    # Scaling is linear, so a group's scaled centre is that of its raw median: one aggregate tells scales and centres.
    quartiles = exact_quantiles(df, [stratum, group], {f"{f}_q": F.col(f) for f in features}, (0.25, 0.5, 0.75))
    scales = quartiles.where(F.col(group) == control).select(stratum, *((F.col(f"{f}_q")[2] - F.col(f"{f}_q")[0]).alias(f"{f}_i") for f in features))
    centres = stored(quartiles.select(stratum, group, *(F.col(f"{f}_q")[1].alias(f"{f}_c") for f in features)).join(scales, stratum), "centres")
    scaled = df.join(centres, [stratum, group])

    def distance(panel: list[str]) -> Column:
        parts = [F.when(F.col(f"{f}_i") > 1e-12, F.pow((F.col(f) - F.col(f"{f}_c")) / F.col(f"{f}_i"), 2)) for f in panel]
        n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
        s = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
        return F.when(n > 0, F.sqrt(s / n))

    d = exact_quantiles(scaled, [stratum, group], {f"_r{i}": distance(fs) for i, fs in enumerate(panels.values())}, (0.5,))
    d = stored(d.select(stratum, group, F.explode(F.array(*(F.struct(F.lit(name).alias("panel"), F.col(f"_r{i}")[0].alias("dispersion")) for i, name in enumerate(panels)))).alias("x")).select("x.panel", stratum, group, "x.dispersion"), "dispersions")
    c = d.where(F.col(group) == control).select("panel", stratum, F.col("dispersion").alias("_c"))
    return d.join(c, ["panel", stratum], "left").select("panel", stratum, group, "dispersion", (-log2_ratio(F.col("dispersion"), F.col("_c"))).alias("gain"))


def multivariate_dispersion(df: DataFrame, stratum: str, group: str, control: str, features: list[str]) -> DataFrame:
    """panel_dispersions of one panel."""
    return panel_dispersions(df, stratum, group, control, {"all": features}).drop("panel")


def upper_threshold(df: DataFrame, column: str, k: float = 3.0, fallback: float = 0.95) -> DataFrame:
    """median + k MAD, or a quantile where the MAD is 0."""
    m = exact_quantiles(df, [], {"m": F.col(column)}, (0.5, fallback)).select(F.col("m")[0].alias("m"), F.col("m")[1].alias("q"))
    d = exact_quantiles(df.crossJoin(F.broadcast(m)), [], {"mad": F.abs(F.col(column) - F.col("m"))}, (0.5,)).select(F.col("mad")[0].alias("mad")).crossJoin(m)
    return d.select("mad", F.when(F.col("mad") > 0, F.col("m") + k * F.col("mad")).otherwise(F.col("q")).alias("threshold"))


def log_log_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of log y on log x over positive pairs; R2 is null where y is constant."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log(x).alias("lx"), F.log(y).alias("ly"))
    r2 = F.try_divide(F.pow(F.covar_pop("lx", "ly"), 2), F.var_pop("lx") * F.var_pop("ly"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), r2.alias("r2"))


def average_rank(c: str, *by: str) -> Column:
    """Rank within the group, ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null for fewer than 3 pairs or a constant side."""
    sx, sy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count("*") >= 3) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / F.nullif(F.sqrt(sx * sy), F.lit(0.0)))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Spearman's rho of pairwise complete rows in each group of at least `least` rows."""
    d = dealt(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), *by)
    d = d.withColumn("_rx", average_rank(x, *by)).withColumn("_ry", average_rank(y, *by))
    return d.groupBy(*by).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("rho")).where(F.col("n") >= least)


def quartile_difference(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Median y in the top quartile of x less that in the bottom one, where all four quartile edges differ."""
    edges = df.groupBy(by).agg(*(F.percentile(x, p).alias(f"e{i}") for i, p in enumerate((0, 0.25, 0.5, 0.75, 1))))
    edges = edges.where((F.col("e0") < F.col("e1")) & (F.col("e1") < F.col("e2")) & (F.col("e2") < F.col("e3")) & (F.col("e3") < F.col("e4")))
    d = df.join(edges, by)
    return d.groupBy(by).agg((F.median(F.when(F.col(x) > F.col("e3"), F.col(y))) - F.median(F.when(F.col(x) <= F.col("e1"), F.col(y)))).alias("difference"))


def contrast_with(summary: DataFrame, stratum: str, group: str, control: str, value: str) -> DataFrame:
    """Each group's summarised value less the stratum's control."""
    c = summary.where(F.col(group) == control).select(stratum, F.col(value).alias("_c"))
    return summary.join(c, stratum).select(stratum, group, (F.col(value) - F.col("_c")).alias("effect"))


def oriented(df: DataFrame, deviated: Column, probabilities: list[str], full_dev: float = 0.80, full_undiff: float = 0.65) -> DataFrame:
    """Names two clusters' probabilities by which one is deviated, with margin and three-way label."""
    d, u = F.when(deviated == 0, F.col(probabilities[0])).otherwise(F.col(probabilities[1])), F.when(deviated == 0, F.col(probabilities[1])).otherwise(F.col(probabilities[0]))
    return df.withColumns({"deviated": d, "undifferentiated": u, "margin": d - u, "label": F.when(d >= full_dev, "cluster2").when(u >= full_undiff, "cluster1").otherwise("uncertain")})


def rotated(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Points turned about their group's centre so that u has the largest variance; signs by the larger part of the first axis."""
    m = df.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.atan2(2 * F.covar_samp(x, y), F.var_samp(x) - F.var_samp(y)) / 2).alias("_t"))
    sign = F.when(F.abs(F.cos("_t")) >= F.abs(F.sin("_t")), F.signum(F.cos("_t"))).otherwise(F.signum(F.sin("_t")))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    return df.join(m, by).withColumns({"u": sign * (dx * F.cos("_t") + dy * F.sin("_t")), "v": sign * (dy * F.cos("_t") - dx * F.sin("_t"))}).drop("_mx", "_my", "_t")
