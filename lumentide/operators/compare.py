"""Comparisons between groups, conditions and methods, as aggregates joined back to small tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentide.functions.measures import log2_ratio
from lumentide.operators.summaries import average_rank, pearson
from lumentide.operators.tables import dealt, stored


def quartiles(x: Column | str) -> tuple[Column, Column, Column]:
    """Lower quartile, median and upper quartile from one buffer."""
    whole = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.get(whole, F.lit(0)), F.get(whole, F.lit(1)), F.get(whole, F.lit(2))


def feature_summary(df: DataFrame, by: list[str], features: list[str], sd0: bool = False) -> DataFrame:
    """n, and mean, std, median of each feature; with sd0 the std of one row is 0, not null."""
    sd = lambda f: F.coalesce(F.stddev_samp(f), F.lit(0.0)) if sd0 else F.stddev_samp(f)
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(e for f in features for e in (F.avg(f).alias(f"{f}_mean"), sd(f).alias(f"{f}_std"), F.median(f).alias(f"{f}_median"))))


def quartile_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """n, and quartiles of each metric."""
    cols = [e for m in metrics for e, n in zip(quartiles(m), ("q25", "median", "q75"), strict=True) for e in [e.alias(f"{m}_{n}")]]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *cols)


def trend(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Median and its distances to the quartiles, as error bars."""
    lo, mid, hi = quartiles(metric)
    return df.groupBy(*by).agg(mid.alias("median"), (mid - lo).alias("below"), (hi - mid).alias("above"))


def variation(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), (F.stddev_samp(metric) / F.nullif(F.avg(metric), F.lit(0.0))).alias("cv"))


def sample_summary(df: DataFrame, by: str, field: str, metric: str) -> DataFrame:
    """Rows, fields, and location and spread of a metric in each sample."""
    whole = F.percentile(metric, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    q = lambda i: F.get(whole, F.lit(i))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(field).alias("fields"), q(1).alias("median"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), q(0).alias("q10"), q(2).alias("q90"), (F.stddev_samp(metric) / F.nullif(F.avg(metric), F.lit(0.0))).alias("cv"))


def reason_summary(df: DataFrame, by: str, column: str, reasons: list[str], limit: float = 0.2) -> DataFrame:
    """Rows of each group that hold each reason of a ;-list, removed ones, and a warning beyond a share of them."""
    has = lambda r: F.sum(F.array_contains(F.split(column, ";"), r).cast("long")).alias(f"n_{r}")
    gone = F.sum((F.col(column) != "").cast("long"))
    return df.groupBy(by).agg(F.count("*").alias("n"), *(has(r) for r in reasons), gone.alias("n_removed"), (gone / F.count("*")).alias("removed_fraction"), (gone / F.count("*") > limit).alias("warning"))


def technical_summary(df: DataFrame, by: list[str], flags: list[str], metrics: list[str]) -> DataFrame:
    """Counts and shares of flags and medians of metrics, by those of the keys that the table has."""
    keys = [k for k in by if k in df.columns]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(e for f in flags for e in (F.sum(F.col(f).cast("long")).alias(f"n_{f}"), F.avg(F.col(f).cast("double")).alias(f"share_{f}"))), *(F.median(m).alias(f"{m}_median") for m in metrics))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Share of each value in each row's total."""
    total = F.count(F.when(F.col(column).isin(values), 1))
    return df.groupBy(row).agg(*((F.count(F.when(F.col(column) == v, 1)) / F.nullif(total, F.lit(0))).alias(f"share_{v}") for v in values))


def against_control(summary: DataFrame, keys: list[str], group: str, control: str, value: str) -> DataFrame:
    """Ratio, change in percent and log2 of each group's value against the control of the same keys."""
    c = summary.where(F.col(group) == control).select(*keys, F.col(value).alias("_c"))
    j = summary.join(c, keys, "left")
    ratio = F.col(value) / F.nullif(F.col("_c"), F.lit(0.0))
    return j.select(*keys, group, ratio.alias("ratio"), (100 * (ratio - 1)).alias("percent"), log2_ratio(F.col(value), F.col("_c")).alias("log2"))


def marker_dispersion(df: DataFrame, grid: DataFrame, stratum: str, group: str, marker: str, valid: Column, control: str) -> DataFrame:
    """For each cell of a grid (stratum, group): rows, valid share, quartiles and MAD of the valid marker, gain against the control's MAD."""
    x = F.when(valid, F.col(marker))
    lo, mid, hi = quartiles(x)
    s = df.groupBy(stratum, group).agg(F.count("*").alias("n"), F.avg(valid.cast("double")).alias("valid"), lo.alias("q25"), mid.alias("median"), hi.alias("q75"))
    s = stored(s, "marker-summary")
    d = df.where(valid).join(s.select(stratum, group, "median"), [stratum, group])
    mad = d.groupBy(stratum, group).agg(F.median(F.abs(F.col(marker) - F.col("median"))).alias("mad"))
    c = mad.where(F.col(group) == control).select(stratum, F.col("mad").alias("_c"))
    out = grid.join(s, [stratum, group], "left").join(mad, [stratum, group], "left").join(c, stratum, "left")
    return out.select(stratum, group, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "valid", "q25", "median", "q75", "mad", (-log2_ratio(F.col("mad"), F.col("_c"))).alias("gain"))


def gain_summary(gains: DataFrame, by: list[str], value: str = "gain") -> DataFrame:
    """How many gains can be told, how many are positive, and their middle and ends."""
    return gains.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("n_positive"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def residual_spearman(df: DataFrame, by: str, x: str, y: str, least: int = 10) -> DataFrame:
    """Spearman's rho of what is left of x and y after their group's medians, per group of at least `least` rows."""
    d = dealt(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, y), by)
    m = d.groupBy(by).agg(F.median(x).alias("_mx"), F.median(y).alias("_my"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    d = d.join(stored(m, "medians"), by).select(by, (F.col(x) - F.col("_mx")).alias("rx"), (F.col(y) - F.col("_my")).alias("ry"))
    d = d.withColumn("ax", average_rank("rx", by)).withColumn("ay", average_rank("ry", by))
    return d.groupBy(by).agg(F.count("*").alias("n"), pearson("ax", "ay").alias("rho"))


def equal_count_trend(df: DataFrame, by: str, x: str, y: str, bins: int = 8) -> DataFrame:
    """Median x and median log2 y in bins between x's quantiles (right-closed, repeated edges dropped), per group."""
    probs = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    edges = df.groupBy(by).agg(F.array_distinct(F.percentile(x, probs)).alias("_e"))
    d = df.join(stored(edges, "edges"), by)
    d = d.withColumn("bin", F.greatest(F.size(F.filter("_e", lambda e: e < F.col(x))), F.lit(1))).where(F.col(y) > 0)
    return d.groupBy(by, "bin").agg(F.count("*").alias("n"), F.median(x).alias("x"), F.median(F.log2(y)).alias("y"))


#: Differences up to which the distribution of a rank sum is counted; above, its normal form is used.
EXACT_RANKS = 50


def rank_sum_p(ranks: list[float], counts: list[int], w: float) -> float:
    """The two-sided probability of a signed rank sum at least as far out as w, by counting all signs; counts: ranks of each value."""
    doubled = [round(2 * r) for r, n in zip(ranks, counts, strict=True) for _ in range(int(n))]
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1.0
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    share = np.cumsum(ways) / ways.sum()
    at = round(2 * w)
    return float(min(1.0, 2 * min(share[at], 1 - (share[at - 1] if at else 0.0))))


def signed_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """Wilcoxon's rank sums of the positive and negative differences, zeros and nulls left out, ties averaged, the normal deviate z, and the two-sided p.

    p counts all signs of the ranks, ties included, where a group has EXACT_RANKS differences at most; above, it is the normal
    form's. Ranks come from counts of each different size, which is all that a window over a group holds. z and p are null
    where there is no spread.
    """
    sizes = df.where(F.col(value) != 0).groupBy(by, F.abs(F.col(value)).alias("_a")).agg(F.count("*").alias("_t"), F.count_if(F.col(value) > 0).alias("_p"))
    sizes = sizes.withColumn("_r", F.sum("_t").over(Window.partitionBy(by).orderBy("_a")) - (F.col("_t") - 1) / 2)
    s = sizes.groupBy(by).agg(
        F.sum("_t").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("w_plus"), F.sum(F.col("_r") * (F.col("_t") - F.col("_p"))).alias("w_minus"), F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_ties"),
    )
    small = sizes.join(s.where(F.col("n") <= EXACT_RANKS).select(by), by, "left_semi").groupBy(by).agg(F.collect_list(F.struct("_r", "_t")).alias("_ranks"))  # EXACT_RANKS at most
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)

    @F.pandas_udf("double")
    def p_value(w: pd.Series, z: pd.Series, ranks: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for x, d, r, c in zip(w, z, ranks, counts, strict=True):
            out.append(rank_sum_p(list(r), list(c), x) if r is not None else None if pd.isna(d) else math.erfc(abs(d) / math.sqrt(2)))
        return pd.Series(out, dtype="float64")

    s = s.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).join(small, by, "left")
    return s.select(by, "n", "w_plus", "w_minus", "z", p_value("w_plus", "z", F.col("_ranks._r"), F.col("_ranks._t")).alias("p"))


def shares(df: DataFrame, by: list[str], category: str) -> DataFrame:
    n = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def diversity(df: DataFrame, by: str, category: str, k: int) -> DataFrame:
    """Entropy of categories over ln k, and Simpson's index."""
    s = shares(df, [by], category)
    return s.groupBy(by).agg(F.sum("n").alias("n"), (-F.sum(F.col("share") * F.log("share")) / F.log(F.lit(float(k)))).alias("entropy"), (1 - F.sum(F.pow("share", 2))).alias("simpson"))


def block_distances(df: DataFrame, field: str, row: str, col: str, category: str, side: float, blocks: int, eps: float = 1e-9) -> DataFrame:
    """Jensen-Shannon distance of each block's categories to the whole field's, for a grid of blocks x blocks; empty blocks count, too."""
    cats = df.select(category).distinct()
    spark = df.sparkSession
    grid = spark.range(blocks * blocks).select(F.floor(F.col("id") / blocks).cast("int").alias("block_row"), (F.col("id") % blocks).cast("int").alias("block_col"))
    whole = df.groupBy(field, category).agg(F.count("*").alias("c")).withColumn("q", F.col("c") / F.sum("c").over(Window.partitionBy(field)))
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    inside = (F.col("block_row").between(0, blocks - 1)) & (F.col("block_col").between(0, blocks - 1))
    part = df.withColumn("block_row", at(row)).withColumn("block_col", at(col)).where(inside).groupBy(field, "block_row", "block_col", category).agg(F.count("*").alias("k"))
    # one row for each field, block and category: a grid of summaries, not of rows
    full = df.select(field).distinct().crossJoin(grid).crossJoin(stored(cats, "categories"))
    full = full.join(part, [field, "block_row", "block_col", category], "left").join(whole.select(field, category, "q"), [field, category], "left")
    w = Window.partitionBy(field, "block_row", "block_col")
    full = full.withColumn("n", F.coalesce(F.sum("k").over(w), F.lit(0)))
    full = full.withColumn("p", F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)) + eps).withColumn("q", F.coalesce("q", F.lit(0.0)) + eps)
    full = full.withColumn("p", F.col("p") / F.sum("p").over(w)).withColumn("q", F.col("q") / F.sum("q").over(w)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    js = F.sum(F.col("p") * F.log(F.col("p") / F.col("m")) + F.col("q") * F.log(F.col("q") / F.col("m"))) / 2
    return full.groupBy(field, "block_row", "block_col").agg(F.first("n").alias("n"), F.sqrt(F.greatest(js, F.lit(0.0))).alias("distance"))


def orientation_scores(df: DataFrame, cluster: str, positive: dict[str, float], negative: dict[str, float]) -> DataFrame:
    """Each cluster's weighted sum of its features' means, scaled to 0..1 over the clusters; deviated: the highest."""
    weights = {**positive, **{f: -w for f, w in negative.items()}}
    means = df.groupBy(cluster).agg(*(F.avg(f).alias(f) for f in weights))
    w = Window.partitionBy(F.lit(0))  # a row for each cluster
    score = F.lit(0.0)
    for f, weight in weights.items():
        low, high = F.min(f).over(w), F.max(f).over(w)
        span = F.greatest(high - low, F.lit(1e-12))
        score = score + abs(weight) * ((F.col(f) - low) if weight > 0 else (high - F.col(f))) / span
    scored = means.select(cluster, score.alias("score"))
    return scored.withColumn("deviated", F.row_number().over(w.orderBy(F.desc("score"), cluster)) == 1)


def extremes(summary: DataFrame, by: str, name: str, value: str, k: int = 2) -> DataFrame:
    """The k highest and k lowest names of each group."""
    up, down = Window.partitionBy(by).orderBy(F.desc(value), name), Window.partitionBy(by).orderBy(value, name)
    d = summary.withColumn("high", F.row_number().over(up)).withColumn("low", F.row_number().over(down))
    return d.where((F.col("high") <= k) | (F.col("low") <= k)).select(by, name, value, F.when(F.col("high") <= k, "high").otherwise("low").alias("end"))


def ledger(counts: DataFrame, declared: dict[str, int]) -> DataFrame:
    """Recomputed counts (name, n) against declared ones; what is missing on either side doesn't match."""
    d = counts.sparkSession.createDataFrame(list(declared.items()), "name string, declared long")
    return counts.join(d, "name", "full_outer").select("name", "n", "declared", F.coalesce(F.col("n") == F.col("declared"), F.lit(False)).alias("matches"))


def confusion(df: DataFrame, truth: str, predicted: str, uncertain: str = "uncertain") -> tuple[DataFrame, DataFrame]:
    """Counts of truth by prediction without uncertain rows, and the share of these."""
    sure = df.where(F.col(predicted) != uncertain).groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return sure, df.agg(F.count("*").alias("n"), F.avg((F.col(predicted) == uncertain).cast("double")).alias("uncertain_share"))


def rank_selection(candidates: DataFrame, least: float = 0.03) -> DataFrame:
    """Candidates of cluster numbers by their rank sums (bic low, silhouette high, stability high, min ranks); those with too small a cluster are left out unless all have."""
    w = Window.partitionBy(F.lit(0))  # a row for each candidate
    some = F.max((F.col("least_share") >= least).cast("int")).over(w) == 1
    c = candidates.withColumn("_ok", ~some | (F.col("least_share") >= least)).where("_ok").drop("_ok")
    total = F.rank().over(w.orderBy("bic")) + F.rank().over(w.orderBy(F.desc("silhouette"))) + F.rank().over(w.orderBy(F.desc("stability")))
    ranked = c.withColumn("rank_sum", total)
    return ranked.withColumn("chosen", F.row_number().over(w.orderBy("rank_sum", "k")) == 1).select("k", F.col("rank_sum").cast("int").alias("rank_sum"), "chosen")
