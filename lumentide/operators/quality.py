"""Quality flags and limits of measured objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_qc(df: DataFrame, height: int, width: int, buffer: int) -> DataFrame:
    """touches_border, gap to the nearest border, keep and reason from a box (min_row, min_col, max_row, max_col; ends exclusive)."""
    gap = F.least(F.col("min_row"), F.col("min_col"), height - F.col("max_row"), width - F.col("max_col"))
    touches = gap <= 0
    reason = F.when(touches, "touches_border").when(gap <= buffer, f"within_{buffer}px_image_edge").otherwise("keep")
    return df.withColumns({"touches_border": touches, "image_edge_gap_px": gap, "qc_keep": gap > buffer, "qc_reason": reason})


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The reasons of the rules that hold, distinct, sorted, joined by ;"""
    hit = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))
    return F.concat_ws(";", F.array_sort(F.array_distinct(hit)))


def reason_counts(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.where(F.col(column) != "").select(by, F.explode(F.split(column, ";")).alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))


def keep_summary(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("n_kept"), F.avg(flag.cast("double")).alias("fraction"))


def tukey_limits(df: DataFrame, by: str, area: str, border: Column, low: float = 2.5, high: float = 3.5, least: float = 25, most: float = 2500) -> DataFrame:
    """Limits of each group from rows off the border, and how many rows fall to each reason."""
    inner = F.when(~border, F.col(area))
    q = df.groupBy(by).agg(F.percentile(inner, 0.25).alias("q1"), F.percentile(inner, 0.75).alias("q3"))
    lim = q.select(by, F.greatest(F.lit(float(least)), F.col("q1") - low * (F.col("q3") - F.col("q1"))).alias("lo"), F.least(F.lit(float(most)), F.col("q3") + high * (F.col("q3") - F.col("q1"))).alias("hi"))
    d = df.withColumn("_b", border).join(lim, by)
    why = F.when(F.col("_b"), "border").when(F.col(area) < F.col("lo"), "small").when(F.col(area) > F.col("hi"), "large").otherwise("kept")
    return d.groupBy(by, why.alias("reason")).agg(F.count("*").alias("n"))


def iqr_trim(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows inside the quartiles widened by k IQRs, ends included."""
    q = df.agg(F.percentile(column, 0.25).alias("_q1"), F.percentile(column, 0.75).alias("_q3"))
    d = df.crossJoin(F.broadcast(q))  # one row
    i = F.col("_q3") - F.col("_q1")
    return d.where(F.col(column).between(F.col("_q1") - k * i, F.col("_q3") + k * i)).drop("_q1", "_q3")


def robust_scale(column: str, by: list[str], floor: float = 1e-9) -> Column:
    """(x - median) / max(IQR, floor) in each group, as a window expression."""
    w = Window.partitionBy(*by)
    iqr = F.percentile(column, 0.75).over(w) - F.percentile(column, 0.25).over(w)
    return (F.col(column) - F.median(column).over(w)) / F.greatest(iqr, F.lit(floor))


def kept(df: DataFrame, *flags: Column) -> DataFrame:
    """Rows for which all flags hold; null doesn't."""
    for f in flags:
        df = df.where(f)
    return df


def border_flag(height: Column, width: Column, margin: int) -> Column:
    """Whether a box (min_row, min_col, max_row, max_col) comes within margin of the image's border; an unknown size is an error."""
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("image size is unknown")).cast("int"))
    return (F.col("min_row") <= margin) | (F.col("min_col") <= margin) | (F.col("max_row") >= known(height) - margin) | (F.col("max_col") >= known(width) - margin)


def within_limits(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie inside their closed limits."""
    for c, (lo, hi) in limits.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def masked(column: str, flag: str) -> Column:
    """The value where the flag reads true or 1, else null."""
    return F.when(F.lower(F.col(flag).cast("string")).isin("true", "1"), F.col(column))


def finite_in(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is finite and strictly between the limits."""
    x = F.col(column)
    return df.where(x.isNotNull() & ~F.isnan(x) & (x > low) & (x < high))


def flag_known(df: DataFrame, keys: list[str], known: list[tuple], into: str = "excluded") -> DataFrame:
    """Adds whether a row's key is among a literal list."""
    hit = F.lit(False)
    for values in known:
        one = F.lit(True)
        for k, v in zip(keys, values, strict=True):
            one = one & (F.col(k) == F.lit(v))
        hit = hit | F.coalesce(one, F.lit(False))
    return df.withColumn(into, hit)


def usable_features(df: DataFrame, features: list[str]) -> DataFrame:
    """For each feature its values and whether they vary, from one pass: least and largest tell that without counting distinct ones."""
    row = df.agg(*(e for f in features for e in (F.count(f).alias(f"{f}_n"), F.coalesce(F.min(f) < F.max(f), F.lit(False)).alias(f"{f}_u"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_n").alias("n"), F.col(f"{f}_u").alias("usable")) for f in features))).alias("s")).select("s.*")


def duplicate_features(df: DataFrame, features: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Features equal to an earlier one, or to its log1p, within tolerances, in all rows: dropped, kept. One pass tells all pairs."""
    near = lambda a, b: F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())
    pairs = [(a, b) for i, b in enumerate(features) for a in features[:i]]
    same = [F.bool_and(near(F.col(b), F.col(a))) | F.bool_and(near(F.col(b), F.when(F.col(a) > -1, F.log1p(a)))) for a, b in pairs]
    row = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(same)))
    found = F.array_compact(F.array(*(F.when(F.col(f"s{i}"), F.struct(F.lit(b).alias("dropped"), F.lit(a).alias("kept"))) for i, (a, b) in enumerate(pairs))))
    return row.select(F.explode(found).alias("s")).groupBy("s.dropped").agg(F.min("s.kept").alias("kept"))


def robust_scale_or_global(df: DataFrame, column: str, by: list[str], into: str, floor: float = 1e-9) -> DataFrame:
    """(x - group median) over the group's IQR, else over that of all rows, else over their std, else 1."""
    whole = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = df.groupBy(*by).agg(F.get(whole, F.lit(1)).alias("_m"), (F.get(whole, F.lit(2)) - F.get(whole, F.lit(0))).alias("_i"))
    every = df.agg((F.get(whole, F.lit(2)) - F.get(whole, F.lit(0))).alias("_gi"), F.stddev_pop(column).alias("_gs"))
    scale = F.coalesce(*(F.when(F.col(c) > floor, F.col(c)) for c in ("_i", "_gi", "_gs")), F.lit(1.0))
    return df.join(own, by).crossJoin(F.broadcast(every)).withColumn(into, (F.col(column) - F.col("_m")) / scale).drop("_m", "_i", "_gi", "_gs")


def spread_picks(df: DataFrame, by: list[str], order: list[str], k: int, low: float = 0.12, high: float = 0.88) -> DataFrame:
    """k rows of each group at even places between two shares of its order; small groups are taken whole."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    a, b = F.floor(low * F.col("_n")), F.floor(high * F.col("_n"))
    at = F.array(*((a + (b - a) * i / (k - 1)).cast("long") for i in range(k)))
    return d.where((F.col("_n") <= k) | F.array_contains(at, F.col("_i").cast("long"))).drop("_i", "_n")


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group for review, by a hash of the key: the same whatever the partitions."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
