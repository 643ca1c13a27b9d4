"""Exact quantiles and ranks of groups too large for one task: values are counted by ranges, and only the ranges that hold a wanted rank are looked into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentide.operators.tables import stored

#: Ranges that a group's values are cut into.
RANGES = 256
#: Of a group's cut points every so many-th is compared first.
_STEP = 16
#: Accuracy of the sketches between whose quantiles a wanted rank is looked for.
_SKETCH = 10000


def _cuts(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Ascending cut points of each group, from a mergeable sketch of bounded size."""
    probs = [i / RANGES for i in range(1, RANGES)]
    return df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(column, probs, 4 * RANGES)).alias("_cuts"))


def _ranged(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """df with _b, the range of its value: the number of cut points below it."""
    cuts = _cuts(df, by, column)
    coarse = F.filter("_cuts", lambda x, i: i % _STEP == _STEP - 1)
    cuts = stored(cuts.select(*(F.col(c).alias(f"_{c}") for c in by), "_cuts", coarse.alias("_coarse")), "cuts")
    joined = df.join(cuts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else df.crossJoin(F.broadcast(cuts))
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col(column)))
    # every _STEP-th cut first, then those between two of them: twice the root of all comparisons
    joined = joined.withColumn("_s", below("_coarse") * _STEP)
    return joined.withColumn("_b", F.col("_s") + below(F.slice("_cuts", F.col("_s") + 1, F.lit(_STEP)))).drop("_s", "_cuts", "_coarse", *(f"_{c}" for c in by))


def counted(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Each different value of each group: its count (n) and how many of the group's values are less (before).

    No window holds more than one range of one group: the counts of ranges are added up first (RANGES rows a group).
    """
    d = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"))
    n = _ranged(d, by, "value").groupBy(*by, "_b", "value").agg(F.count("*").alias("n"))
    ranges = n.groupBy(*by, "_b").agg(F.sum("n").alias("_n"))
    low = F.coalesce(F.sum("_n").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_b").alias("_r"), low.alias("_low"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = [F.col("_b") == F.col("_r"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)]
    return n.withColumn("_i", inside).join(stored(ranges, "ranges"), on).select(*by, "value", "n", (F.col("_low") + F.col("_i")).alias("before"))


def spread_quantiles(df: DataFrame, by: list[str], column: str, probs: tuple[float, ...]) -> DataFrame:
    """Interpolated quantiles of each group, equal to percentile(): by, n, q (array in the order of probs)."""
    return exact_quantiles(df, by, {"q": F.col(column)}, probs).withColumn("n", F.col("q_n")).where("n > 0").select(*by, "n", "q")


def _same(by: list[str]) -> list:
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]


def exact_quantiles(df: DataFrame, by: list[str], values: dict[str, Column], probs: tuple[float, ...]) -> DataFrame:
    """Interpolated quantiles of several values of each group, equal to percentile(): by, and of each name its array in the order of probs
    (null without values) and <name>_n.

    Three scans for all of them: a sketch gives two values between which a wanted rank lies; the values below are counted, those
    between are counted one by one, about a thousandth of all. Ranks that a sketch misses are found by counting all values of that column.
    No task holds a group.
    """
    names = list(values)
    d = df.select(*by, *(v.cast("double").alias(n) for n, v in values.items()))
    pad = 2 / _SKETCH
    ends = [min(max(p + e, 0.0), 1.0) for p in probs for e in (-pad, pad)]
    sketch = d.groupBy(*by).agg(*(e for n in names for e in (F.count(n).alias(f"{n}_n"), F.percentile_approx(n, ends, _SKETCH).alias(f"{n}_e"))))
    sketch = stored(sketch.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for n in names for c in (f"{n}_n", f"{n}_e"))), "sketch")
    both = d.join(sketch, _same(by)) if by else d.crossJoin(F.broadcast(sketch))
    low, high = (lambda n, i: F.col(f"{n}_e")[2 * i]), (lambda n, i: F.col(f"{n}_e")[2 * i + 1])
    each = [(n, i) for n in names for i in range(len(probs))]
    below = both.groupBy(*by).agg(*(F.count_if(F.col(n) < low(n, i)).alias(f"{n}_b{i}") for n, i in each))
    below = stored(below.select(*(F.col(c).alias(f"_{c}") for c in by), *(f"{n}_b{i}" for n, i in each)), "below")
    inside = {(n, i): F.col(n).between(low(n, i), high(n, i)) for n, i in each}
    some = reduce(lambda a, b: a | b, inside.values())
    items = F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), F.lit(i).alias("i"), F.col(n).alias("value"))) for (n, i), c in inside.items()))
    found = both.where(some).select(*by, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("x")).groupBy(*by, "x.name", "x.i", "x.value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "name", "i").orderBy("value"))
    found = found.withColumn("_u", upto).withColumn("_f", F.col("_u") - F.col("c"))
    base = stored(sketch.join(below, _renamed(by, sketch, below)).select(sketch["*"], *(f"{n}_b{i}" for n, i in each)) if by else sketch.crossJoin(below), "bases")
    pick = lambda what: reduce(lambda a, b: F.coalesce(a, b), (F.when((F.col("name") == n) & (F.col("i") == i), what(n, i)) for n, i in each))
    j = found.join(base, _same(by)) if by else found.crossJoin(F.broadcast(base))
    j = j.withColumn("_at", pick(lambda n, i: F.lit(float(probs[i])) * (F.col(f"{n}_n") - 1))).withColumn("_low", pick(lambda n, i: F.col(f"{n}_b{i}")))
    hit = lambda r: F.max(F.when((F.col("_low") + F.col("_f") <= r) & (r < F.col("_low") + F.col("_u")), F.col("value")))
    g = j.groupBy(*by, "name", "i").agg(hit(F.floor("_at")).alias("lo"), hit(F.ceil("_at")).alias("hi"), F.first("_at").alias("_at"))
    up, down = F.col("_at") - F.floor("_at"), F.ceil("_at") - F.col("_at")
    value = F.when((up == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(down * F.col("lo") + up * F.col("hi"))
    g = g.groupBy(*by).agg(*(F.max(F.when((F.col("name") == n) & (F.col("i") == i), value)).alias(f"{n}_q{i}") for n, i in each))
    whole = lambda n: F.array(*(F.col(f"{n}_q{i}") for i in range(len(probs))))
    out = base.join(g, _same(by), "left") if by else base.crossJoin(F.broadcast(g))
    out = stored(out.select(*(F.col(f"_{c}").alias(c) for c in by), *(c for n in names for c in (f"{n}_n", F.when(F.col(f"{n}_n") > 0, whole(n)).alias(n)))), "quantiles")
    missed = [n for n in names if not out.where(F.exists(n, lambda x: x.isNull())).isEmpty()]
    for n in missed:
        again = counted_quantiles(d, by, n, probs).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("q").alias("_again"))
        out = (out.join(again, _same(by), "left") if by else out.crossJoin(again)).withColumn(n, F.col("_again")).drop("_again", *(f"_{c}" for c in by))
    return out


def _renamed(by: list[str], one: DataFrame, two: DataFrame) -> list:
    return [one[f"_{c}"].eqNullSafe(two[f"_{c}"]) for c in by]


def counted_quantiles(df: DataFrame, by: list[str], column: str, probs: tuple[float, ...]) -> DataFrame:
    """Interpolated quantiles of each group, by counts of all values: by, n, q (array in the order of probs)."""
    c = counted(df, by, column)
    total = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("_t"))
    on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by]
    total = stored(total.select(*(F.col(x).alias(f"_{x}") for x in by), "_t"), "totals")
    c = c.join(total, on) if by else c.crossJoin(F.broadcast(total))

    def at(p: float, up: bool):
        place = F.lit(p) * (F.col("_t") - 1)
        rank = F.ceil(place) if up else F.floor(place)
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))

    parts = [at(p, u).alias(f"_{'u' if u else 'd'}{i}") for i, p in enumerate(probs) for u in (False, True)]
    g = c.groupBy(*by).agg(F.first("_t").alias("n"), *parts)
    share = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    return g.select(*by, "n", F.array(*(F.col(f"_d{i}") + (F.col(f"_u{i}") - F.col(f"_d{i}")) * share(p) for i, p in enumerate(probs))).alias("q"))


def spread_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of a column over all rows; null for null."""
    c = counted(df, [], column).select(F.col("value").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(c, F.col(column) == F.col("_v"), "left").drop("_v")
