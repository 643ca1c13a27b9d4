"""Two states of a few values by optimal step functions of all scales."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Steps:
    """Step functions of least squared error over ascending different values with counts.

    The best first level for the values from i on ends the later, the later i is; so of all i the middle one is searched first, and
    what it finds bounds the search on either side. A level of that search is one pass over arrays.
    """

    def __init__(self, x: np.ndarray, counts: np.ndarray):
        self.x, self.n = x - np.average(x, weights=counts), len(x)  # about the mean, so that sums of squares stay exact
        self.c = np.append(0.0, np.cumsum(counts))
        self.s = np.append(0.0, np.cumsum(self.x * counts))
        self.q = np.append(0.0, np.cumsum(self.x**2 * counts))

    def error(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of one level for the values from i to before j."""
        s = self.s[j] - self.s[i]
        return np.maximum(self.q[j] - self.q[i] - s * s / (self.c[j] - self.c[i]), 0.0)

    def alone(self) -> np.ndarray:
        """The cost of the values from i on, i = 0 to n - 1, as one level."""
        return self.error(np.arange(self.n), np.full(self.n, self.n))

    def split(self, cost: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """The cost with one level more than `cost` has (its own number is `levels`), and where the first level then ends.

        The values from i on must be at least levels + 1, so the last i for which there is a result is n - levels - 1.
        """
        last = self.n - levels - 1
        out, end = np.full(self.n, np.inf), np.full(self.n, -1)
        low, high = np.zeros(1, np.int64), np.full(1, last, np.int64)  # the i of each part
        least, most = np.full(1, 1, np.int64), np.full(1, self.n - levels, np.int64)  # where their first level may end
        while len(low):
            mid = (low + high) // 2
            a, b = np.maximum(least, mid + 1), most
            size = b - a + 1
            part = np.repeat(np.arange(len(mid)), size)
            first = np.cumsum(size) - size
            j = np.arange(size.sum()) - first[part] + a[part]
            total = self.error(mid[part], j) + cost[j]
            best = np.minimum.reduceat(total, first)
            hit = np.flatnonzero(total == best[part])
            found = j[hit[np.unique(part[hit], return_index=True)[1]]]
            out[mid], end[mid] = best, found
            left, right = low < mid, mid < high
            low, high, least, most = (np.concatenate(x) for x in ((low[left], mid[right] + 1), (mid[left] - 1, high[right]), (least[left], found[right]), (found[left], most[right])))
        return out, end


#: Where numbers of jumps are looked at together, as shares of the most there can be.
_RUNGS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.49, 0.6, 0.7, 0.8, 0.9, 0.97, 0.995, 1.0)
#: Slack of comparisons of bounds, far above what sums of floats are off by.
_SLACK = 1e-6


class _Bounds:
    """What holds for the strongest jump of every step function of least error that has some number of jumps or more.

    The least error is convex in the number of jumps, so one jump more than k saves at most what any step function of j < k jumps is
    off, over k + 1 - j; no level of a best function can save more by a cut. A wider level saves more, so levels beside a place end where
    the first one does that saves too much; and a gap that saves too much by itself is a jump.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.n, self.w = len(x), weight
        self.x = x - np.average(x, weights=weight)
        wide = self.x.astype(np.longdouble)
        self.c, self.s = np.append(0.0, np.cumsum(weight)), np.append(np.longdouble(0), np.cumsum(wide * weight))
        middle = (self.x[1:] + self.x[:-1]) / 2
        q, total = float((wide * wide * weight).sum()), float(self.s[-1])
        self.about = np.maximum(q - 2 * middle * total + self.c[-1] * middle * middle, np.finfo(float).tiny)  # of the place before value p at p - 1
        self.places = np.cumsum(weight).astype(np.int64)[:-1]
        self.dense = np.append(0.0, np.cumsum(np.diff(self.x) ** (2 / 3)))

    def _off(self, jumps: int) -> float:
        """The error of a step function of at most some jumps, more of them where values lie close."""
        level = np.minimum((self.dense / self.dense[-1] * (jumps + 1)).astype(np.int64), jumps)
        c = np.bincount(level, self.w)
        mean = np.bincount(level, self.w * self.x) / np.maximum(c, 1e-300)
        return float((self.w * (self.x - mean[level]) ** 2).sum())

    def saved(self, k: int) -> float:
        """No less than what a jump more saves at k jumps or more."""
        if k >= self.n - 1:
            return 0.0
        some = sorted({int(k * f) for f in (0, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95)})
        return min(self._off(j) / (k + 1 - j) for j in some) * (1 + _SLACK)

    def _ends(self, c: np.ndarray, s: np.ndarray, most: float) -> np.ndarray:
        """How far a level from each value on can go (the end, not in it) if no cut of it saves more than `most`."""
        end, open_, size = np.full(self.n, self.n), np.arange(self.n), 2
        while True:
            open_ = open_[open_ + size <= self.n]
            if not len(open_):
                return end
            b, hit = open_ + size, np.zeros(len(open_), bool)
            for e in sorted({max(1, size * i // 16) for i in range(1, 16)}):
                left, right = c[open_ + e] - c[open_], c[b] - c[open_ + e]
                apart = ((s[b] - s[open_ + e]) / right - (s[open_ + e] - s[open_]) / left).astype(float)
                hit |= left * right / (left + right) * apart**2 > most * (1 + _SLACK)
            end[open_[hit]] = b[hit] - 1
            open_, size = open_[~hit], size + 1 + (size // 4 if size > 15 else 0)

    def votes(self, k: int) -> tuple[int, int]:
        """The lowest and the highest place that the strongest jump can have at k jumps or more."""
        most = self.saved(k)
        gap = np.diff(self.x)
        sure = self.w[1:] * self.w[:-1] / (self.w[1:] + self.w[:-1]) * gap**2 > most * (1 + _SLACK)
        if not sure.any():
            return int(self.places[0]), int(self.places[-1])
        after = self._ends(self.c, self.s, most)[1:]
        turned = self._ends(self.c[-1] - self.c[::-1], self.s[::-1] * -1 + self.s[-1], most)
        before = (self.n - turned[::-1])[:-1]
        at = np.arange(1, self.n)
        height = ((self.s[after] - self.s[at]) / (self.c[after] - self.c[at]) - (self.s[at] - self.s[before]) / (self.c[at] - self.c[before])).astype(float)
        could = self.places[height / self.about >= (gap / self.about)[sure].max() * (1 - _SLACK)]
        return int(could.min()), int(could.max())


def _ranked(values: np.ndarray, times: np.ndarray, at: tuple[int, ...]) -> list[int]:
    """The values that have some ranks, each value as often as times says."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(times[order])
    return [int(values[order][np.searchsorted(upto, m, side="right")]) for m in at]


def _sure_middles(x: np.ndarray, weight: np.ndarray, most: int, at: tuple[int, ...]) -> list[int] | None:
    """The votes of some ranks, if bounds alone tell them: without a step function being searched. None if they don't."""
    n, bounds = int(weight.sum()), _Bounds(x, weight)
    any_place, found, until, times = (int(bounds.places[0]), int(bounds.places[-1])), [], n - 1, []  # jumps beyond the most count as the most
    for k in sorted({max(1, int(most * f)) for f in _RUNGS}, reverse=True):  # few jumps take the longest
        found.append(bounds.votes(k))
        times.append(until - k)
        until = k
        low, high = (_ranked(np.array(v), np.array([*times, k - 1]), at) for v in zip(*found, any_place, strict=True))
        if low == high:
            return low
    return None


def _all_votes(x: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """The place of the strongest jump for each number of jumps, 1 to most.

    The time goes by the square of how many different values there are, the memory by that number to the power 1.5: of the costs every
    sqrt-th is kept, and those between are made again.
    """
    n = int(weight.sum())
    steps = _Steps(x, weight)
    stride = max(1, int(most**0.5))
    kept, cost = {0: steps.alone()}, steps.alone()
    for k in range(1, most + 1):
        cost, _ = steps.split(cost, k)
        if k % stride == 0:
            kept[k] = cost
    mean = lambda a, b: (steps.s[b] - steps.s[a]) / (steps.c[b] - steps.c[a])
    middle = (steps.x[1:] + steps.x[:-1]) / 2
    about = np.maximum(steps.q[-1] - 2 * middle * steps.s[-1] + n * middle * middle, np.finfo(float).tiny)  # the error about each jump's middle
    # all numbers of jumps at once, each with the last two bounds of its levels and its strongest jump so far
    before, now = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
    strength, vote = np.full(most + 1, -np.inf), np.zeros(most + 1, np.int64)

    def judge(some: np.ndarray, after: np.ndarray) -> None:
        found = (mean(now[some], after) - mean(before[some], now[some])) / about[now[some] - 1]
        better = found > strength[some]
        strength[some[better]], vote[some[better]] = found[better], now[some[better]]

    for begin in sorted(kept, reverse=True):
        ends, cost = {}, kept[begin]
        for k in range(begin + 1, min(begin + stride, most) + 1):
            cost, ends[k] = steps.split(cost, k)
        for k in sorted(ends, reverse=True):
            some = np.arange(k, most + 1)  # the fewer jumps come in later, each from the start
            after = ends[k][now[some]]
            judge(some[1:], after[1:])
            before[some], now[some] = now[some], after
    some = np.arange(1, most + 1)
    judge(some, np.full(most, len(x)))
    return np.cumsum(weight).astype(np.int64)[vote[1:] - 1]  # how many values lie below each vote's jump


def step_threshold(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The threshold between two states of values; counts says how often each stands.

    For each number of jumps the step function of least squared error is found; of its jumps the strongest (height over the
    error of the values about the jump's middle) votes for its place; the median place gives the threshold. Jumps beyond one between
    all different values have no height and don't change the vote. Most numbers of jumps have the same strongest one, as bounds show in time
    little above linear (_sure_middles); only where these leave the median place open, all numbers are searched (_all_votes).
    """
    values = np.asarray(values, float)
    x, back = np.unique(values, return_inverse=True)
    weight = np.bincount(back, counts if counts is None else np.asarray(counts, float)).astype(float)
    n = int(weight.sum())
    if n < 3 or not np.isfinite(x).all() or len(x) < 2:
        raise ValueError("needs three finite values that differ")
    most = min(n - 2, len(x) - 1)  # jumps
    ranks = ((n - 3) // 2, (n - 2) // 2)  # the median of all votes, of which the last number of jumps has many
    middles = _sure_middles(x, weight, most, ranks)
    if middles is None:
        times = np.ones(most, np.int64)
        times[-1] = n - 1 - most
        middles = _ranked(_all_votes(x, weight, most), times, ranks)
    at = int((middles[0] + middles[1]) // 2)
    i = int(np.searchsorted(np.cumsum(weight), at, side="left"))  # the value that the at-th one is
    j = int(np.searchsorted(np.cumsum(weight), at + 1, side="left"))
    return float((x[i] + x[j]) / 2)


def binarised(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Adds each group's threshold and whether a value lies above it; groups with fewer than three or only equal values get null.

    What meets in a task are a group's different values with their counts, added up beforehand. Nulls have no part and no state.
    """
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = some.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v, n = frame["_v"].to_numpy(float), frame["_n"].to_numpy(np.int64)
        fits = n.sum() >= 3 and len(v) > 1 and np.isfinite(v).all()
        return frame[by].iloc[:1].assign(threshold=step_threshold(v, n) if fits else np.nan)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "threshold double"])
    cuts = counted.groupBy(*by).applyInPandas(run, schema).withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double")))
    return df.join(cuts, by, "left").withColumn("high", F.col(value) > F.col("threshold"))
