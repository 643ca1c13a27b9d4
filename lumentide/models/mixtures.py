"""Gaussian mixtures with diagonal covariances: all numbers of components and all starts in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.operators.tables import stored

REG = 1e-6


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    loglik: float = -np.inf
    n: int = 0
    trace: tuple[float, ...] = ()

    @property
    def k(self) -> int:
        return len(self.weight)

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows x components."""
        d = x[:, None, :] - self.mean[None]
        return np.log(self.weight) - 0.5 * (np.log(2 * np.pi * self.var).sum(1) + (d * d / self.var).sum(2))

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = self.joint(x)
        top = j.max(1, keepdims=True)
        p = np.exp(j - top)
        s = p.sum(1, keepdims=True)
        return p / s, (top + np.log(s))[:, 0]

    @property
    def parameters(self) -> int:
        return self.k - 1 + 2 * self.mean.size

    @property
    def bic(self) -> float:
        return -2 * self.loglik + self.parameters * np.log(max(self.n, 1))

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length without nulls, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_mixtures(df: DataFrame, vector: str, ks: list[int], starts: int = 5, seed: int = 42, steps: int = 100, tolerance: float = 1e-4) -> dict[int, Mixture]:
    """The best of some starts for each number of components, by expectation-maximisation.

    Every step is one pass in which each task adds up the moments of all open models over its rows; what travels is a
    few numbers for each component. Starts are rows chosen by hash, so the fit does not depend on partitions.
    """
    rows = stored(df.select(F.transform(vector, lambda x: x.cast("double")).alias("x")).where("x IS NOT NULL"), "mixture-rows")  # read once for each pass
    most = max(ks) * starts
    firsts = [np.array(r.x) for r in rows.distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(most).collect()]
    if not firsts:
        return {}
    d = len(firsts[0])
    spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).collect()
    var = np.maximum(np.array([v for _, v in sorted((r.i, r.v) for r in spread)]), REG)
    models: dict[tuple[int, int], Mixture] = {}
    for k in ks:
        for s in range(starts):
            picked = [firsts[(s * k + i) % len(firsts)] for i in range(k)]
            models[k, s] = Mixture(np.full(k, 1 / k), np.array(picked), np.tile(var, (k, 1)))
    open_ = set(models)
    for _ in range(steps):
        now = {key: models[key] for key in open_}

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {key: np.zeros(m.k * (1 + 2 * d) + 2) for key, m in now.items()}  # noqa: B023
            for batch in batches:
                x = _matrix(batch.column(0))
                for key, m in now.items():  # noqa: B023
                    p, ll = m.posterior(x)
                    total[key] += np.concatenate([p.sum(0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), [ll.sum(), len(x)]])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([s for _, s in total], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["k", "s", "v"])

        sums = rows.mapInArrow(moments, "k int, s int, v array<double>").select("k", "s", F.posexplode("v").alias("i", "v")).groupBy("k", "s", "i").agg(F.sum("v").alias("v")).toPandas()
        for (k, s), part in sums.groupby(["k", "s"]):
            v, m = part.sort_values("i")["v"].to_numpy(), models[int(k), int(s)]
            n = np.maximum(v[:k], 1e-10)
            mean = v[k : k + k * d].reshape(k, d) / n[:, None]
            second = v[k + k * d : k + 2 * k * d].reshape(k, d) / n[:, None]
            rows_n, loglik = int(v[-1]), float(v[-2])
            done = m.trace and loglik - m.loglik <= tolerance * rows_n
            kept = Mixture(n / n.sum(), mean, np.maximum(second - mean**2, 0) + REG, loglik, rows_n, (*m.trace, loglik))
            if done:
                open_.discard((int(k), int(s)))
                kept.weight, kept.mean, kept.var = m.weight, m.mean, m.var
            models[int(k), int(s)] = kept
        if not open_:
            break
    return {k: max((models[k, s] for s in range(starts)), key=lambda m: m.loglik) for k in ks}


def assigned(df: DataFrame, vector: str, model: Mixture) -> DataFrame:
    """Adds component (numbered by size, the largest first, ties by number), posterior (in that order) and max_posterior."""
    schema = df.selectExpr("*", "cast(0 as int) as _raw", "cast(array() as array<double>) as _p").schema
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = model.posterior(_matrix(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmax(1), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "_raw", "_p"])

    raw = df.mapInArrow(run, schema)
    counts = {r._raw: r.n for r in raw.groupBy("_raw").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(model.k), key=lambda c: (-counts.get(c, 0), c))
    place = F.array(*(F.lit(order.index(c)) for c in range(model.k)))
    return raw.select(*df.columns, place[F.col("_raw")].alias("component"), F.array(*(F.col("_p")[c] for c in order)).alias("posterior"), F.array_max("_p").alias("max_posterior"))


def fragmentation(shares: np.ndarray) -> float:
    """Penalty of many and small clusters."""
    # Fixed values of the penalty.
    return 12 * max(0, len(shares) - 5) + 250 * float(np.clip(0.08 - shares, 0, None).sum()) + 500 * float(np.clip(0.05 - shares, 0, None).sum())


def search(df: DataFrame, vector: str, ks: list[int], starts: int = 5, seed: int = 42) -> tuple[Mixture, list[dict]]:
    """The mixture of the least penalised BIC (ties: BIC, then fewer components), and a row for each number of components."""
    models, table = fit_mixtures(df, vector, ks, starts, seed), []
    for k, m in models.items():
        counts = {r.component: r.n for r in assigned(df.select(vector), vector, m).groupBy("component").agg(F.count("*").alias("n")).collect()}
        shares = np.array([counts.get(c, 0) for c in range(k)]) / max(1, sum(counts.values()))
        penalty = fragmentation(shares)
        table.append({"k": k, "bic": m.bic, "aic": m.aic, "loglik": m.loglik, "least_share": float(shares.min()), "penalty": penalty, "bic_penalised": m.bic + penalty})
    best = min(table, key=lambda r: (r["bic_penalised"], r["bic"], r["k"]))
    return models[best["k"]], table


def stability(df: DataFrame, key: str, vector: str, model: Mixture, seeds: tuple[int, ...] = (7, 19, 73), starts: int = 1) -> list[float]:
    """Adjusted Rand index of the model's labels against refits from other seeds."""
    from lumentide.operators.metrics import adjusted_rand

    own = assigned(df.select(key, vector), vector, model).select(key, F.col("component").alias("a"))
    out = []
    for s in seeds:
        other = assigned(df.select(key, vector), vector, fit_mixtures(df, vector, [model.k], starts, s)[model.k])
        out.append(adjusted_rand(own.join(other.select(key, F.col("component").alias("b")), key), "a", "b").first().ari)
    return out


def compare_panels(df: DataFrame, key: str, panels: dict[str, list[str]], ks: list[int], starts: int = 2, seeds: tuple[int, ...] = (7, 19, 73)) -> list[dict]:
    """Each panel of features scaled, searched and judged: chosen k, least share, mean posterior, mean stability over refits from other seeds,
    and the Euclidean silhouette of its labels."""
    from lumentide.models.prepare import impute_scale
    from lumentide.operators.metrics import silhouette_exact

    out = []
    for name, features in panels.items():
        d = stored(impute_scale(df.select(key, *features), features).select(key, F.array(*features).alias("x")), "panel")
        model, table = search(d, "x", ks, starts)
        row = next(r for r in table if r["k"] == model.k)
        labelled = stored(assigned(d, "x", model).select("x", "component", "max_posterior"), "panel-labels")
        mean, silhouette = labelled.agg(F.avg("max_posterior")).first()[0], silhouette_exact(labelled, "x", "component").first()[0]
        out.append({"panel": name, "k": model.k, "least_share": row["least_share"], "posterior": mean, "stability": float(np.mean(stability(d, key, "x", model, seeds))), "silhouette": silhouette})
    return out


def two_states(df: DataFrame, key: str, vector: str, deviated_axis: int = 0, seed: int = 42) -> DataFrame:
    """A mixture of two, the one with the higher mean on an axis called deviated, and the label by the state rules."""
    from lumentide.functions.measures import state_label

    m = fit_mixtures(df, vector, [2], 3, seed)[2]
    out = assigned(df, vector, m)
    raw = np.argsort([-m.mean[c, deviated_axis] for c in range(2)])
    # posterior is ordered by size; find which place the deviated component got
    sizes = {r.component: r.x for r in out.groupBy("component").agg(F.avg(F.col(vector)[deviated_axis]).alias("x")).collect()}
    dev = max(sizes, key=lambda c: sizes[c]) if sizes else int(raw[0])
    p = F.col("posterior")[dev]
    return out.select(key, p.alias("p_deviated"), (1 - p).alias("p_undifferentiated"), state_label(p, 1 - p, F.lit(None).cast("double")).alias("state"))
