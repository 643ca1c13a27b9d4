"""Median imputation, robust scaling and principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.functions.measures import finite
from lumentide.operators.quantiles import exact_quantiles


def impute_scale(df: DataFrame, features: list[str], low: float = 0.25, high: float = 0.75, fit_on: DataFrame | None = None) -> DataFrame:
    """Each feature with its median for nulls, NaN and inf, less the median, over the range between two quantiles (1 where that is 0).

    The statistics are one row; fit_on (default: df) are the rows they are taken of.
    """
    fit = df if fit_on is None else fit_on
    # quantiles after imputation: the median stands for the missing, which moves the others
    medians = exact_quantiles(fit, [], {f"_m_{f}": finite(F.col(f)) for f in features}, (0.5,)).select(*(F.col(f"_m_{f}")[0].alias(f"_m_{f}") for f in features))
    filled = fit.crossJoin(F.broadcast(medians))
    value = lambda f: F.coalesce(finite(F.col(f)), F.col(f"_m_{f}"))
    stats = exact_quantiles(filled, [], {f"_q_{f}": value(f) for f in features}, (low, 0.5, high)).select(*(f"_q_{f}" for f in features)).crossJoin(medians)
    out = df.crossJoin(F.broadcast(stats))
    scale = lambda f: F.when(F.col(f"_q_{f}")[2] > F.col(f"_q_{f}")[0], F.col(f"_q_{f}")[2] - F.col(f"_q_{f}")[0]).otherwise(1.0)
    out = out.withColumns({f: (value(f) - F.col(f"_q_{f}")[1]) / scale(f) for f in features})
    return out.drop(*(f"_m_{f}" for f in features), *(f"_q_{f}" for f in features))


@dataclass
class Components:
    mean: np.ndarray
    vectors: np.ndarray  # columns
    share: np.ndarray

    def transform(self, df: DataFrame, vector: str, into: str = "scores") -> DataFrame:
        """Scores of an array column: centred, then one weighted sum a component, as plain expressions."""
        centred = F.zip_with(F.col(vector), F.array(*map(F.lit, self.mean.tolist())), lambda x, m: x.cast("double") - m)
        dot = lambda w: F.aggregate(F.zip_with("_c", F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
        return df.withColumn("_c", centred).withColumn(into, F.array(*(dot(w) for w in self.vectors.T))).drop("_c")


def principal_components(df: DataFrame, vector: str, k: int | None = 5, variance: float | None = None) -> Components:
    """Components of an array column, k of them or as many as hold a share of the variance; each one's largest loading is positive."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import DenseMatrix  # noqa: F401
    from pyspark.ml.stat import Summarizer

    v = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    mean = np.array(v.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
    d = len(mean)
    from pyspark.ml.feature import PCA

    model = PCA(k=d if variance is not None else min(k, d), inputCol="v", outputCol="p").fit(v)  # second moments in one pass
    vectors, share = model.pc.toArray(), np.array(model.explainedVariance.toArray())
    if variance is not None:
        n = int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1)
        vectors, share = vectors[:, :n], share[:n]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Components(mean, vectors * np.where(sign == 0, 1, sign), share)
