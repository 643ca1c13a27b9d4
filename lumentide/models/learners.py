"""Cluster centres, boosted trees and importances, over pyspark.ml and plain expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.operators.tables import stored


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 20, seed: int = 42) -> DataFrame:
    """Adds cluster, of the best of some starts by the sum of squared distances."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    fits = [KMeans(k=k, seed=seed + s, featuresCol="_v", predictionCol="cluster").fit(d) for s in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(d).drop("_v")


def dispersion_indices(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin indices, from each cluster's size, centre and distances to it; pairs of clusters only."""
    d = df.select(F.col(label).alias("l"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    e = d.select("l", F.posexplode("x").alias("i", "v"))
    centre = e.groupBy("l", "i").agg(F.avg("v").alias("c")).groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    whole = e.groupBy("i").agg(F.avg("v").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("w"))
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)
    s = d.join(stored(centre, "centres"), "l").groupBy("l").agg(F.count("*").alias("n"), F.sum(gap("x", "c")).alias("within"), F.avg(F.sqrt(gap("x", "c"))).alias("s"), F.first("c").alias("c"))
    k, n = F.count("*"), F.sum("n")
    ch = s.crossJoin(F.broadcast(whole)).agg(((F.sum(F.col("n") * gap("c", "w")) / (k - 1)) / (F.sum("within") / (n - k))).alias("calinski_harabasz"))
    a, b = s.select("l", "s", "c").alias("a"), s.select("l", "s", "c").alias("b")
    worst = a.join(F.broadcast(b), F.col("a.l") != F.col("b.l")).groupBy("a.l").agg(F.max((F.col("a.s") + F.col("b.s")) / F.sqrt(gap("a.c", "b.c"))).alias("r"))  # a row for each two clusters
    return ch.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin")))


def split(df: DataFrame, key: str, truth: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, dealt within each class by a hash of the key: the same whatever the partitions."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.col(truth), F.lit(seed)), F.lit(10_000))
    return df.where(bucket < int(share * 10_000)), df.where(bucket >= int(share * 10_000))


def boosted_trees(train: DataFrame, features: list[str], truth: str, rounds: int = 50, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees for a 0/1 truth; nulls are imputed by medians beforehand (prepare.impute_scale)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    d = train.select(F.col(truth).cast("double").alias("label"), array_to_vector(F.array(*(F.col(f).cast("double") for f in features))).alias("features"))
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(d)


def scored(df: DataFrame, model, features: list[str], into: str = "probability") -> DataFrame:
    """Adds the probability of the class 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("features", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))))
    return model.transform(d).withColumn(into, vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", *([] if into == "probability" else ["probability"]))


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """Each feature's share of the gain, 0 for unused ones."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, gain double")


def attribution_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean size, mean, and spread of the size of each feature's attributions (one column each)."""
    return df.select(*features).unpivot([], features, "feature", "value").groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"), F.stddev_pop(F.abs("value")).alias("std_abs"))


@dataclass
class Inference:
    """How a trained model is applied: inputs, where labels come from, and batch-wise or plain scaling as parameters."""

    features: list[str]
    key: list[str]
    by: list[str] = field(default_factory=list)
    scaling: str = "plain"  # or group

    def __post_init__(self) -> None:
        if self.scaling not in ("plain", "group") or (self.scaling == "group" and not self.by):
            raise ValueError("scaling is plain, or group with columns to group by")

    def run(self, df: DataFrame, model) -> DataFrame:
        from lumentide.functions.measures import deviation_score, three_way
        from lumentide.operators.joins import require_columns
        from lumentide.operators.quality import robust_scale_or_global

        require_columns(df, *self.features, *self.key, *self.by)
        for f in self.features if self.scaling == "group" else []:
            df = robust_scale_or_global(df, f, self.by, f)
        out = scored(df, model, self.features)
        return out.withColumns({"label": three_way(F.col("probability")), "score": deviation_score(F.col("probability"))})
