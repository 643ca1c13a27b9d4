"""Measures of classifiers and clusterings, by counts of values: no order over all rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentide.operators.quantiles import counted
from lumentide.operators.tables import new_path, stored


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Average precision of a score for a 0/1 truth; equal scores count as one step."""
    d = df.where(F.col(score).isNotNull()).select((-F.col(score)).alias("s"), F.col(truth).alias("y"))
    every = counted(d, [], "s").select(F.col("value").alias("s"), (F.col("before") + F.col("n")).alias("seen"))
    hits = counted(d.where("y = 1"), [], "s").select(F.col("value").alias("s"), F.col("n").alias("pos"), (F.col("before") + F.col("n")).alias("tp"))
    return hits.join(every, "s").agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Mean silhouette of squared Euclidean distances, from each cluster's size, sum and sum of squares: no pairs of rows.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.c + the cluster's mean |y|^2, c its mean. Rows of a
    cluster of one count 0.
    """
    e = df.select(key, label, F.col(vector).alias("x")).withColumn("xx", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    parts = e.select(label, "xx", F.posexplode("x").alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    centre = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))  # as long as a vector
    stats = e.groupBy(label).agg(F.count("*").alias("n"), F.avg("xx").alias("yy")).join(centre, label).withColumnRenamed(label, "_l")
    dot = F.aggregate(F.zip_with("x", "c", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    near = e.crossJoin(F.broadcast(stats)).withColumn("d", F.greatest(F.col("xx") - 2 * dot + F.col("yy"), F.lit(0.0)))  # a row for each row and cluster
    own = F.col("_l") == F.col(label)
    s = near.groupBy(key).agg(F.max(F.when(own, F.when(F.col("n") > 1, F.col("d") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return s.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    n = n.withColumn("r", F.sum("n").over(Window.partitionBy("a"))).withColumn("c", F.sum("n").over(Window.partitionBy("b")))
    pairs = lambda x: x * (x - 1) / 2
    # each row's and column's total once: divided by how many cells it stands in
    n = n.withColumn("kr", F.count("*").over(Window.partitionBy("a"))).withColumn("kc", F.count("*").over(Window.partitionBy("b")))
    s = n.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum(pairs(F.col("r")) / F.col("kr")).alias("r"), F.sum(pairs(F.col("c")) / F.col("kc")).alias("c"), pairs(F.sum("n")).alias("t"))
    e = F.col("r") * F.col("c") / F.nullif(F.col("t"), F.lit(0.0))
    return s.select(((F.col("x") - e) / F.nullif((F.col("r") + F.col("c")) / 2 - e, F.lit(0.0))).alias("ari"))


#: Rows that every other row is held against at a time.
BLOCK = 16384


def silhouette_exact(df: DataFrame, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """Mean silhouette of Euclidean distances, over all pairs of rows, in blocks.

    A block of rows at a time, of about `block`, goes to all tasks, which add up their rows' distances to it by cluster; the sums of
    all blocks are added up by row and cluster. The time goes by the square of the rows, the memory doesn't. A row alone in its cluster,
    or with a single cluster about, counts 0; rows with a null label or vector have no part.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("own"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "silhouette-rows")
    blocks = -(-rows.count() // block)
    if not blocks:
        return rows.agg(F.avg(F.size("x")).alias("silhouette"))
    rows = stored(rows.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")), "silhouette-blocks")
    path = new_path(spark, "silhouette-sums")
    for b in range(blocks):
        some = rows.where(F.col("b") == b).select("own", "x").toArrow()
        if not some.num_rows:
            continue
        labels, at = np.unique(np.array(some["own"].to_pylist(), object), return_inverse=True)
        there = np.stack([v.values.to_numpy(zero_copy_only=False) for v in some["x"]])

        def run(batches: Iterator[pa.RecordBatch], labels=labels, at=at, there=there) -> Iterator[pa.RecordBatch]:
            square, turned = (there**2).sum(axis=1), -2 * there.T
            close, member = 1e-8 * (1 + square), np.eye(len(labels))[at]
            for whole in batches:
                for start in range(0, whole.num_rows, 16):  # distances that fit a core's cache, added up by one product
                    batch = whole.slice(start, 16)
                    x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in batch.column(1)])
                    near = x @ turned
                    near += square
                    near += (x**2).sum(axis=1)[:, None]
                    i, j = np.nonzero(near < close)  # too close for the difference of squares
                    near[i, j] = ((x[i] - there[j]) ** 2).sum(axis=1)
                    sums = np.sqrt(near, out=near) @ member
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(labels))), pa.array(np.tile(labels, n), pa.string()), pa.array(sums.ravel())], ["rid", "other", "d"])

        rows.select("rid", "x").mapInArrow(run, "rid long, other string, d double").write.mode("append").parquet(path)
    sums = spark.read.schema("rid long, other string, d double").parquet(path).groupBy("rid", "other").agg(F.sum("d").alias("d"))
    sizes = stored(rows.groupBy(F.col("own").alias("other")).agg(F.count("*").alias("n")), "silhouette-sizes")
    d = sums.join(sizes, "other").join(rows.select("rid", "own"), "rid")
    inside = F.col("own") == F.col("other")
    each = d.groupBy("rid").agg(F.max(F.when(inside & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~inside, F.col("d") / F.col("n"))).alias("b"))
    return each.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))
