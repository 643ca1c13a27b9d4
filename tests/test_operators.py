"""Edge cases of the operators: lone points, ties, constants, nulls, NaN."""

import pytest

from lumentide.functions import measures as M
from lumentide.operators import joins as J
from lumentide.operators import quality as Q
from lumentide.operators import raster as X
from lumentide.operators import spatial as P
from lumentide.operators import summaries as S
from pyspark.sql import functions as F


def test_summary_leaves_out_nan_and_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 2.0), (None, float("inf"))], "g string, x double")
    got = {r.g: r for r in S.population_summary(df, ["g"], ["x"]).collect()}
    assert got["a"].x_n == 1 and got["a"].n_cells == 2 and got["a"].x_std is None and got[None].x_mean == 2.0


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert S.spearman(df, ["g"], "x", "y").first().rho is None


def test_nearest_with_coincident_and_lone_points(spark):
    df = spark.createDataFrame([("f", 1, 0.0, 0.0, 1.0), ("f", 2, 0.0, 0.0, 2.0), ("f", 3, 900.0, 0.0, 3.0), ("g", 9, 5.0, 5.0, 1.0)], "field string, id long, x double, y double, area double").withColumns({"circularity": F.lit(1.0), "eccentricity": F.lit(0.0)})
    got = {(r.i, r.rank): (r.j, r.d) for r in P.k_nearest(df, 6).collect()}
    assert got[1, 1] == (2, 0.0) and got[1, 2] == (3, 900.0) and len(got) == 6
    rows = {r.id: r for r in P.neighbour_features(df, diameter=None).collect()}
    assert rows[9].neighbours == 0 and rows[9].nn1 is None and rows[1].neighbours == 2 and rows[1].asymmetry == 1.0


def test_validated_join_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(ValueError):
        J.left_join(a, b, ["k"])
    with pytest.raises(KeyError):
        J.left_join(a, b, ["missing"])


def test_edge_reasons(spark):
    df = spark.createDataFrame([(0, 1, 4, 5), (2, 10, 48, 15), (10, 10, 15, 15)], "min_row int, min_col int, max_row int, max_col int")
    assert [r.qc_reason for r in Q.edge_qc(df, 50, 50, 2).collect()] == ["touches_border", "within_2px_image_edge", "keep"]


def test_touching_labels(spark):
    rows = [("i", r, c, v) for r, line in enumerate(["0000", "0112", "0112", "0000"]) for c, v in enumerate(map(int, line))]
    df = spark.createDataFrame(rows, "image_id string, row int, col int, label int")
    got = {(r.row, r.col): r.label for r in X.separate_touching(df).collect()}
    assert got[1, 1] == 1 and all(got[r, c] == 0 for r in range(4) for c in (2, 3))


def test_labels_and_rounding(spark):
    df = spark.createDataFrame([(0.995,), (0.90,), (0.95,)], "p double")
    assert [r[0] for r in df.select(M.three_way(F.col("p"))).collect()] == ["cluster2", "cluster1", "uncertain"]
    assert [r[0] for r in df.select(M.safe_div(F.col("p"), F.lit(-1.0))).collect()] == [None] * 3


def test_exact_silhouette_of_near_points_and_many_slices(spark):
    import numpy as np

    from lumentide.operators import metrics

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) + 1e3
    x = np.concatenate([x, x[:20] + 1e-7])
    label = np.arange(110) % 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = np.stack([d[:, label == c].sum(1) for c in range(4)], 1)
    n = np.bincount(label)
    a = sums[np.arange(110), label] / (n[label] - 1)
    b = np.where(np.arange(4)[None] == label[:, None], np.inf, sums / n).min(1)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, label, strict=True)], "x array<double>, c int")
    for block in (30, 4096):
        assert abs(metrics.silhouette_exact(df, "x", "c", block).first()[0] - ((b - a) / np.maximum(a, b)).mean()) < 1e-6
