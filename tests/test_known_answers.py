"""Small inputs whose answers are known by hand: shapes, neighbours, ratios, models, guards, files, streams."""

import io
import json
import math
import random
import zipfile
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentide.functions import cubes
from lumentide.functions import measures as M
from lumentide.models import learners, mixtures, prepare, sensitivity, thresholds
from lumentide.operators import compare as C
from lumentide.operators import metrics, morphology, pairing, quantiles, raster, schema, spatial, summaries, tiles
from lumentide.operators import quality as Q
from lumentide.operators import text as T
from lumentide.sources import images, inventory, tables


def pixels(spark, label, v=None, image="i"):
    label = np.asarray(label)
    v = np.zeros(label.shape) if v is None else np.broadcast_to(np.asarray(v, float), label.shape)
    rows = [(image, r, c, int(label[r, c]), float(v[r, c])) for r in range(label.shape[0]) for c in range(label.shape[1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "row", "col", "label", "v"]), "image_id string, row int, col int, label int, v double")


def disk(side, r, at):
    y, x = np.indices((side, side))
    return ((y - at[0]) ** 2 + (x - at[1]) ** 2 <= r * r).astype(int)


def test_square_shapes(spark):
    label = np.zeros((50, 50), int)
    label[10:15, 10:15], label[25:30, 25:30] = 3, 4
    got = {r.label: r for r in raster.shape_properties(pixels(spark, label)).collect()}
    assert got[3].area == got[4].area == 25 and got[3].perimeter == 16 and got[3].hull_area == 25 and got[3].solidity == 1.0
    assert (got[3].centroid_row, got[3].centroid_col) == (12.0, 12.0) and abs(got[3].aspect_ratio - 1) < 1e-9


def test_hull_of_an_l(spark):
    label = np.zeros((6, 6), int)
    label[1:5, 1] = label[4, 1:5] = 1
    got = raster.shape_properties(pixels(spark, label)).first()
    assert got.area == 7 and got.hull_area == 10 and abs(got.solidity - 0.7) < 1e-9


def test_neighbours_of_two_cells(spark):
    rows = [("i", 3, 12.0, 12.0, 25.0, 1.0, 0.0, 5.0), ("i", 4, 27.0, 27.0, 25.0, 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "field string, id long, x double, y double, area double, circularity double, eccentricity double, diameter double")
    got = {r.id: r for r in spatial.neighbour_features(df, features=("area",)).collect()}
    assert got[3].neighbours == 1 and abs(got[3].nn1 - 15 * math.sqrt(2)) < 1e-9 and got[3].knn_std == 0 and got[3].nb_area_mean == 25 and got[3].nb_area_std == 0
    assert got[3].size_disagreement == 0 and abs(got[3].asymmetry - 1) < 1e-9 and got[3].within == 0


def test_ties_at_the_kth_distance(spark):
    points = [(0, 0)] + [(round(math.cos(a * math.pi / 4) * 8), round(math.sin(a * math.pi / 4) * 8)) for a in range(0, 8, 2)]
    df = spark.createDataFrame([("f", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "field string, id long, x double, y double")
    assert spatial.nearest_pairs(df, 2).where("i = 0").count() == 4 and spatial.k_nearest(df, 2).where("i = 0").count() == 2


def test_composite_row(spark):
    row = spark.createDataFrame([("i", 100.0, 40.0, 2.0, 0.9, 20.0, 4.0, 10.0, 20.0, 10.0)], "image_id string, area double, perimeter double, aspect_ratio double, solidity double, intensity_mean double, intensity_std double, intensity_range double, nn1 double, diameter double")
    r = spatial.composite_features(row).first()
    assert abs(r.intensity_cv - 0.2) < 1e-12 and r.intensity_range_ratio == 0.5 and r.spacing_units == 2 and abs(r.convexity_deficit - 0.1) < 1e-12 and r.size_log_ratio == 0


@pytest.mark.parametrize(("ring", "want"), [(60, 2.0), (15, 20.0), (11, 100.0), (10, None), (5, None)])
def test_marker_ratio_of_a_disc(spark, ring, want):
    label = disk(120, 10, (60, 60))
    v = np.where(label > 0, 110, np.where(disk(120, 14, (60, 60)) > 0, ring, 10))
    r = raster.marker_ratios(pixels(spark, label, v), 4, 30).first()
    assert r.nuclear_median == 110 and (r.ratio is None if want is None else abs(r.ratio - want) < 1e-9)
    assert r.qc_reasons == ("corrected_ratio_available_not_quality_validated" if want else "nonpositive_corrected_denominator")


def test_no_background_keeps_the_raw_ratio(spark):
    label = disk(60, 8, (30, 30))
    v = np.where(label > 0, 110, 60)
    r = raster.marker_ratios(pixels(spark, label, v), 3, 10, background_least=100_000).first()
    assert abs(r.raw_ratio - 110 / 60) < 1e-9 and r.ratio is None and r.qc_reasons == "background_unavailable"


def test_far_pixels_are_those_beyond_the_distance(spark):
    label = np.zeros((30, 40), int)
    label[5:8, 6:9], label[20, 30] = 1, 2
    far = {(r.row, r.col) for r in raster.far_pixels(pixels(spark, label), 6).collect()}
    d = morphology.distance(label == 0)
    assert far == {tuple(x) for x in np.argwhere(d > 6)}


def test_solid_ball(spark):
    z, y, x = np.indices((15, 15, 15))
    ball = (z - 7) ** 2 + (y - 7) ** 2 + (x - 7) ** 2 <= 36
    vx = spark.createDataFrame(pd.DataFrame(np.argwhere(ball), columns=["z", "row", "col"]).assign(image_id="i", label=1))
    r = raster.solid_properties(vx, (1.0, 1.0, 1.0)).first()
    assert r.volume == ball.sum() and r.height == 13 and r.max_section == ball[7].sum() and abs(r.axis_1 - r.axis_3) < 1e-9
    eig = np.sqrt(np.linalg.eigvalsh(np.cov(np.argwhere(ball).T))) * 4
    assert np.allclose(sorted([r.axis_1, r.axis_2, r.axis_3]), eig)


def test_morphology_against_plain_loops():
    rng = np.random.default_rng(3)
    mask = rng.random((23, 31)) < 0.15
    near = lambda r: np.array([[any(mask[a, b] for a in range(23) for b in range(31) if (a - y) ** 2 + (b - x) ** 2 <= r * r) for x in range(31)] for y in range(23)])
    assert (morphology.shifted_or(mask, 3) == near(3)).all()
    d = morphology.distance(~mask)
    assert np.allclose(d, [[min(math.hypot(y - a, x - b) for a, b in np.argwhere(mask)) for x in range(31)] for y in range(23)])
    parts = morphology.components(mask)
    assert all(parts[y, x] == parts[y, x + 1] for y in range(23) for x in range(30) if mask[y, x] and mask[y, x + 1]) and ((parts > 0) == mask).all()


def test_colony_and_edges(spark):
    label = np.zeros((60, 60), int)
    label[20:40, 20:40] = np.arange(400).reshape(20, 20) % 2 + 1
    px = pixels(spark, label)
    inside = tiles.colony_support(px, dilate=2, close=2, holes=50, least=100).where("inside")
    assert inside.where("label > 0").count() == 400 and inside.count() > 400
    e = tiles.edge_distances(px, 1.0, 2.0, 2, 2, 50, 100).collect()
    assert {r.label for r in e} == {1, 2} and all(r.edge_least > 0 and r.status == "edge_band" for r in e)
    assert morphology.texture(pixels(spark, label, np.indices((60, 60))[1])).first().coherence > 0.99


def test_adapter_of_a_model(spark):
    class Half:
        def eval(self, image, level):
            return (image > level).astype(int)

    px = pixels(spark, np.zeros((4, 4), int), np.arange(16).reshape(4, 4))
    assert morphology.segmented(px, Half(), level=7).where("label = 1").count() == 8


def test_step_threshold_known_answer(spark):
    v = [1, 1.2, 1.4, 1.6, 9.5, 10, 10.5, 11]
    t = thresholds.step_threshold(np.array(v))
    assert 1.6 < t < 9.5 and [int(x > t) for x in v] == [0] * 4 + [1] * 4
    with pytest.raises(ValueError):
        thresholds.step_threshold(np.ones(5))
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 1, 2.0), ("b", 2, 2.0), ("b", 3, 2.0)], "g string, k int, v double")
    got = thresholds.binarised(df, ["g"], "k", "v").collect()
    assert [r.high for r in sorted((r for r in got if r.g == "a"), key=lambda r: r.k)] == [False] * 4 + [True] * 4 and all(r.threshold is None for r in got if r.g == "b")


def test_step_threshold_by_bounds_equals_the_search(monkeypatch):
    rng, sure = np.random.default_rng(11), 0
    for i in range(30):
        v = [rng.normal(size=60), rng.lognormal(size=45), rng.random(50), np.round(20 * rng.normal(size=80)), np.append(rng.normal(size=40), rng.normal(9, 1, 20))][i % 5]
        x, w = np.unique(v, return_counts=True)
        most, ranks = min(len(v) - 2, len(x) - 1), ((len(v) - 3) // 2, (len(v) - 2) // 2)
        votes = thresholds._all_votes(x, w.astype(float), most)
        want = np.sort(np.append(votes, np.repeat(votes[-1], len(v) - 2 - most)))[list(ranks)].tolist()
        got = thresholds._sure_middles(x, w.astype(float), most, ranks)
        sure += got is not None
        assert got in (None, want)
    assert sure > 10
    monkeypatch.setattr(thresholds, "_all_votes", None)  # many values are not searched: the time would go by their square
    big = rng.normal(size=30000)
    assert np.min(np.abs(np.sort(big) - thresholds.step_threshold(big))) > 0


def test_mixture_of_two_clouds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (120, 2)), rng.normal(8, 1, (60, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model, table = mixtures.search(df, "x", [1, 2], 2)
    assert model.k == 2 and len(table) == 2 and all(b >= a - 1e-6 for a, b in zip(model.trace, model.trace[1:], strict=False))
    got = mixtures.assigned(df, "x", model).collect()
    assert all(abs(sum(r.posterior) - 1) < 1e-8 for r in got) and sum(r.component == 0 for r in got) == 120
    again = mixtures.fit_mixtures(df.repartition(7), "x", [2], 2)[2]
    assert np.allclose(again.mean, model.mean) and abs(model.bic - (-2 * model.loglik + model.parameters * math.log(180))) < 1e-9
    assert mixtures.stability(df, "id", "x", model, (7,))[0] > 0.95


def test_components_are_centred_and_signed(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [5, 2, 1] + 7
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    pc = prepare.principal_components(df, "x", 2)
    s = np.array([r.scores for r in pc.transform(df, "x").collect()])
    assert np.allclose(s.mean(0), 0, atol=1e-9) and np.all(pc.vectors[np.abs(pc.vectors).argmax(0), [0, 1]] > 0) and s[:, 0].var() > s[:, 1].var()
    assert prepare.principal_components(df, "x", None, 0.95).vectors.shape[1] == 2


def test_imputation_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (float("inf"), 5.0)], "a double, b double")
    got = prepare.impute_scale(df, ["a", "b"]).collect()
    assert got[1].a == 0 and got[3].a == 0 and all(r.b == 0 for r in got)


def test_clusters_trees_and_sensitivity(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.5, (60, 2)), rng.normal(5, 0.5, (60, 2))])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 60), float(v[0]), float(rng.random())) for i, v in enumerate(x)], "id long, x array<double>, y int, a double, b double")
    k = learners.kmeans(df, "x", 2, 2)
    assert metrics.adjusted_rand(k, "y", "cluster").first().ari == 1.0 and learners.dispersion_indices(k, "x", "cluster").first().davies_bouldin < 0.5
    assert metrics.silhouette_exact(k, "x", "cluster", block=50).first().silhouette > 0.8
    train, test = learners.split(df, "id", "y")
    assert train.count() + test.count() == 120
    model = learners.boosted_trees(train, ["a", "b"], "y", 3, 2)
    got = learners.Inference(["a", "b"], ["id"]).run(test, model)
    assert got.where("(probability > 0.5) <> (y = 1)").isEmpty() and {r.feature: r.gain for r in learners.importances(spark, model, ["a", "b"]).collect()}["a"] > 0.9
    with pytest.raises(ValueError):
        learners.Inference(["a"], ["id"], scaling="group")


def test_spread_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.lognormal(size=3000)] + [("b", float(v % 3)) for v in range(500)] + [(None, 1.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = {r.g: (r.n, r.q) for r in df.where("x is not null").groupBy("g").agg(F.count("*").alias("n"), F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r.g: (r.n, r.q) for r in quantiles.spread_quantiles(df, ["g"], "x", probs).collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and np.allclose(got[g][1], want[g][1]) for g in want)
    ranks = {r.x: r.r for r in quantiles.spread_ranks(df.where("g = 'b'"), "x", "r").collect()}
    assert ranks == {0.0: 84.0, 1.0: 251.0, 2.0: 417.5}


def test_effects_known_answer(spark):
    rows = [("Ctrl", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("HA1", v) for v in (4.0, 5.0, 6.0, 7.0)] + [("HA2", v) for v in (1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame([(2500, g, v) for g, v in rows], "density int, g string, x double")
    assert {r.g: r.effect for r in summaries.control_effects(df, "density", "g", "Ctrl", "x").collect()} == {"Ctrl": 0.0, "HA1": 2.0, "HA2": 0.0}


def test_rotation_keeps_distances(spark):
    p = [(0.0, 0.0), (1.0, 2.0), (2.0, 1.0), (3.0, 4.0)]
    got = [(r.u, r.v) for r in summaries.rotated(spark.createDataFrame([("a", x, y) for x, y in p], "g string, x double, y double"), ["g"], "x", "y").orderBy("x").collect()]
    assert all(abs(math.dist(got[i], got[j]) - math.dist(p[i], p[j])) < 1e-9 for i in range(4) for j in range(i)) and np.var([u for u, _ in got]) >= np.var([v for _, v in got])


def test_signed_rank_and_extremes(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, -2.0, 3.0, 4.0, 0.0, 4.0)], "g string, v double")
    r = C.signed_rank(df, "g", "v").first()
    assert (r.n, r.w_plus, r.w_minus) == (5, 13.0, 2.0)
    # the two-sided p by all signs, with ties; the normal form where there are many
    rnd = random.Random(3)
    rows = [(f"g{n}", float(rnd.randint(-4, 5))) for n in range(1, 13) for _ in range(n)] + [("many", rnd.gauss(0.3, 1)) for _ in range(400)] + [("none", None), ("zero", 0.0)]
    got = {r.g: r for r in C.signed_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in {r[0] for r in rows} - {"none", "zero"}:
        v = np.array([x for h, x in rows if h == g and x])
        if not len(v):
            assert g not in got
            continue
        ranks = np.array([(np.abs(v) < a).sum() + ((np.abs(v) == a).sum() + 1) / 2 for a in np.abs(v)])
        w = ranks[v > 0].sum()
        if len(v) <= 12:
            sums = np.array([sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=len(v))])
            want = min(1.0, 2 * min((sums <= w).mean(), (sums >= w).mean()))
        else:
            want = math.erfc(abs(got[g].z) / math.sqrt(2))
        assert got[g].w_plus == w and abs(got[g].p - want) < 1e-9
    assert "zero" not in got and "none" not in got


def test_sensitivity_of_known_functions(spark):
    bounds = {"a": (0.0, 1.0), "b": (-1.0, 1.0), "c": (2.0, 3.0), "d": (0.0, 1.0)}
    points = sensitivity.design(spark, bounds, 1024)
    assert points.count() == 1024 * 10 and {r.block for r in points.select("block").distinct().collect()} == {"a", "b", *(f"{s}_{f}" for s in "ab" for f in "abcd")}
    first = np.array([[float(r.x), float(r.y)] for r in spark.range(256).select("id", sensitivity.sequence_point(F.col("id"), 0).alias("x"), sensitivity.sequence_point(F.col("id"), 5).alias("y")).orderBy("id").collect()])
    for k in range(9):  # each half, quarter, ... holds as many points, and so do boxes of both
        boxes = set(zip((first[:, 0] * 2**k).astype(int), (first[:, 1] * 1).astype(int)))
        assert len(boxes) == 2**k and len(set((first[:, 1] * 256).astype(int))) == 256
    got = {r.input: r for r in sensitivity.sensitivity(points.withColumn("score", 4 * F.col("a") + F.col("b") + 7), list(bounds)).collect()}
    for f, want in (("a", 16 / 20), ("b", 4 / 20), ("c", 0), ("d", 0)):
        assert abs(got[f].first - want) < 0.005 and abs(got[f].total - want) < 0.005
    # a product: of the variances 1/12 * (1/3) + ..., known in closed form
    got = {r.input: r for r in sensitivity.sensitivity(points.withColumn("score", F.col("a") * F.col("b")), list(bounds)).collect()}
    whole = 1 / 9  # of a * b: mean 0, second moments 1/3 * 1/3
    assert abs(got["a"].first) < 0.005 and abs(got["b"].first - (1 / 12) / whole) < 0.005
    assert abs(got["a"].total - (1 / 36) / whole) < 0.005 and abs(got["b"].total - 1) < 0.005
    assert all(r.first is None for r in sensitivity.sensitivity(points.withColumn("score", F.lit(1.0)), ["a"]).collect())


def test_surfaces_by_cubes(spark):
    areas = cubes.cube_areas(1.0, 1.0, 1.0)
    assert areas[0] == areas[255] == 0 and all(abs(areas[i] - areas[255 - i]) < 1e-9 for i in range(256) if bin(i).count("1") in (1, 2, 3) and len(cubes._loops([bool(i >> k & 1) for k in range(8)])) == 1)
    box = [("i", z, r, c, 1, 1.0) for z in range(4) for r in range(5) for c in range(6)]
    g = np.argwhere((np.indices((25, 25, 25)) - 12).__pow__(2).sum(0) <= 100)
    ball = [("i", int(z), int(r), int(c), 2, 1.0) for z, r, c in g + 40]
    vx = spark.createDataFrame(box + ball, "image_id string, z int, row int, col int, label int, v double")
    got = {r.label: r for r in raster.solid_properties(vx, (1.0, 1.0, 1.0)).collect()}
    flat, edges = 2 * (3 * 4 + 3 * 5 + 4 * 5), 4 * (3 + 4 + 5) * 0.5**0.5
    assert abs(got[1].surface - (flat + edges + 8 * 3**0.5 / 8)) < 1e-9
    assert 1.0 < got[2].surface / (4 * math.pi * 100) < 1.09 and 0.9 < got[2].sphericity < 1.0
    wide = {r.label: r for r in raster.solid_properties(vx, (2.0, 2.0, 2.0)).collect()}
    assert abs(wide[2].surface - 4 * got[2].surface) < 1e-6


def test_containment_and_one_to_one(spark):
    left = spark.createDataFrame([("abcd ef",), ("xyz",), ("nothing here",)], "k string")
    right = spark.createDataFrame([("zz abcd ef gh", "p2"), ("abcd", "p1"), ("xyz", "p3")], "k string, path string")
    assert {r.k: r.path for r in pairing.contained(left, right, "k", "path").collect()} == {"abcd ef": "p1", "xyz": "p3", "nothing here": None}
    with pytest.raises(ValueError):
        pairing.paired(right.withColumn("k", F.lit("same")), right, "k")
    with pytest.raises(ValueError):
        pairing.zipped(left.limit(1), right, "k", "k")
    assert pairing.zipped(left, right, "k", "path").count() == 3


def test_schema_guards(spark):
    with pytest.raises(ValueError):
        schema.refuse_leakage(["area_px", "yap_mean"])
    schema.refuse_leakage(["dapi_mean_intensity"])
    with pytest.raises(KeyError):
        schema.switched(["a", "b"], {"c": True})
    with pytest.raises(TypeError):
        schema.switched(["a", "b"], {"a": 1})
    assert schema.switched(["a", "b", "c"], {"b": False}) == ["a", "c"]
    assert schema.resolved(["area_um2"], [{"name": "area", "candidates": ["area", "area_um2"], "required": True}])[0]["column"] == "area_um2"
    with pytest.raises(KeyError):
        schema.resolved([], [{"name": "area", "candidates": ["area"], "required": True}])
    assert schema.prefer_physical(["area_px2", "area_um2", "eccentricity"]) == ["area_um2", "eccentricity"]
    assert schema.picked(["image_name", "Name"], ["name"], []) == "Name" and schema.picked(["a_label_x", "label"], [], ["label"]) == "label" and schema.picked(["a"], [], ["z"]) is None
    assert schema.abbreviated(["nucleus_area", "nuc_area"], {"nucleus": "nuc"}) == {"nucleus_area": "nuc_area", "nuc_area": "nuc_area_2"}
    assert schema.same_meaning(["area_px", "nucleus_area", "x"]) == {"area": ["area_px", "nucleus_area"]}
    a, b = spark.range(1).select(F.lit(1.0).alias("y"), F.lit("s").alias("t"), F.lit(1).alias("group_n")), spark.range(1).select(F.lit(2).alias("y"), F.lit(1).alias("t"))
    assert schema.common_numeric(a, b) == ["y"]


def test_files_and_runs(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.csv").write_bytes("﻿x,y\n1,é\n".encode())
    (tmp_path / "d" / "sub" / "b.csv").write_bytes("x,y\n1,日本\n".encode("cp932"))
    assert tables.probed_encoding(spark, str(tmp_path / "d" / "a.csv")) == "utf-8" and tables.probed_encoding(spark, str(tmp_path / "d" / "sub" / "b.csv")) == "cp932"
    assert tables.read_csv_any(spark, str(tmp_path / "d" / "a.csv")).columns == ["x", "y"] and tables.read_csv_any(spark, str(tmp_path / "d" / "sub" / "b.csv")).first().y == "日本"
    found = {r.rel_path: r for r in inventory.listing(spark, str(tmp_path / "d"), [("sub/", "inner")]).collect()}
    assert set(found) == {"a.csv", "sub/b.csv"} and found["sub/b.csv"].category == "inner" and found["a.csv"].suffix == "csv"
    manifest = lambda: spark.createDataFrame(inventory.manifest(spark, str(tmp_path / "d"), [("a.", "first")]).collect())
    before = manifest()
    assert {r.role for r in before.collect()} == {"first", "other"}
    (tmp_path / "d" / "a.csv").write_bytes(b"other")
    assert [r.change for r in inventory.changed(before, manifest()).collect()] == ["changed"]
    one, two = (tables.run_directory(spark, f"file://{tmp_path}/runs", "step", "t") for _ in range(2))
    assert one != two
    path = tables.write_run_info(spark, two, {"k": 3})
    assert json.load(open(path.removeprefix("file://")))["parameters"]["k"] == 3
    df = spark.range(3)
    assert tables.next_version(spark, df, f"{tmp_path}/v").endswith("v1") and tables.next_version(spark, df, f"{tmp_path}/v").endswith("v2")


def test_images_and_masks(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(24).reshape(2, 4, 3).astype(np.uint8))
    got = images.read_images(spark, str(tmp_path / "one.npy"), "green").orderBy("row", "col").collect()
    assert [r.v for r in got] == [float(x) for x in np.arange(24).reshape(2, 4, 3)[:, :, 1].ravel()] and got[0].image_id == "one"
    np.savez(tmp_path / "m.npz", labels=np.array([[0, 1], [2, 2]], np.uint16), other=np.zeros(2))
    masks = images.read_masks(spark, str(tmp_path / "m.npz"))
    assert sorted(r.label for r in masks.collect()) == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        images.same_shape(images.read_images(spark, str(tmp_path / "one.npy"), 0), masks.withColumn("image_id", F.lit("one")))
    (tmp_path / "p.pgm").write_bytes(b"P5 2 1 255\n\x05\x07")
    assert [r.v for r in images.read_images(spark, str(tmp_path / "p.pgm")).orderBy("col").collect()] == [5.0, 7.0]
    np.save(tmp_path / "stack.npy", np.stack([np.full((2, 3, 3), 1), np.full((2, 3, 3), 4095)]).astype(np.uint16))
    stats = images.stack_statistics(images.read_stacks(spark, str(tmp_path / "stack.npy"), "CZYX")).orderBy("ch").collect()
    assert [(r.planes, r.height, r.p50, r.saturated) for r in stats] == [(2, 3, 1.0, 0.0), (2, 3, 4095.0, 1.0)]
    with pytest.raises(ValueError):
        images.plane(np.zeros((3, 9, 9)))


def test_documents(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>A &amp; b</w:t></w:r><w:r><w:t xml:space='preserve'> c</w:t></w:r></w:p><w:p/></w:document>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    got = T.paragraphs(images.read_documents(spark, str(tmp_path)), "path", "xml").orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(0, "A & b c"), (1, "")]


def test_keys_and_flags(spark):
    row = spark.createDataFrame([("/x/My Img_mask_mask.TIF", "12.0", "P 10", "D43D")], "p string, i string, n string, s string")
    day, regimen = M.stage_code(F.col("s"))
    r = row.select(M.stem_key(F.col("p")).alias("k"), M.integer_key(F.col("i")).alias("i"), M.suffix_number(F.col("n")).alias("n"), day.alias("d"), regimen.alias("r")).first()
    assert tuple(r) == ("my img", "12", 10, 4, 3)
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, None)], "a double, b double, c double")
    assert {r.feature for r in Q.usable_features(df, ["a", "b", "c"]).where("usable").collect()} == {"a", "b"}
    assert [(r.dropped, r.kept) for r in Q.duplicate_features(df, ["a", "b", "c"]).collect()] == [("b", "a")]
    assert Q.sample_per_group(df.withColumn("g", F.lit(1)), ["g"], "a", 1).count() == 1
    with pytest.raises(Exception, match="unknown"):
        df.selectExpr("5 as min_row", "5 as min_col", "6 as max_row", "6 as max_col").select(Q.border_flag(F.lit(None).cast("int"), F.lit(9), 1)).collect()


def test_wanted_label_at_the_edge_is_an_error(spark):
    px = pixels(spark, [[1, 1, 0], [0, 2, 0], [0, 0, 0]])
    with pytest.raises(Exception, match="edge"):
        raster.phenotype_mask(px, px.where("label = 1"), 3, 3).collect()
    assert {r.label for r in raster.phenotype_mask(px, px.where("label = 2"), 3, 3).collect()} == {0, 2}
