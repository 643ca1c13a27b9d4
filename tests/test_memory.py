"""What a task or the driver would have to hold whole: plans and results of the steps that keep it from that."""

import re

import pytest

from __spark_entry__ import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fixed_radius_count", "local_fraction", "ring_labels", "shell_sampling"])
def test_no_pixels_or_points_are_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(queries()[name](spark, sf_dir))


def test_marker_ratios_broadcasts_no_labels(spark, sf_dir):
    text = plan(queries()["marker_ratios"](spark, sf_dir))
    assert text.count("BroadcastHashJoin") <= 2 and "SortMergeJoin" in text  # the backgrounds, a row for each image


def test_images_are_made_in_tasks_of_some_suppliers(spark):
    from lumentide.plans import rasters

    suppliers = spark.range(3000).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "CAST(id AS double) AS s_acctbal").coalesce(1)
    assert rasters._image(suppliers).rdd.getNumPartitions() == 6


def test_exact_quantiles_equal_percentile_and_gather_no_values(spark):
    from pyspark.sql import functions as F

    from lumentide.operators.quantiles import exact_quantiles

    df = spark.range(30000).selectExpr("CASE WHEN id % 3 < 2 THEN id % 3 END AS g", "CASE WHEN id % 7 > 0 THEN round(exp(9 * rand(5)), 2) END AS a", "CASE WHEN id % 3 > 0 THEN id % 50 END AS b")
    probs = (0.0, 0.1, 0.5, 0.75, 1.0)
    for by in (["g"], []):
        got = exact_quantiles(df, by, {c: F.col(c) for c in "ab"}, probs).select(*by, "a", "b").collect()
        want = df.groupBy(*by).agg(*(F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "ab")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["robust_profile", "robust_thresholds", "impute_scale", "uniformity_feature", "uniformity_multivariate"])
def test_no_percentile_gathers_a_whole_column(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "percentile(" not in text and "median(" not in text


@pytest.mark.parametrize("name", ["spearman_stratified", "spearman_within_field", "rank_pooling", "residual_spearman"])
def test_ranks_are_dealt_out_by_number_of_rows(spark, sf_dir, name, monkeypatch):
    from lumentide.operators import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    text = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[[^]]*\], (\d+)", text)[1]) > 10


def test_pixels_stay_where_they_are_dealt_to(spark, monkeypatch):
    """Spark dealt them again into as few parts as fit its cores, the name of the image being the same everywhere."""
    from lumentide.operators import raster, tables
    from lumentide.plans import rasters

    monkeypatch.setattr(tables, "ROWS_A_TASK", 2000)
    suppliers = spark.range(300).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "CAST(id AS double) AS s_acctbal")
    px, vx = rasters._image(suppliers), rasters._voxels(suppliers)
    for df, most in ((raster.border_pixels(px), 0), (raster.perimeters(px), 1), (raster.far_pixels(px, 5), 0), (raster.solid_properties(vx, (0.5, 0.2, 0.2)).select("surface"), 6)):
        text = plan(df)
        assert text.count("ENSURE_REQUIREMENTS") <= most and "REPARTITION_BY_NUM" in text
        assert not re.search(r"hashpartitioning\([^)]*row#\d+[^)]*\), ENSURE", text)
