import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import georef as G

SCHEMA = "plot int, t long, x double, y double"


def axis(a):
    return a % math.pi


def test_main_axis_equals_svd(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for plot in range(6):
        ang = rng.uniform(0, math.pi)
        u, v = rng.normal(0, 5, 60), rng.normal(0, 0.4, 60)
        pts = np.column_stack([u * math.cos(ang) - v * math.sin(ang) + 6e5, u * math.sin(ang) + v * math.cos(ang) + 4e6])
        _, _, vt = np.linalg.svd(pts - pts.mean(axis=0), full_matrices=False)
        want[plot] = axis(math.atan2(vt[0][1], vt[0][0]))
        data += [(plot, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    for r in G.track_heading(spark.createDataFrame(data, SCHEMA), ["plot"], "t").collect():
        gap = abs(axis(r["pca_theta"]) - want[r["plot"]])
        assert min(gap, math.pi - gap) < 1e-6


def test_heading_points_ahead_and_falls_back_to_the_line(spark):
    west = [(1, i, -float(i), 0.01 * (i % 2)) for i in range(10)]
    zigzag = [(2, i, float(i % 2) * 40, float(i)) for i in range(9)]
    out = {r["plot"]: r["theta"] for r in G.track_heading(spark.createDataFrame(west + zigzag, SCHEMA), ["plot"], "t").collect()}
    assert abs(math.cos(out[1]) + 1) < 1e-3
    assert math.sin(out[2]) == pytest.approx(1.0)


def test_path_and_spacing(spark):
    data = [(1, 0, 0.0, 0.0), (1, 100, 3.0, 4.0), (1, 250, 3.0, 5.0), (2, 7, 1.0, 1.0)]
    out = {r["plot"]: r for r in G.track_length(spark.createDataFrame(data, SCHEMA), ["plot"], "t").collect()}
    assert out[1]["path"] == pytest.approx(6.0) and out[1]["direct"] == pytest.approx(math.hypot(3, 5))
    assert out[1]["mean_spacing"] == pytest.approx(3.0) and out[1]["std_spacing"] == pytest.approx(2.0)
    assert out[2]["path"] == 0.0 and out[2]["mean_spacing"] is None


def test_straight_track_georeference(spark):
    metre = 1 / 111_000
    tracks = spark.createDataFrame([(1, i, 38.5 + i * metre, -121.0) for i in range(21)], "plot int, t long, lat double, lon double")
    images = spark.createDataFrame([(1, 2000, 100)], "plot int, width int, height int")
    r = G.georeference_plots(tracks, images, ["plot"], "t").first()
    assert r["rover_direction"] == "NORTH" and r["stitch_direction"] == "UP" and r["epsg"] == 32610
    assert r["width_m"] == pytest.approx(20.0, rel=2e-3) and r["height_m"] == pytest.approx(1.0)
    assert r["px"] == pytest.approx(r["width_m"] / 2000) and r["py"] == pytest.approx(0.01)
    # north heading turned by half a circle: columns run south
    assert math.hypot(r["a"], r["d"]) == pytest.approx(r["px"]) and r["d"] < 0


def test_affine_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    src = rng.uniform(-121.8, -121.7, (40, 2))
    dst = src @ np.array([[1.01, 0.02], [-0.03, 0.98]]) + [0.5, -0.2] + rng.normal(0, 1e-4, (40, 2))
    want = np.linalg.lstsq(np.column_stack([src, np.ones(40)]), dst, rcond=None)[0].T
    pairs = spark.createDataFrame([tuple(map(float, (*s, *d))) for s, d in zip(src, dst)], "x double, y double, tx double, ty double")
    fit = G.fit_affine(pairs).first()
    moved = want @ np.array([-121.75, -121.74, 1])
    got = G.apply_affine(spark.createDataFrame([(-121.75, -121.74), (None, 1.0)], "lon double, lat double"), G.fit_affine(pairs)).collect()
    assert fit["kind"] == "affine" and fit["pairs"] == 40
    assert [got[0]["lon"], got[0]["lat"]] == pytest.approx(list(moved), abs=1e-8)
    assert tuple(got[1]) == (None, 1.0)


def test_too_few_and_collinear_points(spark):
    few = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (2.0, 3.0, 4.0, 5.0)], "x double, y double, tx double, ty double")
    line = spark.createDataFrame([(float(i), 2.0 * i, i + 0.5, 2.0 * i - 1) for i in range(5)], "x double, y double, tx double, ty double")
    spot = spark.createDataFrame([(10.0, 10.0)], "lon double, lat double")
    assert tuple(G.apply_affine(spot, G.fit_affine(few)).first()) == (10.0, 10.0)
    assert G.fit_affine(few).first()["kind"] == "none" and G.fit_affine(line).first()["kind"] == "shift"
    assert tuple(G.apply_affine(spot, G.fit_affine(line)).first()) == pytest.approx((10.5, 9.0))


def test_cross_track_strategies(spark):
    lit = F.lit
    out = spark.range(1).select(
        G.cross_track(lit(-0.2), lit(0.4)).alias("fixed"), G.cross_track(lit(-2.0), lit(2.0)).alias("wide"),
        G.cross_track(lit(0.0), lit(1.0), "hybrid", gsd=lit(0.01), img_w=lit(300), img_h=lit(200), direction=lit("UP")).alias("up"),
        G.cross_track(lit(0.0), lit(1.0), "hybrid", gsd=lit(0.01), img_w=lit(300), img_h=lit(200), direction=lit("LEFT")).alias("left"),
        G.cross_track(lit(0.0), lit(1.0), "std", v_std=lit(0.5)).alias("std")).first()
    assert tuple(out["fixed"]) == pytest.approx((1.0, -0.4, 0.6)) and out["wide"]["height"] == 4.0
    assert (out["up"]["height"], out["left"]["height"], out["std"]["height"]) == pytest.approx((3.0, 2.0, 2.5))
