import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.geo import from_utm, to_utm
from furrow.operators import raster as R

PX = "raster_id int, row int, col int, v int"


def table(spark, images, name="v"):
    data = [(k, r, c, int(img[r, c])) for k, img in images.items() for r in range(img.shape[0]) for c in range(img.shape[1])]
    return spark.createDataFrame(data, PX).withColumnRenamed("v", name)


def grid(df, shape, name, key):
    out = np.zeros(shape, int)
    for r in df.where(F.col("raster_id") == key).collect():
        out[r["row"], r["col"]] = r[name]
    return out


def direct_otsu(img):
    best, cost = 0, np.inf
    for th in range(img.max() + 1):
        up = img >= th
        if up.all() or not up.any():
            continue
        w = up.mean()
        c = (1 - w) * img[~up].var() + w * img[up].var()
        if c < cost - 1e-9:
            best, cost = th, c
    return best


def test_otsu_equals_trying_every_threshold(spark):
    rng = np.random.default_rng(1)
    images = {1: np.concatenate([rng.normal(60, 9, 60), rng.normal(180, 20, 40)]).clip(0, 255).astype(int).reshape(10, 10),
              2: rng.integers(0, 256, (8, 8)), 3: np.full((4, 4), 9), 4: np.array([[10, 200], [10, 200]])}
    out = {r["raster_id"]: r["threshold"] for r in R.otsu_threshold(table(spark, images, "exg")).collect()}
    assert out == {k: direct_otsu(v) for k, v in images.items()} and out[4] == 11 and out[3] == 0


def sweep(img, element, pick, blank):
    out = np.empty_like(img)
    for r in range(img.shape[0]):
        for c in range(img.shape[1]):
            near = [img[r + i, c + j] for i, j in element if 0 <= r + i < img.shape[0] and 0 <= c + j < img.shape[1]]
            out[r, c] = pick(near)
    return out


@pytest.mark.parametrize("kind,element", [("close", R.square(2)), ("open", R.diamond(3))])
def test_morphology_equals_direct_sweeps(spark, kind, element):
    rng = np.random.default_rng(2)
    img = (rng.random((23, 17)) < (0.2 if kind == "close" else 0.9)).astype(int)
    steps = (max, min) if kind == "close" else (min, max)
    want = sweep(sweep(img, element, steps[0], 0), element, steps[1], 0)
    out = R.morph(table(spark, {1: img, 2: 1 - img}, "mask").withColumn("other", F.col("row")), kind, element)
    assert out.columns == ["raster_id", "row", "col", "mask", "other"]
    assert (grid(out, img.shape, "mask", 1) == want).all()


def test_flat_and_black_images(spark):
    px = spark.createDataFrame([(1, 0, c, 0, 0, 0) for c in range(3)] + [(2, 0, 0, 0, 255, 0), (2, 0, 1, 255, 0, 0), (2, 0, 2, 9, 9, 9)], "raster_id int, row int, col int, r int, g int, b int")
    out = {(r["raster_id"], r["col"]): r["exg"] for r in R.exg(px).collect()}
    assert out == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (2, 0): 255, (2, 1): 0, (2, 2): 85}
    masked = px.withColumn("mask", F.lit(0)).withColumn("dem", F.lit(1.0))
    assert {r["Height_95p_meters"] for r in R.crop_height(masked).collect()} == {0.0}


def test_height_matches_numpy(spark):
    rng = np.random.default_rng(3)
    dem = rng.normal(5, 1, 200)
    px = spark.createDataFrame([(1, i, 0, int(i % 3 > 0), float(d)) for i, d in enumerate(dem)], "raster_id int, row int, col int, mask int, dem double")
    used = np.array([d for i, d in enumerate(dem) if i % 3 > 0])
    want = round(np.quantile(used, 0.95) - np.quantile(used, 0.05), 4)
    assert R.crop_height(px).first()["Height_95p_meters"] == pytest.approx(want, abs=1e-4)


def test_pyramid_weighs_partial_blocks(spark):
    img = np.arange(15).reshape(3, 5)
    out = R.pyramid(table(spark, {1: img}), ["v"], (2, 4))
    got = {(r["factor"], r["row"], r["col"]): r["v"] for r in out.collect()}
    for f in (2, 4):
        for i in range(0, 3, f):
            for j in range(0, 5, f):
                assert got[(f, i // f, j // f)] == pytest.approx(img[i:i + f, j:j + f].mean())
    assert len(got) == 6 + 2


def test_later_nonzero_value_wins(spark):
    bands = lambda k, v: [(k, r, c, v, 0, 7) for r in range(2) for c in range(2)]
    px = spark.createDataFrame(bands(1, 50) + bands(2, 90), "raster_id int, row int, col int, r int, g int, b int")
    rasters = spark.createDataFrame([(1, 1, 2, 2, 1.0, 0.0, 0.0, 0.0, -1.0, 2.0), (2, 0, 2, 2, 1.0, 0.0, 1.0, 0.0, -1.0, 2.0)],
                                    "raster_id int, plot_order int, width int, height int, a double, b double, c double, d double, e double, f double")
    out = {(r["out_row"], r["out_col"]): (r["r"], r["g"], r["b"]) for r in R.mosaic(px, rasters).collect()}
    assert out == {(r, c): ((50 if c < 2 else 90), 255, 7) for r in range(2) for c in range(3)}


def test_rotated_raster_samples_its_own_pixels(spark):
    # a quarter turn: the output is the transposed image
    img = np.arange(1, 10).reshape(3, 3) * 10
    px = table(spark, {1: img}).select("raster_id", "row", "col", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    rasters = spark.createDataFrame([(1, 1, 3, 3, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0)],
                                    "raster_id int, plot_order int, width int, height int, a double, b double, c double, d double, e double, f double")
    out = R.mosaic(px, rasters).collect()
    assert {(r["out_row"], r["out_col"]): r["r"] for r in out} == {(2 - c, r): int(img[r, c]) for r in range(3) for c in range(3)}


def test_reprojection_keeps_a_constant_raster(spark):
    px = spark.createDataFrame([(1, r, c, 5.0) for r in range(6) for c in range(6)], "raster_id int, row int, col int, v double")
    rasters = spark.createDataFrame([(1, 6, 6, 1.0, 0.0, 608082.0, 0.0, -1.0, 4265350.0)], "raster_id int, width int, height int, a double, b double, c double, d double, e double, f double")
    zone = F.lit(32610)

    def degrees(x, y):
        at = from_utm(x, y, zone)
        return F.struct(at["lon"].alias("x"), at["lat"].alias("y"))

    out = R.reproject_raster(px, rasters, ["v"], degrees, lambda x, y: to_utm(x, y, zone), 1e-5)
    values = [r["v"] for r in out.collect()]
    assert 25 <= len(values) <= 60 and values == pytest.approx([5.0] * len(values))


def test_plot_windows_grow_by_a_tenth_and_skip_unknown_plots(spark):
    schema = "field string, plot string, accession string, ring array<struct<x:double,y:double>>"
    d = 1e-4
    ring = [(-121.0, 38.5), (-121.0 + d, 38.5), (-121.0 + d, 38.5 + d), (-121.0, 38.5 + d), (-121.0, 38.5)]
    areas = spark.createDataFrame([("f", "1", "a", ring), ("f", "2", None, ring), ("f", "3", "a", ring[:3]), ("g", "4", "a", ring)], schema)
    x, y = spark.range(1).select(to_utm(F.lit(-121.0), F.lit(38.5))["x"], to_utm(F.lit(-121.0), F.lit(38.5))["y"]).first()
    rasters = spark.createDataFrame([("f", "r", 32610, [x - 10, 0.1, 0.0, y + 50, 0.0, -0.1])], "field string, raster_id string, epsg int, geotransform array<double>")
    out = R.plot_windows(areas, rasters, ["field"]).collect()
    assert [r["plot"] for r in out] == ["1"]
    w, h = out[0]["width"] * 0.1, out[0]["height"] * 0.1
    assert w == pytest.approx(1.2 * 8.72, rel=0.05) and h == pytest.approx(1.2 * 11.1, rel=0.05)
    assert out[0]["col_off"] * 0.1 == pytest.approx(10 - 0.1 * w / 1.2, abs=0.5)


def test_mosaic_keeps_its_resolution(spark):
    wide = spark.createDataFrame([(0, 0, 9000, 10, 1.0, 0.0, 0.0, 0.0, -1.0, 10.0)],
                                 "raster_id int, plot_order int, width int, height int, a double, b double, c double, d double, e double, f double")
    assert R.mosaic_grid(wide).first()["grid"]["width"] == 9000
    assert R.mosaic_grid(wide, 5000).first()["grid"]["width"] == 5000


@pytest.mark.parametrize("kind,element,tile", [("close", R.square(2), 5), ("open", R.diamond(3), 4), ("close", R.square(5), 7), ("open", R.square(1), 256)])
def test_morphology_across_tiles_with_holes_and_nulls(spark, kind, element, tile):
    rng = np.random.default_rng(3)
    img = rng.random((31, 19)) < (0.15 if kind == "close" else 0.9)
    hole = rng.random(img.shape) < 0.1
    null = rng.random(img.shape) < 0.05
    value = {(r, c): None if null[r, c] else int(img[r, c])
             for r in range(31) for c in range(19) if not hole[r, c]}
    want = value
    for pick in (max, min) if kind == "close" else (min, max):
        step = {}
        for r, c in want:
            near = [want[r + i, c + j] for i, j in element if want.get((r + i, c + j)) is not None]
            step[r, c] = pick(near) if near else None
        want = step
    rows = [(key, r + 100, c - 7, m, f"{r}/{c}") for key in ("a", "b") for (r, c), m in value.items()]
    df = spark.createDataFrame(rows, "raster_id string, row int, col int, mask int, _br_note string")
    out = {(x["raster_id"], x["row"] - 100, x["col"] + 7): (x["mask"], x["_br_note"])
           for x in R.morph(df, kind, element, tile=tile).collect()}
    assert out == {(k, r, c): (m, f"{r}/{c}") for k in ("a", "b") for (r, c), m in want.items()}
    assert R.morph(df.limit(0), kind, element).collect() == []


def bilinear(img, rows, cols):
    out = np.zeros((rows, cols))
    for r in range(rows):
        for c in range(cols):
            y, x = (r + 0.5) * (img.shape[0] / rows) - 0.5, (c + 0.5) * (img.shape[1] / cols) - 0.5
            y, x = min(max(y, 0), img.shape[0] - 1), min(max(x, 0), img.shape[1] - 1)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, img.shape[0] - 1), min(x0 + 1, img.shape[1] - 1)
            fy, fx = y - y0, x - x0
            out[r, c] = (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy
    return out


@pytest.mark.parametrize("shape", [(3, 4), (9, 14), (20, 1), (11, 7)])
def test_resampling_between_grids(spark, shape):
    rng = np.random.default_rng(4)
    images = {1: rng.integers(0, 256, (11, 7)), 2: rng.integers(0, 256, (1, 5))}
    onto = table(spark, {k: np.zeros(shape, int) for k in (1, 2, 3)}, "z")
    src = table(spark, images)
    smooth = {(r["raster_id"], r["row"], r["col"]): r["v"] for r in R.resample(src, onto, ["v"], whole=False).collect()}
    whole = {(r["raster_id"], r["row"], r["col"]): r["v"] for r in R.resample(src, onto, ["v"]).collect()}
    assert len(smooth) == 2 * shape[0] * shape[1] == len(whole)
    for k, img in images.items():
        for (r, c), v in np.ndenumerate(bilinear(img, *shape)):
            assert smooth[k, r, c] == pytest.approx(v, abs=1e-9)
            assert whole[k, r, c] == np.floor(smooth[k, r, c] + 0.5)


def test_a_missing_neighbour_gives_null(spark):
    src = table(spark, {1: np.arange(16).reshape(4, 4)}).where("NOT (row = 0 AND col = 0)")
    out = {(r["row"], r["col"]): r["v"] for r in R.resample(src, table(spark, {1: np.zeros((2, 2), int)}, "z"), ["v"]).collect()}
    assert out == {(0, 0): None, (0, 1): 5, (1, 0): 11, (1, 1): 13}


def test_plot_windows_are_cut_by_plots(spark, monkeypatch):
    ring = "array(struct(-121.76D AS x, 38.53D AS y), struct(-121.75D AS x, 38.53D AS y), struct(-121.75D AS x, 38.54D AS y), struct(-121.76D AS x, 38.53D AS y)) AS ring"
    areas = spark.range(0, 6, 1, 1).selectExpr("'f' AS field", "string(id) AS plot", "'a' AS accession", ring)
    rasters = spark.range(1).selectExpr("'f' AS field", "'r' AS raster_id", "32610 AS epsg", "array(6e5D, 1D, 0D, 43e5D, 0D, -1D) AS geotransform")
    whole = sorted(map(tuple, R.plot_windows(areas, rasters, ["field"]).collect()))
    monkeypatch.setattr(R, "PLOTS", 2)
    cut = R.plot_windows(areas, rasters, ["field"])
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) == 6
    assert "Repartition 3, true" in cut._jdf.queryExecution().optimizedPlan().toString()
