import math

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from furrow.functions import boxes, clock, geo, pixels, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("degrees,name", [
    (45, "North"), (45.001, "East"), (135, "East"), (225, "South"), (315, "West"), (315.001, "North"),
    (-10, "North"), (360, "North")])
def test_heading_bounds(spark, degrees, name):
    assert one(spark, geo.heading_direction(F.lit(math.radians(degrees)))) == (name,)


def test_heading_of_nothing(spark):
    assert one(spark, geo.heading_direction(F.lit(None).cast("double")),
               geo.heading_direction(F.lit(float("nan")))) == (None, None)


@pytest.mark.parametrize("written,epoch", [
    ("2025:06:24 10:14:05.5 +0000", 1750760045.5), ("2025:06:24 10:14:05 -07:00", 1750785245.0),
    ("2025-06-24 10:14:05", 1750760045.0), ("2025/06/24 10:14:05 Z", 1750760045.0), ("17.5", 17.5),
    ("2025-06-24 10:14:05.5", None), ("2025:13:24 10:14:05", None), ("soon", None), (None, None)])
def test_stamp_texts(spark, written, epoch):
    assert one(spark, clock.parse_epoch(F.lit(written).cast("string"))) == (epoch,)


def test_recording_start(spark):
    good, short = F.lit("a/2025_06_24_10_14_05_123456_robot.bin"), F.lit("2025_06_24_10.bin")
    assert one(spark, clock.base_stamp(good), clock.base_stamp(short)) == (1750760045123456, None)


def test_natural_key_orders_like_numbers(spark, collect):
    names = ["gcp10", "GCP2", "gcp1", "1b", "a2b10", "a2b9", "x" + "9" * 30, "x1" + "0" * 30]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r[0] for r in collect(df, text.natural_key(F.col("s")))]
    assert got == ["1b", "a2b9", "a2b10", "gcp1", "GCP2", "gcp10", "x" + "9" * 30, "x1" + "0" * 30]


def test_labels_and_names(spark):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, text.norm_label(s("12.0")), text.norm_label(s(" 12 ")), text.norm_label(s("1.05"))) == (
        "12", "12", "1.05")
    assert one(spark, text.plot_label(s(None), s("A")), text.plot_label(s("3"), s(None))) == ("Plot_Unknown_Acc_A", "Plot_3")
    assert one(spark, text.export_name(s("3"), s("A"), F.lit(7)), text.export_name(s("3"), s(""), F.lit(7)),
               text.export_name(s(""), s("A"), F.lit(7))) == ("plot_3_accession_A", "plot_3", "plot_7")
    assert one(spark, text.gps_status(F.lit(6)), text.gps_status(F.lit(9))) == ("RTK Fixed", "Unknown (9)")
    assert one(spark, text.extract_float(s("t -1.5 C")), text.extract_float(s("20 m"))) == (-1.5, 20.0)
    assert one(spark, text.clean_path(s(" é\x01œﬁa "))) == ("efia",)


def test_degrees_minutes_seconds(spark):
    assert one(spark, text.dms_to_decimal(F.lit("38 deg 30' 36.0\" S"))) == (pytest.approx(-38.51),)
    value = one(spark, text.to_dms(F.lit(-121.5), "W", "E"))[0]
    assert tuple(value) == (121, 30, 0.0, "W")
    assert one(spark, text.to_dms(F.lit(0.0), "W", "E"))[0]["ref"] == ""


def test_geodesic_reference_distances(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    far, near, none = one(
        spark, geo.geodesic_m(*lit(50.06632, -5.71475, 58.64402, -3.07009)),
        geo.geodesic_m(*lit(0, 0, 0, 1)), geo.geodesic_m(*lit(1, 1, 1, 1)))
    assert far == pytest.approx(969954.1663, abs=1e-3)
    assert near == pytest.approx(111319.4908, abs=1e-3)
    assert none == 0.0


@pytest.mark.parametrize("lon,lat,epsg", [(-121.76, 38.53, 32610), (151.2, -33.8, 32756), (2.9, 60.1, 32631)])
def test_utm_round_trip(spark, lon, lat, epsg):
    u = geo.to_utm(F.lit(lon), F.lit(lat))
    back = geo.from_utm(u["x"], u["y"], F.lit(epsg))
    code, lon2, lat2 = one(spark, geo.utm_epsg(F.lit(lon), F.lit(lat)), back["lon"], back["lat"])
    assert code == epsg
    assert abs(lon2 - lon) < 1e-9 and abs(lat2 - lat) < 1e-9


def test_utm_known_point(spark):
    # central meridian: easting is the false easting, northing the scaled meridian arc
    x, y = one(spark, geo.to_utm(F.lit(-123.0), F.lit(45.0))["x"], geo.to_utm(F.lit(-123.0), F.lit(45.0))["y"])
    assert x == pytest.approx(500000.0, abs=1e-6)
    assert y == pytest.approx(0.9996 * 4984944.378, abs=2e-3)


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_points_on_edges_are_outside(spark):
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    inside = [one(spark, geo.point_in_ring(F.lit(x), F.lit(y), square))[0] for x, y in (
        (1.0, 1.0), (0.0, 1.0), (4.0, 4.0), (2.0, 0.0), (5.0, 1.0), (-1.0, 4.0), (-1.0, 0.0))]
    assert inside == [True, False, False, False, False, False, False]


def test_concave_ring(spark):
    u = ring((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0))
    inside = [one(spark, geo.point_in_ring(F.lit(x), F.lit(y), u))[0] for x, y in (
        (1.0, 5.0), (3.0, 5.0), (5.0, 5.0), (3.0, 1.0), (3.0, 2.0))]
    assert inside == [True, False, True, True, False]


@pytest.mark.parametrize("points,box,area", [
    ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], (1, -1, 9, 3), 9.0),
    ([(0, 0), (4, 0), (0, 4), (0, 0)], (1, 1, 9, 9), 2.0),
    ([(0, 0), (4, 0), (0, 4), (0, 0)], (3, 3, 9, 9), 0.0),
    ([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], (-5, -5, 5, 5), 16.0),
    ([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)], (1, 1, 5, 5), 10.0)])
def test_overlap_area(spark, points, box, area):
    value = one(spark, geo.overlap_area(geo.ring_edges(ring(*points)), *[F.lit(float(v)) for v in box]))[0]
    assert value == pytest.approx(area)


@pytest.mark.parametrize("length,starts", [(1000, [0, 360]), (600, [0]), (640, [0]), (1248, [0, 608]), (1249, [0, 608, 609])])
def test_tile_starts(spark, length, starts):
    assert one(spark, boxes.tile_offsets(F.lit(length), 640, 32))[0] == starts


def test_box_overlap_cases(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    same = boxes.iou_xywh(b(5, 5, 2, 2), b(5, 5, 2, 2))
    nested = boxes.iou_xywh(b(5, 5, 2, 2), b(5, 5, 4, 4))
    apart = boxes.iou_xywh(b(5, 5, 2, 2), b(7, 5, 2, 2))
    flat = boxes.iou_xywh(b(5, 5, 0, 0), b(5, 5, 0, 0))
    wide = boxes.iou_corners(b(0, 0, 1, 1), b(1, 1, 2, 2))
    assert one(spark, same, nested, apart, flat) == (1.0, 0.25, 0.0, 0.0)
    assert one(spark, wide) == (pytest.approx(1 / 7),)


def test_thermal_and_colour(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    celsius = one(spark, pixels.raw_to_celsius(*lit(15000, 1, 0, 20, 20, 20, 1, 50, 21106.77, 1501, 1, -7340, 0.012545258)))[0]
    plain = 1501 / math.log(21106.77 / (0.012545258 * (15000 - 7340)) + 1) - 273.15
    assert celsius == pytest.approx(plain)
    assert one(spark, pixels.swap_bytes(F.lit(0x1234))) == (0x3412,)
    assert one(spark, pixels.excess_green(*[F.lit(0)] * 3), pixels.to_byte(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == (0.0, 0)
    green, red = (pixels.hsv_leaf_mask(*[F.lit(v) for v in c]) for c in ((20, 200, 20), (200, 20, 20)))
    assert one(spark, green, red) == (True, False)


def test_boxes_outside_usable_rows(spark):
    args = [F.lit(float(v)) for v in (0, 0, 100, 100)] + [F.lit(2592), F.lit(2048)]
    box = lambda *v: boxes.box_to_utm(F.array(*[F.lit(float(x)) for x in v]), *args)
    high, low, good = one(spark, box(100, 511, 5, 5), box(100, 1530, 5, 7), box(90, 512, 2591, 1024))
    assert high is None and low is None
    assert good["e1"] == 0.0 and good["e2"] == pytest.approx(1.0)


def test_paths_are_decomposed_as_arrow_text(spark):
    rows = spark.createDataFrame([(1, " Caf\u00e9/\ufb01eld \u00bd "), (2, None), (3, "a\u4e2db"), (4, "")], "k int, p string")
    out = rows.select("k", text.clean_path(F.col("p")).alias("p"))
    assert [r["p"] for r in out.orderBy("k").collect()] == ["Cafe/field 12", None, "ab", ""]
    # texts as Python objects took more than twice the memory
    assert text._decompose.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
