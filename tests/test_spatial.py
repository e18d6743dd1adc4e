import math
import random

import pytest
from pyspark.sql import functions as F

from furrow.operators.intervals import assign_intervals, interval_join
from furrow.operators.spatial import (
    _cell_join, _near_pairs, associate_plots, box_pairs, match_borders, max_overlap_join, nearest_pixel, nearest_within, pip_first,
    pip_join, select_gcp_images)
from furrow.plans.greedy import queue_choice, serial_choice
from furrow.plans.session import cut_lineage

POLYS = "ordinal int, plot string, accession string, ring array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    ends = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [(float(x), float(y)) for x, y in ends]


def test_points_in_polygons_of_very_different_size(spark):
    rng = random.Random(4)
    boxes = [(0.0, 0.0, 1000.0, 1000.0), (5.0, 5.0, 5.5, 5.25)] + [
        (x, y, x + w, y + w) for x, y, w in ((rng.uniform(0, 90), rng.uniform(0, 90), rng.choice([0.3, 2, 17])) for _ in range(40))]
    polys = spark.createDataFrame([(i, "p", "a", box(*b)) for i, b in enumerate(boxes)], POLYS)
    pts = [(i, rng.uniform(-5, 100), rng.uniform(-5, 100)) for i in range(300)] + [(300, 5.2, 5.1)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {(r["id"], r["ordinal"]) for r in pip_join(df, polys, base=1.0).collect()}
    want = {(i, n) for i, x, y in pts for n, b in enumerate(boxes) if b[0] < x < b[2] and b[1] < y < b[3]}
    assert got == want
    first = {r["id"]: r["ordinal"] for r in pip_first(df, polys, ["id"], "ordinal", base=1.0).collect()}
    assert first == {i: min((n for j, n in want if j == i), default=None) for i, _, _ in pts}


def test_largest_overlap(spark):
    polys = spark.createDataFrame([(0, "p", "a", box(0, 0, 10, 10)), (1, "q", "b", box(8, 0, 20, 10)), (2, "r", "c", box(8, 0, 20, 10))], POLYS)
    images = spark.createDataFrame([(1, 7.0, 1.0, 11.0, 2.0), (2, 3.0, 3.0, 9.0, 4.0), (3, 50.0, 50.0, 51.0, 51.0), (4, 20.0, 0.0, 30.0, 5.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    out = {r["id"]: (r["ordinal"], r["overlap"]) for r in max_overlap_join(images, polys, ["id"], "ordinal", base=1.0).collect()}
    assert out[1] == (0, pytest.approx(3.0))
    assert out[2] == (0, pytest.approx(6.0))
    assert out[3] == (None, None) and out[4] == (None, None)


def test_box_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: [(i, rng.randrange(3), (x := rng.uniform(0, 50)), (y := rng.uniform(0, 50)), x + rng.choice([0, 0.5, 6, 30]), y + rng.choice([0, 0.5, 6, 30])) for i in range(n)]
    left, right = make(120), make(90)
    cols = "{0}id int, img int, {0}a double, {0}b double, {0}c double, {0}d double"
    ldf, rdf = (spark.createDataFrame(d, cols.format(p)) for d, p in ((left, "l"), (right, "r")))
    got = [(r["lid"], r["rid"]) for r in box_pairs(ldf, rdf, ["la", "lb", "lc", "ld"], ["ra", "rb", "rc", "rd"], ["img"], 1.0).collect()]
    want = {(p[0], s[0]) for p in left for s in right if p[1] == s[1] and p[2] <= s[4] and p[4] >= s[2] and p[3] <= s[5] and p[5] >= s[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_within_radius(spark):
    gcps = spark.createDataFrame([(0, "a", 0.0, 179.99999), (1, "b", 60.0, 10.0), (2, "c", 60.0, 10.0), (3, "d", 60.0, 10.0001)], "ordinal int, label string, lat double, lon double")
    images = spark.createDataFrame([(1, 0.0, -179.99999), (2, 60.00001, 10.00001), (3, 60.0, 10.00008), (4, 60.1, 10.0), (5, None, 1.0)], "id int, lat double, lon double")
    out = {r["id"]: r["r_label"] for r in nearest_within(images, gcps, 10.0, ["id"], ["ordinal"]).collect()}
    assert out == {1: "a", 2: "b", 3: "d"}
    picked = {r["id"]: (r["gcp_label"], r["gcp_lat"]) for r in select_gcp_images(images, gcps, 10.0, ["id"], ["ordinal"]).collect()}
    assert picked[5] == ("N/A", 0.0) and 4 not in picked
    everything = select_gcp_images(images, gcps.limit(0), 10.0, ["id"], ["ordinal"])
    assert {r["gcp_label"] for r in everything.collect()} == {"N/A"} and everything.count() == 5


def test_borders_need_both_ends(spark):
    metre = 1 / 111_000
    images = spark.createDataFrame([(i, 38.0 + i * metre, -121.0) for i in range(20)], "row int, lat double, lon double")
    at = lambda i, off=0.0: (38.0 + (i + off) * metre, -121.0)
    borders = spark.createDataFrame([(1, *at(2, 0.1), *at(5)), (2, *at(6), *at(9, 0.4))], "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double")
    out = match_borders(borders, images, "row").collect()
    assert [(r["plot_index"], r["start_row"], r["end_row"]) for r in out] == [(1, 2, 5)]


def sequential(centers, polys):
    taken, out = set(), {}
    for idx, _, x, y in sorted(centers, key=lambda c: c[1]):
        for n, plot, acc, (x0, y0, x1, y1) in polys:
            key = f"{plot}_{acc}"
            if x0 < x < x1 and y0 < y < y1 and key not in taken:
                taken.add(key)
                out[idx] = key
                break
    return out


@pytest.mark.parametrize("seed", [6, 7])
def test_association_equals_sequential_choice(spark, seed):
    rng = random.Random(seed)
    polys = [(n, f"p{rng.randrange(8)}", "a", (x := rng.uniform(0, 6), y := rng.uniform(0, 6), x + 5, y + 5)) for n in range(14)]
    centers = [(i, rng.random(), rng.uniform(2, 9), rng.uniform(2, 9)) for i in range(12)]
    pdf = spark.createDataFrame([(n, p, a, box(*b)) for n, p, a, b in polys], POLYS)
    cdf = spark.createDataFrame(centers, "plot_index int, seen double, lon double, lat double")
    got = {r["plot_index"]: r["boundary_key"] for r in associate_plots(cdf, pdf, base=1.0).collect()}
    assert got == sequential(centers, polys)


def test_nearest_pixel_is_clamped(spark):
    rasters = spark.createDataFrame([(1, [100.0, 0.5, 0.0, 50.0, 0.0, -0.5], 4, 4)], "raster_id int, geotransform array<double>, width int, height int")
    px = spark.createDataFrame([(1, r, c, r * 10 + c) for r in range(4) for c in range(4)], "raster_id int, row int, col int, v int")
    places = spark.createDataFrame([(1, 1, 100.6, 49.4), (2, 1, 0.0, 99.0), (3, 1, 500.0, 0.0)], "id int, raster_id int, x double, y double")
    assert {r["id"]: r["v"] for r in nearest_pixel(places, px, rasters).collect()} == {1: 11, 2: 0, 3: 33}


def test_later_intervals_overwrite(spark, collect):
    rows = spark.createDataFrame([(i, -1, None) for i in range(10)], "row int, plot_index int, d string")
    spans = spark.createDataFrame([(1, 5, 1, 11, "up"), (4, 7, 2, 22, None), (1, 5, 0, 99, "x"), (9, 8, 3, 33, "y")], "a int, b int, o int, plot_index int, d string")
    out = assign_intervals(rows, spans, "row", "a", "b", "o", ["plot_index", "d"], base=2)
    assert [r[1] for r in collect(out.select("row", "plot_index"), "row")] == [-1, 11, 11, 11, 22, 22, 22, 22, -1, -1]
    assert [r[1] for r in collect(out.select("row", "d"), "row")][3:6] == ["up", None, None]
    assert interval_join(rows.select("row"), spans.select("a", "b", "o"), "row", "a", "b", 2).count() == 5 + 4 + 5


def test_neighbours_at_the_pole_and_across_the_date_line(spark):
    left = spark.createDataFrame([(1, 89.99, 10.0), (2, 89.999, -170.0), (3, 10.0, 179.99999), (4, -89.99999, 0.0), (5, None, 1.0)],
                                 "id int, lat double, lon double")
    right = spark.createDataFrame([(0, "a", 89.99, 10.09), (1, "b", 89.999, -169.1), (2, "c", 10.0, -179.99999),
                                   (3, "d", -89.99999, 180.0), (4, "e", 0.0, 0.0)], "ordinal int, label string, lat double, lon double")
    out = {r["id"]: r["r_label"] for r in nearest_within(left, right, 2.6, ["id"], ["ordinal"]).collect()}
    assert out == {1: "a", 2: "b", 3: "c", 4: "d"}


def test_a_chain_of_plots_and_a_crowded_key(spark):
    # plot i lies in boundaries i and i + 1 and takes i: whoever comes first is served first
    n = 3000
    offers = [(i, f"k{j}", i + 1, j) for i in range(n) for j in (i, i + 1)]
    offers += [(n + i, "crowd", n + 1 + i, n + 9) for i in range(500)] + [(n + 3, "spare", n + 4, n + 10)]
    # the last plot is seen first and takes the key its neighbour wants, and so on down the chain
    offers = [(p, k, -s if p < n else s, -o if p < n else o) for p, k, s, o in offers]
    df = spark.createDataFrame(offers, "who int, what string, seen int, place int")
    got = {(r["who"], r["what"]) for r in serial_choice(df, "who", "what", ["seen", "who", "place", "what"], ["who"], tile=700).collect()}
    free, want = set(), set()
    turns = {}
    for p, k, s, o in offers:
        turns.setdefault((s, p), []).append((o, k))
    for (_, p), ks in sorted(turns.items()):
        for _, k in sorted(ks):
            if k not in free:
                free.add(k)
                want.add((p, k))
                break
    assert got == want and len(want) > n


@pytest.mark.parametrize("lat", [0.0, 88.0, 89.99, 89.9999999, -89.99])
def test_borders_at_any_latitude(spark, lat):
    metre = 1 / 111_694 if abs(lat) > 80 else 1 / 110_574
    wide = 1 / (111_320 * math.cos(math.radians(lat)))
    images = [(0, lat, 10.0), (1, lat, 10.0 + 5 * wide if 5 * wide < 100 else 170.0)]
    ends = [(1, lat - math.copysign(0.1, lat) * metre, 10.0, lat, images[1][2] + 0.1 * wide if wide < 100 else 170.0),
            (2, lat, 10.0, lat - math.copysign(2, lat) * metre, images[1][2])]
    got = match_borders(spark.createDataFrame(ends, "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double"),
                        spark.createDataFrame(images, "row int, lat double, lon double"), "row").collect()
    assert [(r["plot_index"], r["start_row"], r["end_row"]) for r in got] == [(1, 0, 1)]


def test_an_image_beyond_reach_that_is_nearer_in_degrees_wins(spark):
    # 60 degrees of longitude are centimetres here, and 2e-5 degrees of latitude two metres
    lat = 89.9999999
    images = spark.createDataFrame([(0, lat, 60.0), (1, lat - 2e-5, 0.0)], "row int, lat double, lon double")
    border = [(1, lat, 0.0, lat, 0.0)]
    schema = "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double"
    assert match_borders(spark.createDataFrame(border, schema), images.where("row = 0"), "row").count() == 1
    assert match_borders(spark.createDataFrame(border, schema), images, "row").count() == 0


def test_borders_among_crowded_images(spark):
    # 1,600 images in half a metre, one alone, and ends at all distances from them
    images = [(i, 38.53 + i // 40 * 1e-7, -121.76 + i % 40 * 1.3e-7) for i in range(1600)] + [(1600, 38.531, -121.76)]
    ends = [(k, 38.53 + k % 9 * 0.71e-6 - 1e-6, -121.76 + k % 7 * 1.17e-6 - 1.5e-6, 38.531 + k % 4 * 9e-7, -121.76) for k in range(60)]
    border = "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double"
    out = match_borders(spark.createDataFrame(ends, border), spark.createDataFrame(images, "row int, lat double, lon double"), "row")

    def nearest(lat, lon):
        d, row, i_lat, i_lon = min(((a - lat) ** 2 + (b - lon) ** 2, r, a, b) for r, a, b in images)
        metres = math.hypot((i_lat - lat) * 110_995, (i_lon - lon) * 111_320 * math.cos(math.radians(lat)))
        return row if metres <= 0.25 else None

    want = {k: (nearest(a, b), nearest(c, d)) for k, a, b, c, d in ends}
    want = {k: v for k, v in want.items() if None not in v}
    assert {r["plot_index"]: (r["start_row"], r["end_row"]) for r in out.collect()} == want and len(want) > 5
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # copies on cells must not be broadcast: their number is not in the size estimate
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [_" in line]


def test_copies_on_cells_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 38.53, -121.76)], "id int, lat double, lon double")
    near = _near_pairs(points, points.toDF("r", "r_lat", "r_lon"), 0.25, "lat", "lon", "r_lat", "r_lon")
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 1


def test_crowded_cells_are_dealt_into_slices(spark):
    many = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 7 ELSE id % 5 END AS cell")
    cells = spark.createDataFrame([(7, "a"), (7, "b"), (1, "c"), (9, "d")], "cell long, name string")
    got = _cell_join(many, cells, ["cell"], crowd=100)
    assert got.columns == ["cell", "id", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(cells, "cell").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "strategy=merge" in plan


def test_polygons_on_cells_are_not_broadcast(spark):
    polys = spark.createDataFrame([(0, "p", "a", box(0, 0, 2, 2))], POLYS)
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double")
    boxes = points.selectExpr("id", "lon AS x0", "lat AS y0", "lon + 1 AS x1", "lat + 1 AS y1")
    for out in (pip_join(points, polys, base=1.0),
                box_pairs(boxes, boxes.toDF("r", "a", "b", "c", "d"), ["x0", "y0", "x1", "y1"], ["a", "b", "c", "d"], base=1.0)):
        # only the list of crowded cells may be
        joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
        assert out.count() == 1 and len([j for j in joins if "SortMergeJoin" in j and "_slice" in j]) == 1


@pytest.mark.parametrize("batch, ahead", [(60, 1), (1000, 16)])
def test_queues_equal_sequential_choice(spark, batch, ahead):
    rng = random.Random(11)
    # zones 0 to 5 share what they offer, 6 to 8 don't; some come twice; zone 9 has no list
    turns = [(rng.randrange(150), rng.randrange(10), n) for n in range(200)]
    lists = [(z, w, o) for z in range(6) for o, w in enumerate(rng.sample(range(90), 80))]
    lists += [(z, 100 * z + o, o) for z in range(6, 9) for o in range(9)]
    got = queue_choice(spark.createDataFrame(turns, "who long, zone long, n int"),
                       spark.createDataFrame(lists, "zone long, what long, o int"), ["n"], ["o"], batch, ahead)
    want, served, free = set(), set(), set()
    for who, zone, _ in turns:
        for _, what in sorted((o, w) for z, w, o in lists if z == zone):
            if who not in served and what not in free:
                served.add(who)
                free.add(what)
                want.add((who, zone, what))
    assert {tuple(r) for r in got.select("who", "zone", "what").collect()} == want


def test_plots_and_boundaries_on_top_of_each_other_are_not_listed(spark):
    # 1,500 centres in 4,000 equal boxes are six million pairs, over 700 MB; a list of the boxes stays small
    n, m = 1500, 4000
    centers = spark.range(n).selectExpr("cast(id as int) plot_index", "double(id) seen", "id / 1e4 lon", "0.5 lat")
    polys = spark.range(m).selectExpr(
        "cast(id as int) ordinal", "concat('p', id) plot", "string(null) accession",
        "array(named_struct('x', -1d, 'y', 0d), named_struct('x', 1d, 'y', 0d), named_struct('x', 1d, 'y', 1d), "
        "named_struct('x', -1d, 'y', 1d), named_struct('x', -1d, 'y', 0d)) ring")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("furrow.operators.spatial.cut_lineage", lambda df: (out := cut_lineage(df), seen.append(out.count()))[0])
        got = {r["plot_index"]: r["boundary_key"] for r in associate_plots(centers, polys, base=1.0).collect()}
    assert got == {i: f"p{i}_None" for i in range(n)}
    assert max(seen) <= m


BORDER = "plot_index int, start_lat double, start_lon double, end_lat double, end_lon double"


@pytest.mark.parametrize("few", [False, True])
def test_border_ends_travel_once(spark, monkeypatch, few):
    """Ends go to one tile each, in slices where it is full; among crowded images they are looked up on cells."""
    from furrow.operators import spatial

    if few:
        for name, value in (("TILE_ENDS", 20), ("CROWDED_TILE", 60), ("TABLE_ROWS", 16)):
            monkeypatch.setattr(spatial, name, value)
    # across tiles, a level and a line of equal distances; 100 images stand close together
    rng = random.Random(8)
    spot = lambda wide: (38.53 + rng.randrange(40) * wide, -121.76 + rng.randrange(40) * wide)
    images = [(i, *spot(1e-6)) for i in range(300)] + [(300 + i, *spot(1e-8)) for i in range(100)] + [(400, None, 1.0), (401, math.nan, 1.0)]
    borders = [(k, *spot(1.1e-6), *spot(1e-6 / 2)) for k in range(200)] + [(k, *spot(1e-6), *spot(1e-6)) for k in range(3)]
    borders += [(None, *spot(1e-6), *spot(1e-6)), (900, math.nan, 1.0, None, 1.0)]
    out = match_borders(spark.createDataFrame(borders, BORDER), spark.createDataFrame(images, "row int, lat double, lon double"), "row", 0.12)

    def nearest(lat, lon):
        d, row, i_lat, i_lon = min(((a - lat) ** 2 + (b - lon) ** 2, r, a, b) for r, a, b in images[:400])
        metres = math.hypot((i_lat - lat) * 110_995, (i_lon - lon) * 111_320 * math.cos(math.radians(lat)))
        return row if metres <= 0.12 else None

    want = {}
    for k, *place in borders[:203]:
        for side, row in enumerate((nearest(*place[:2]), nearest(*place[2:]))):
            want.setdefault(k, [-1, -1])[side] = max(want.get(k, [-1, -1])[side], -1 if row is None else row)
    want = {k: tuple(v) for k, v in want.items() if -1 not in v}
    got = [(r["plot_index"], (r["start_row"], r["end_row"])) for r in out.collect()]
    assert dict(got) == want and len(want) > 20 and len(got) == sum(b[0] in want for b in borders)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and ("SortMergeJoin [_level" in plan) == few


def test_borders_across_the_date_line(spark):
    border = spark.createDataFrame([(1, 0.0, 179.9999999, 0.0, -179.9999999)], BORDER)
    images = spark.createDataFrame([(0, 0.0, -179.9999995), (1, 0.0, -179.9)], "row int, lat double, lon double")
    # nearest in degrees, as stored: the first image unless another is stored closer
    assert [(r["start_row"], r["end_row"]) for r in match_borders(border, images.where("row = 0"), "row").collect()] == [(0, 0)]
    assert match_borders(border, images, "row").count() == 0


@pytest.mark.parametrize("kind", ["plane", "lattice", "line", "heap"])
def test_nearest_of_many_places(kind):
    import numpy as np

    from furrow.plans.nearest import Tree

    rng = np.random.default_rng(5)
    for n in (1, 8, 9, 700):
        x, y, px, py = rng.random(n), rng.random(n), rng.random(500) * 1.4 - 0.2, rng.random(500) * 1.4 - 0.2
        if kind == "lattice":
            x, y, px, py = (np.round(v * 8) for v in (x, y, px, py))
        elif kind == "line":
            y[:] = 0.3
        elif kind == "heap":
            x, y = x**9, y**9
        d = (x[None] - px[:, None]) ** 2 + (y[None] - py[:, None]) ** 2
        assert (Tree(x, y).nearest(px, py, np.full(500, 0.05)) == np.where(d.min(1) <= 0.05, d.argmin(1), -1)).all()
