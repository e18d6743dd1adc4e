"""Earth geometry as column expressions: zones, projections, distances, windows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM scale and offsets.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the transverse Mercator series in the third flattening.
_FORWARD = [
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
]
_INVERSE = [
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
]
_LATITUDE = [
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4,
    56 / 15 * _N**3 - 136 / 35 * _N**4,
    4279 / 630 * _N**4,
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def heading_direction(radians: Column) -> Column:
    """Compass quarter of a heading; each quarter includes its upper bound."""
    deg = F.pmod(F.degrees(radians), F.lit(360.0))
    return F.when(F.isnan(radians), None).when((deg > 315) | (deg <= 45), "North").when(
        deg <= 135, "East").when(deg <= 225, "South").when(deg <= 315, "West")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone a coordinate lies in."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat < 0, 32700 + zone).otherwise(32600 + zone)


def _central_meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def to_utm(lon: Column, lat: Column, epsg: Column | None = None) -> Column:
    """WGS84 degrees to ``struct<x, y>`` metres in the UTM zone (derived unless given)."""
    epsg = utm_epsg(lon, lat) if epsg is None else epsg
    phi, lam = F.radians(lat), F.radians(lon) - _central_meridian(epsg)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, FALSE_NORTHING).otherwise(0.0)
    return F.struct(
        (FALSE_EASTING + UTM_SCALE * _RADIUS * east).alias("x"),
        (south + UTM_SCALE * _RADIUS * north).alias("y"),
    )


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """UTM metres to ``struct<lon, lat>`` degrees."""
    south = F.when(epsg >= 32700, FALSE_NORTHING).otherwise(0.0)
    xi = (y - south) / (UTM_SCALE * _RADIUS)
    eta = (x - FALSE_EASTING) / (UTM_SCALE * _RADIUS)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_INVERSE, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = _central_meridian(epsg) + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.struct(F.degrees(lam).alias("lon"), F.degrees(phi).alias("lat"))


def to_web_mercator(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to ``struct<x, y>`` spherical Mercator metres."""
    return F.struct(
        (SEMI_MAJOR * F.radians(lon)).alias("x"),
        (SEMI_MAJOR * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"),
    )


def from_web_mercator(x: Column, y: Column) -> Column:
    """Spherical Mercator metres to ``struct<lon, lat>`` degrees."""
    return F.struct(
        F.degrees(x / SEMI_MAJOR).alias("lon"),
        F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2).alias("lat"),
    )


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 8) -> Column:
    """Ellipsoidal distance in metres by Vincenty's inverse formula.

    A fixed number of rounds, evaluated in the JVM.  Each round shrinks the error
    by the flattening, so eight settle every pair not close to
    antipodal; a few metres apart, four do.
    """
    f, b = FLATTENING, SEMI_MINOR
    u1 = F.atan((1 - f) * F.tan(F.radians(lat1)))
    u2 = F.atan((1 - f) * F.tan(F.radians(lat2)))
    base = F.struct(
        F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"),
        (F.radians(lon2) - F.radians(lon1)).alias("L"))

    def sphere(k: Column, lam: Column) -> Column:
        across = k["c2"] * F.sin(lam)
        along = k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
        return F.struct(
            F.sqrt(across * across + along * along).alias("ss"),
            (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)).alias("cs"),
            (k["c1"] * k["c2"] * F.sin(lam)).alias("up"))

    def azimuth(k: Column, s: Column) -> Column:
        sin_a = F.when(s["ss"] == 0, 0.0).otherwise(s["up"] / s["ss"])
        return let(sin_a, lambda sa: let(1 - sa * sa, lambda c2: F.struct(
            sa.alias("sa"), c2.alias("ca2"), s["ss"].alias("ss"), s["cs"].alias("cs"),
            F.atan2(s["ss"], s["cs"]).alias("sig"),
            F.when(c2 == 0, 0.0).otherwise(s["cs"] - 2 * k["s1"] * k["s2"] / c2).alias("cm"))))

    def step(k: Column, lam: Column) -> Column:
        return let(sphere(k, lam), lambda s: let(azimuth(k, s), lambda q: let(
            f / 16 * q["ca2"] * (4 + f * (4 - 3 * q["ca2"])),
            lambda c: k["L"] + (1 - c) * f * q["sa"] * (
                q["sig"] + c * q["ss"] * (q["cm"] + c * q["cs"] * (-1 + 2 * q["cm"] * q["cm"]))))))

    def length(k: Column, lam: Column) -> Column:
        ratio = (SEMI_MAJOR**2 - b**2) / b**2
        return let(sphere(k, lam), lambda s: let(azimuth(k, s), lambda q: let(
            F.struct(
                (1 + q["ca2"] * ratio / 16384 * (4096 + q["ca2"] * ratio * (
                    -768 + q["ca2"] * ratio * (320 - 175 * q["ca2"] * ratio)))).alias("a"),
                (q["ca2"] * ratio / 1024 * (256 + q["ca2"] * ratio * (
                    -128 + q["ca2"] * ratio * (74 - 47 * q["ca2"] * ratio)))).alias("b")),
            lambda w: b * w["a"] * (q["sig"] - w["b"] * q["ss"] * (
                q["cm"] + w["b"] / 4 * (
                    q["cs"] * (-1 + 2 * q["cm"] * q["cm"])
                    - w["b"] / 6 * q["cm"] * (-3 + 4 * q["ss"] * q["ss"])
                    * (-3 + 4 * q["cm"] * q["cm"])))))))

    return let(base, lambda k: let(
        F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["L"], lambda lam, _: step(k, lam)),
        lambda lam: length(k, lam)))


def local_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Ellipsoidal distance of close points by the radii of curvature between them.

    Plain arithmetic, so it stays in generated code.  Off by the square of the
    distance over the earth radius: micrometres at a hundred metres.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    mid = F.radians((lat1 + lat2) / 2)
    bend = 1 - e2 * F.sin(mid) * F.sin(mid)
    across = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180) * F.cos(mid) * SEMI_MAJOR / F.sqrt(bend)
    along = F.radians(lat2 - lat1) * SEMI_MAJOR * (1 - e2) / (bend * F.sqrt(bend))
    return F.sqrt(across * across + along * along)


def pixel_to_world(col: Column, row: Column, gt: Column) -> Column:
    """Pixel to world ``struct<x, y>`` by a six-value geotransform."""
    g = lambda i: F.get(gt, F.lit(i))
    return F.struct(
        (g(0) + col * g(1) + row * g(2)).alias("x"),
        (g(3) + col * g(4) + row * g(5)).alias("y"),
    )


def world_to_pixel(x: Column, y: Column, gt: Column) -> Column:
    """World to fractional pixel ``struct<col, row>``; rotation included."""
    g = lambda i: F.get(gt, F.lit(i))
    det = g(1) * g(5) - g(2) * g(4)
    dx, dy = x - g(0), y - g(3)
    return F.struct(
        ((dx * g(5) - dy * g(2)) / det).alias("col"),
        ((dy * g(1) - dx * g(4)) / det).alias("row"),
    )


def world_window(
    x: Column, y: Column, w: Column, h: Column, gt: Column, cols: Column, rows: Column
) -> Column:
    """Pixel window of a world box with its top-left corner at (x, y).

    Indices truncate towards zero and clamp to the raster; ``valid`` is false
    where the window comes out inverted.
    """
    g = lambda i: F.get(gt, F.lit(i))
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(v.cast("int"), n - 1))
    col1, row1 = clamp((x - g(0)) / g(1), cols), clamp((y - g(3)) / g(5), rows)
    col2, row2 = clamp((x + w - g(0)) / g(1), cols), clamp((y - h - g(3)) / g(5), rows)
    return F.struct(
        col1.alias("col1"), row1.alias("row1"), col2.alias("col2"), row2.alias("row2"),
        ((col1 <= col2) & (row1 <= row2)).alias("valid"),
    )


def line_to_quad(
    start_lon: Column, start_lat: Column, end_lon: Column, end_lat: Column, buffer: float = 1e-5
) -> Column:
    """Closed ring around a start/end line, shifted by ``buffer`` degrees both ways."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    first = point(start_lon - buffer, start_lat - buffer)
    return F.array(
        first,
        point(start_lon + buffer, start_lat + buffer),
        point(end_lon + buffer, end_lat + buffer),
        point(end_lon - buffer, end_lat - buffer),
        first,
    )


def gsd_from_intrinsics(cameras: Column, height: Column, width_px: Column, height_px: Column) -> Column:
    """Ground sample distance of the camera whose width or height matches, else the first."""
    fits = lambda c: (c["width"] == width_px) | (c["height"] == height_px)
    camera = F.coalesce(F.get(F.filter(cameras, fits), F.lit(0)), F.get(cameras, F.lit(0)))
    focal = lambda i: F.get(camera["intrinsicMatrix"], F.lit(i))
    return (height / focal(0) + height / focal(4)) / 2.0


# Fixed value: focal lengths of the camera matrix that stands for a missing one.
DEFAULT_FOCAL = 1000.0


def gsd_from_matrix(matrix: Column, height: Column) -> Column:
    """Ground sample distance from a single 3 x 3 camera matrix, in rows; the default one if null.

    Null where the matrix has no focal lengths, or they are zero.
    """
    focal = lambda i: F.when(matrix.isNull(), F.lit(DEFAULT_FOCAL)).otherwise(
        F.get(F.get(matrix, F.lit(i)), F.lit(i)))
    share = lambda i: F.when(focal(i) != 0, height / focal(i))
    return (share(0) + share(1)) / 2.0


def rotated_affine(
    u_min: Column, v_max: Column, theta: Column, px: Column, py: Column, cx: Column, cy: Column
) -> Column:
    """Six affine terms of an image laid along a track heading.

    The rotation is turned by half a circle, as the reference results are.
    """
    cos, sin = F.cos(theta + math.pi), F.sin(theta + math.pi)
    return F.struct(
        (px * cos).alias("a"), (py * sin).alias("b"),
        (cx + u_min * cos - v_max * sin).alias("c"),
        (px * sin).alias("d"), (-py * cos).alias("e"),
        (cy + u_min * sin + v_max * cos).alias("f"),
    )


# --- rings: array<struct<x: double, y: double>>, first point repeated at the end


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring as ``array<struct<px, py, qx, qy>>``."""
    follow = F.slice(ring, 2, F.size(ring) - 1)
    return F.transform(follow, lambda q, i: F.struct(
        F.get(ring, i)["x"].alias("px"), F.get(ring, i)["y"].alias("py"),
        q["x"].alias("qx"), q["y"].alias("qy")))


def ring_bounds(ring: Column) -> Column:
    """``struct<x0, y0, x1, y1>`` of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, positive when it runs counter-clockwise."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (
        (e["px"] - x0) * (e["qy"] - y0) - (e["qx"] - x0) * (e["py"] - y0))) / 2


def oriented(ring: Column, outer: Column) -> Column:
    """The ring counter-clockwise if ``outer``, else clockwise."""
    return F.when((signed_area(ring) < 0) == outer, F.reverse(ring)).otherwise(ring)


def rings_edges(rings: Column) -> Column:
    """Edges of all rings of a shape: outer rings counter-clockwise, holes clockwise.

    With these, ``point_inside`` counts crossings over all rings, so a point in a
    hole is outside, and ``overlap_area`` takes the holes off.
    """
    return F.flatten(F.transform(rings, ring_edges))


def rings_bounds(rings: Column) -> Column:
    """``struct<x0, y0, x1, y1>`` of all rings."""
    return ring_bounds(F.flatten(rings))


def shape_parts(rings: Column) -> Column:
    """Rings of a shape by part: an outer ring and the holes that follow it."""
    empty = F.slice(F.array(rings), 1, 0)

    def add(parts: Column, ring: Column) -> Column:
        last = F.element_at(parts, -1)
        grown = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, F.array(ring))))
        return F.when((signed_area(ring) < 0) & (F.size(parts) > 0), grown).otherwise(
            F.concat(parts, F.array(F.array(ring))))

    return F.aggregate(rings, empty, add)


def point_inside(x: Column, y: Column, edges: Column) -> Column:
    """True strictly inside the ring with these edges: points on an edge are outside.

    One pass: an edge counts 1 when a ray to the right crosses it (its y span is
    half-open) and sets a bit beyond any number of edges when the point lies on it.
    """
    on_edge = F.lit(1 << 40)

    def weight(total: Column, e: Column) -> Column:
        cross = (e["qx"] - e["px"]) * (y - e["py"]) - (e["qy"] - e["py"]) * (x - e["px"])
        touches = (cross == 0) & x.between(F.least(e["px"], e["qx"]), F.greatest(e["px"], e["qx"])) & (
            y.between(F.least(e["py"], e["qy"]), F.greatest(e["py"], e["qy"])))
        crosses = ((e["py"] > y) != (e["qy"] > y)) & ((cross > 0) == (e["qy"] > e["py"]))
        return F.when(crosses & (cross != 0), total + 1).when(
            crosses | touches, total.bitwiseOR(on_edge)).otherwise(total)

    total = F.aggregate(edges, F.lit(0).cast("long"), weight)
    return F.when(total < on_edge, total % 2 == 1).otherwise(False)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """True strictly inside a closed ring."""
    return point_inside(x, y, ring_edges(ring))


def ring_area(ring: Column) -> Column:
    """Unsigned area by the shoelace sum, taken relative to the first point."""
    return F.abs(signed_area(ring))


def overlap_area(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area that the ring with these edges shares with an axis-aligned box.

    The signed sum over edges of the area between the box floor and the edge,
    with the edge held inside the box; no clipped polygon is built.
    """
    width, height = x1 - x0, y1 - y0
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    # integral of the held height over the height itself
    area_to = lambda v: clamp(v, height) * v - clamp(v, height) * clamp(v, height) / 2

    def strip(e: Column) -> Column:
        px, py, qx, qy = e["px"] - x0, e["py"] - y0, e["qx"] - x0, e["qy"] - y0
        ends = F.struct(clamp(px, width).alias("a"), clamp(qx, width).alias("b"),
                        F.when(qx == px, 0.0).otherwise((qy - py) / (qx - px)).alias("m"))
        return let(ends, lambda s: let(
            F.struct((py + s["m"] * (s["a"] - px)).alias("u"), (py + s["m"] * (s["b"] - px)).alias("v")),
            lambda h: (s["b"] - s["a"]) * F.when(
                F.abs(h["v"] - h["u"]) <= height * 1e-9, clamp((h["u"] + h["v"]) / 2, height)
            ).otherwise((area_to(h["v"]) - area_to(h["u"])) / (h["v"] - h["u"]))))

    return F.abs(F.aggregate(edges, F.lit(0.0), lambda total, e: total + strip(e)))
