"""The supplied tables, and the field-data views of them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.clock import to_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as positioned, stamped images: one track per user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        to_micros(F.col("ts")).alias("stamp"),
        (F.lit(-121.76) + (F.col("user_id") % 50) * 1e-5 + (F.col("event_id") % 97) * 1e-6).alias("lon"),
        (F.lit(38.53) + F.col("value") * 1e-6).alias("lat"),
    )


# the same view in SQL
TRACK_SQL = """
track AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS stamp,
         CAST(-121.76 AS DOUBLE) + (user_id % 50) * CAST(1e-5 AS DOUBLE)
           + (event_id % 97) * CAST(1e-6 AS DOUBLE) AS lon,
         CAST(38.53 AS DOUBLE) + value * CAST(1e-6 AS DOUBLE) AS lat
  FROM events
)"""

HOUR = 3_600_000_000
DAY = 24 * HOUR


# the projection in SQL: the published series of the transverse Mercator plane in powers of n
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_SCALE = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
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


def _number(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def utm_sql(name: str, source: str, lon: str = "lon", lat: str = "lat", meridian: int = -123) -> str:
    """CTEs up to ``name``: the rows of ``source`` with ``x``, ``y`` in a northern zone."""
    number = _number
    c = number(2 * _N**0.5 / (1 + _N))
    terms = lambda outer, inner: " + ".join(
        f"{number(a)} * {outer}({2 * j} * xi_) * {inner}({2 * j} * eta_)" for j, a in enumerate(_FORWARD, 1))
    return f"""
{name}_1 AS (SELECT *, radians({lat}) AS phi_, radians({lon} - ({meridian})) AS lam_ FROM {source}),
{name}_2 AS (SELECT *, sinh(atanh(sin(phi_)) - {c} * atanh({c} * sin(phi_))) AS t_ FROM {name}_1),
{name}_3 AS (SELECT *, atan2(t_, cos(lam_)) AS xi_, atanh(sin(lam_) / sqrt(1 + t_ * t_)) AS eta_ FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE (phi_, lam_, t_, xi_, eta_),
         500000 + {number(_SCALE)} * (eta_ + {terms('cos', 'sinh')}) AS x,
         {number(_SCALE)} * (xi_ + {terms('sin', 'cosh')}) AS y
  FROM {name}_3
)"""


def degrees_sql(name: str, source: str, x: str = "x", y: str = "y", meridian: int = -123) -> str:
    """CTEs up to ``name``: the rows of ``source`` with ``lon``, ``lat`` of a northern zone's position."""
    terms = lambda outer, inner: " + ".join(
        f"{_number(b)} * {outer}({2 * j} * xi_) * {inner}({2 * j} * eta_)" for j, b in enumerate(_INVERSE, 1))
    climb = " + ".join(f"{_number(d)} * sin({2 * j} * chi_)" for j, d in enumerate(_LATITUDE, 1))
    return f"""
{name}_1 AS (SELECT *, {y} / {_number(_SCALE)} AS xi_, ({x} - 500000) / {_number(_SCALE)} AS eta_ FROM {source}),
{name}_2 AS (
  SELECT *, xi_ - ({terms('sin', 'cosh')}) AS xo_, eta_ - ({terms('cos', 'sinh')}) AS eo_ FROM {name}_1
),
{name}_3 AS (SELECT *, asin(sin(xo_) / cosh(eo_)) AS chi_ FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE (xi_, eta_, xo_, eo_, chi_), degrees(atan2(sinh(eo_), cos(xo_))) + ({meridian}) AS lon,
         degrees(chi_ + {climb}) AS lat
  FROM {name}_3
)"""
