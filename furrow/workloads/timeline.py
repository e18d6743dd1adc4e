"""Time joins on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.timejoin import (
    asof_nearest, interp_join, mean_period, sync_streams, update_from_nearest)
from furrow.workloads import Workload
from furrow.workloads.tables import DAY, HOUR, TRACK_SQL, track

work = Workload()


def kind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return track(spark, sf_dir).where(F.col("event_type") == name)


# nearest earlier-or-later row of type {right} for each row of type {left}, per user
_NEAREST = """
n AS (
  SELECT l.event_id,
         arg_min(r.event_id, (abs(r.stamp - l.stamp), r.stamp, r.event_id)) AS r_event_id,
         arg_min(r.value, (abs(r.stamp - l.stamp), r.stamp, r.event_id)) AS r_value,
         arg_min(r.stamp - l.stamp, (abs(r.stamp - l.stamp), r.stamp, r.event_id)) AS r_gap
  FROM track l JOIN track r ON l.user_id = r.user_id
  WHERE l.event_type = '{left}' AND r.event_type = '{right}'
  GROUP BY l.event_id
)"""


@work.query("asof_nearest_within_tolerance", f"""
WITH {TRACK_SQL}, {_NEAREST.format(left='view', right='click')}
SELECT l.event_id, l.user_id, coalesce(n.r_event_id, -1) AS matched_id,
       n.r_value AS matched_value, CAST(n.r_gap AS DOUBLE) AS gap
FROM track l LEFT JOIN n ON l.event_id = n.event_id AND abs(n.r_gap) <= {12 * HOUR}
WHERE l.event_type = 'view'
""")
def asof_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "user_id", "stamp", "value"]
    out = asof_nearest(
        kind(spark, sf_dir, "view").select(*cols), kind(spark, sf_dir, "click").select(*cols),
        "stamp", ["user_id"], tolerance=12 * HOUR, order=["event_id"])
    return out.select(
        "event_id", "user_id", F.coalesce("r_event_id", F.lit(-1)).alias("matched_id"),
        F.col("r_value").alias("matched_value"), F.col("r_gap").cast("double").alias("gap"))


@work.query("asof_nearest_unbounded", f"""
WITH {TRACK_SQL}, {_NEAREST.format(left='purchase', right='view')}
SELECT l.event_id, coalesce(n.r_event_id, -1) AS matched_id, CAST(n.r_gap AS DOUBLE) AS gap
FROM track l LEFT JOIN n ON l.event_id = n.event_id
WHERE l.event_type = 'purchase'
""")
def asof_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "user_id", "stamp"]
    out = asof_nearest(
        kind(spark, sf_dir, "purchase").select(*cols), kind(spark, sf_dir, "view").select(*cols),
        "stamp", ["user_id"], order=["event_id"])
    return out.select("event_id", F.coalesce("r_event_id", F.lit(-1)).alias("matched_id"),
                      F.col("r_gap").cast("double").alias("gap"))


@work.query("asof_nearest_without_key", f"""
WITH {TRACK_SQL}, pairs AS (
  SELECT l.event_id, l.stamp AS t0, p.event_id AS p_id, p.stamp AS p_at, q.event_id AS q_id, q.stamp AS q_at
  FROM (SELECT * FROM track WHERE event_type = 'error') l
  ASOF LEFT JOIN (SELECT min(event_id) AS event_id, stamp FROM track WHERE event_type = 'signup' GROUP BY stamp) p
    ON l.stamp >= p.stamp
  ASOF LEFT JOIN (SELECT min(event_id) AS event_id, stamp FROM track WHERE event_type = 'signup' GROUP BY stamp) q
    ON l.stamp <= q.stamp
), near AS (
  SELECT event_id, CASE WHEN q_at IS NULL OR t0 - p_at <= q_at - t0 THEN p_id ELSE q_id END AS m_id,
         CASE WHEN q_at IS NULL OR t0 - p_at <= q_at - t0 THEN p_at - t0 ELSE q_at - t0 END AS gap
  FROM pairs
)
SELECT event_id, CASE WHEN abs(gap) <= {HOUR} THEN m_id ELSE -1 END AS matched_id FROM near
""")
def asof_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "stamp"]
    out = asof_nearest(
        kind(spark, sf_dir, "error").select(*cols), kind(spark, sf_dir, "signup").select(*cols),
        "stamp", tolerance=HOUR, order=["event_id"])
    return out.select("event_id", F.coalesce("r_event_id", F.lit(-1)).alias("matched_id"))


@work.query("update_position_from_nearest", f"""
WITH {TRACK_SQL}, {_NEAREST.format(left='click', right='signup')},
m AS (
  SELECT l.event_id, l.lat, l.lon, l.value,
         CASE WHEN abs(n.r_gap) <= {DAY} THEN n.r_event_id END AS r_id
  FROM track l LEFT JOIN n USING (event_id) WHERE l.event_type = 'click'
)
SELECT m.event_id,
       round(coalesce(CASE WHEN r.value >= 50 THEN r.lat END, m.lat), 8) AS lat,
       round(coalesce(r.lon, m.lon), 8) AS lon,
       coalesce(r.value, m.value) AS alt
FROM m LEFT JOIN track r ON r.event_id = m.r_id
""")
def update_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = kind(spark, sf_dir, "click").select(
        "event_id", "user_id", "stamp", "lat", "lon", F.col("value").alias("alt"))
    drone = kind(spark, sf_dir, "signup").select(
        "event_id", "user_id", "stamp", F.when(F.col("value") >= 50, F.col("lat")).alias("lat"),
        "lon", F.lit(None).cast("double").alias("alt"), F.col("value").alias("altitude"))
    out = update_from_nearest(images, drone, "stamp", ["user_id"], DAY, order=["event_id"])
    return out.select("event_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "alt")


@work.query("interpolate_onto_stamps", f"""
WITH {TRACK_SQL}, s AS (
  SELECT user_id, stamp, arg_min(value, event_id) AS v FROM track WHERE event_type = 'click' GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stamp) AS k,
         count(*) OVER (PARTITION BY user_id) AS n FROM s
), spot AS (
  SELECT l.event_id, l.user_id, l.stamp,
         count(o.k) AS below, max(o2.n) AS n
  FROM track l LEFT JOIN o ON o.user_id = l.user_id AND o.stamp < l.stamp
  LEFT JOIN (SELECT DISTINCT user_id, n FROM o) o2 ON o2.user_id = l.user_id
  WHERE l.event_type = 'view' GROUP BY ALL
), idx AS (SELECT *, greatest(1, least(below, n - 1)) AS lo FROM spot)
SELECT idx.event_id,
       round((b.v - a.v) / (b.stamp - a.stamp) * (idx.stamp - a.stamp) + a.v, 6) AS value
FROM idx LEFT JOIN o a ON a.user_id = idx.user_id AND a.k = idx.lo AND idx.n > 1
         LEFT JOIN o b ON b.user_id = idx.user_id AND b.k = idx.lo + 1 AND idx.n > 1
""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = kind(spark, sf_dir, "view").select("event_id", "user_id", "stamp")
    gps = kind(spark, sf_dir, "click").select("event_id", "user_id", "stamp", "value")
    out = interp_join(images, gps, "stamp", ["value"], ["user_id"], order=["event_id"])
    return out.select("event_id", F.round("value", 6).alias("value"))


_SYNC = f"""
WITH {TRACK_SQL},
c AS ({{c}}), p AS ({{p}}),
per AS (
  SELECT user_id, (max(stamp) - min(stamp)) / (count(*) - 1) AS period
  FROM track WHERE event_type = 'view' GROUP BY user_id HAVING count(*) > 1
)
SELECT c.event_id, c.r_event_id AS click_id, p.r_event_id AS purchase_id
FROM c JOIN p USING (event_id) JOIN track t USING (event_id) {{bound}}
"""
_VIEW_CLICK = _NEAREST.format(left="view", right="click").split("n AS (", 1)[1].rsplit(")", 1)[0]
_VIEW_PURCHASE = _NEAREST.format(left="view", right="purchase").split("n AS (", 1)[1].rsplit(")", 1)[0]


@work.query("sync_streams_mean_period", _SYNC.format(
    c=_VIEW_CLICK, p=_VIEW_PURCHASE,
    bound="JOIN per ON per.user_id = t.user_id AND abs(c.r_gap) <= period AND abs(p.r_gap) <= period"))
def sync_mean_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "user_id", "stamp"]
    out = sync_streams(
        [kind(spark, sf_dir, k).select(*cols) for k in ("view", "click", "purchase")],
        "stamp", ["user_id"], "mean_period", orders=[["event_id"], ["event_id"]])
    return out.select("event_id", F.col("s1_event_id").alias("click_id"),
                      F.col("s2_event_id").alias("purchase_id"))


@work.query("sync_streams_unbounded", _SYNC.format(c=_VIEW_CLICK, p=_VIEW_PURCHASE, bound=""))
def sync_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "user_id", "stamp"]
    out = sync_streams(
        [kind(spark, sf_dir, k).select(*cols) for k in ("view", "click", "purchase")],
        "stamp", ["user_id"], None, orders=[["event_id"], ["event_id"]])
    return out.select("event_id", F.col("s1_event_id").alias("click_id"),
                      F.col("s2_event_id").alias("purchase_id"))


@work.query("mean_stream_period", f"""
WITH {TRACK_SQL}
SELECT user_id, round((max(stamp) - min(stamp)) / nullif(count(*) - 1, 0), 3) AS period
FROM track GROUP BY user_id
""")
def stream_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_period(track(spark, sf_dir), "stamp", ["user_id"]).select(
        "user_id", F.round("period", 3).alias("period"))
