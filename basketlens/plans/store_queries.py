"""Feature-store queries: point-in-time joins, latest rows, upsert, online read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as ao
from ..operators import features as ft
from ..operators.io import labelled_interactions, upsert_latest
from .registry import query

DAILY_SQL = """
SELECT {key}, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS event_timestamp,
       count(*) FILTER (WHERE action = 'click') AS {p}clicks,
       count(*) FILTER (WHERE action = 'purchase') AS {p}purchases
FROM behaviors GROUP BY ALL"""
USER_DAILY = DAILY_SQL.format(key="user_id", p="u_")
ITEM_DAILY = DAILY_SQL.format(key="item_id", p="i_")


def _views(fx, b=None):
    b = fx.behaviors if b is None else b
    return [ao.FeatureView("user_daily", ft.daily_stats(b, "user_id", "u_"), ["user_id"],
                           ["u_clicks", "u_purchases"], ttl_seconds=30 * 86400),
            ao.FeatureView("item_daily", ft.daily_stats(b, "item_id", "i_"), ["item_id"],
                           ["i_clicks", "i_purchases"], ttl_seconds=7 * 86400)]


@query("training_entities", views=("behaviors",), oracle="""
SELECT event_id, user_id, item_id, ts AS event_timestamp,
       CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS label FROM behaviors""")
def training_entities(fx):
    """Labelled training entities (label = purchase)."""
    return labelled_interactions(fx.behaviors)


@query("pit_features", views=("behaviors",), oracle=f"""
WITH e AS (SELECT event_id, user_id, item_id, ts AS event_timestamp,
                  CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS label FROM behaviors),
ud AS ({USER_DAILY}), idl AS ({ITEM_DAILY})
SELECT e.*,
  CASE WHEN ud.event_timestamp > e.event_timestamp - INTERVAL 30 DAY THEN ud.u_clicks END AS u_clicks,
  CASE WHEN ud.event_timestamp > e.event_timestamp - INTERVAL 30 DAY THEN ud.u_purchases END AS u_purchases,
  CASE WHEN idl.event_timestamp > e.event_timestamp - INTERVAL 7 DAY THEN idl.i_clicks END AS i_clicks,
  CASE WHEN idl.event_timestamp > e.event_timestamp - INTERVAL 7 DAY THEN idl.i_purchases END AS i_purchases
FROM e ASOF LEFT JOIN ud ON e.user_id = ud.user_id AND e.event_timestamp >= ud.event_timestamp
       ASOF LEFT JOIN idl ON e.item_id = idl.item_id AND e.event_timestamp >= idl.event_timestamp""")
def pit_features(fx):
    """Point-in-time user (TTL 30 d) and item (TTL 7 d) daily features."""
    return ao.historical_features(labelled_interactions(fx.behaviors), _views(fx))


@query("pit_clicks", views=("behaviors",), oracle="""
WITH p AS (SELECT event_id, user_id, ts FROM behaviors WHERE action = 'purchase'),
c AS (SELECT user_id, ts AS click_ts, item_id AS click_item FROM behaviors WHERE action = 'click')
SELECT p.event_id, p.user_id, p.ts,
       CASE WHEN c.click_ts > p.ts - INTERVAL 3 DAY THEN c.click_item END AS click_item,
       CASE WHEN c.click_ts > p.ts - INTERVAL 3 DAY THEN c.click_ts END AS feature_ts
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.click_ts""")
def pit_clicks(fx):
    """J6 kernel: each purchase gets the user's latest click within 3 days."""
    b = fx.behaviors
    p = b.where(F.col("action") == "purchase").select("event_id", "user_id", "ts")
    c = b.where(F.col("action") == "click").select("user_id", F.col("ts").alias("click_ts"),
                                                   F.col("item_id").alias("click_item"))
    out = ao.asof_join(p, c, ["user_id"], "ts", "click_ts", ["click_item"], ttl_seconds=3 * 86400)
    return out.withColumnRenamed("click_ts", "feature_ts").select(
        "event_id", "user_id", "ts", "click_item", F.col("feature_ts"))


@query("latest_features", views=("behaviors",), oracle=f"""
SELECT user_id, event_timestamp, u_clicks, u_purchases FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS r FROM ({USER_DAILY}))
WHERE r = 1""")
def latest_features(fx):
    """Newest daily feature row per user."""
    return ao.latest_rows(ft.daily_stats(fx.behaviors, "user_id", "u_"), ["user_id"], "event_timestamp")


@query("materialize_latest", views=("behaviors", "as_of_t"), oracle=f"""
SELECT user_id, event_timestamp, u_clicks, u_purchases FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS r FROM ({USER_DAILY})
  WHERE event_timestamp > (SELECT as_of FROM as_of_t) - INTERVAL 7 DAY
    AND event_timestamp <= (SELECT as_of FROM as_of_t) + INTERVAL 1 DAY)
WHERE r = 1""")
def materialize_latest(fx):
    """Latest row per user with event time in (as_of - 7 d, as_of + 1 d]
    (the day-end stamp of the as-of day is included)."""
    d = ft.daily_stats(fx.behaviors, "user_id", "u_")
    return ao.latest_rows(d, ["user_id"], "event_timestamp", start=fx.as_of - F.expr("INTERVAL 7 DAYS"),
                          end=fx.as_of + F.expr("INTERVAL 1 DAY"))


UPSERT_BASE = """
SELECT user_id, count(*) FILTER (WHERE action = 'click') AS total_clicks,
       count(*) FILTER (WHERE action = 'purchase') AS total_purchases,
       count(DISTINCT item_id) AS unique_items_viewed, max(ts) AS updated_at
FROM behaviors WHERE ts < (SELECT as_of FROM as_of_t) - INTERVAL 15 DAY GROUP BY user_id"""
UPSERT_UPD = """
SELECT user_id, count(*) FILTER (WHERE action = 'click') AS total_clicks,
       count(*) FILTER (WHERE action = 'purchase') AS total_purchases, max(ts) AS updated_at
FROM behaviors WHERE ts >= (SELECT as_of FROM as_of_t) - INTERVAL 15 DAY GROUP BY user_id"""


@query("upsert_features", views=("behaviors", "as_of_t"), oracle=f"""
SELECT coalesce(b.user_id, u.user_id) AS user_id,
       CASE WHEN u.updated_at IS NOT NULL AND (b.updated_at IS NULL OR u.updated_at >= b.updated_at)
            THEN coalesce(u.total_clicks, b.total_clicks) ELSE b.total_clicks END AS total_clicks,
       CASE WHEN u.updated_at IS NOT NULL AND (b.updated_at IS NULL OR u.updated_at >= b.updated_at)
            THEN coalesce(u.total_purchases, b.total_purchases) ELSE b.total_purchases END AS total_purchases,
       b.unique_items_viewed,
       CASE WHEN u.updated_at IS NOT NULL AND (b.updated_at IS NULL OR u.updated_at >= b.updated_at)
            THEN coalesce(u.updated_at, b.updated_at) ELSE b.updated_at END AS updated_at
FROM ({UPSERT_BASE}) b FULL OUTER JOIN ({UPSERT_UPD}) u ON b.user_id = u.user_id""")
def upsert_features(fx):
    """Per-user upsert of a partial-column update onto a base table."""
    b = fx.behaviors
    split = fx.as_of - F.expr("INTERVAL 15 DAYS")
    base = (b.where(F.col("ts") < split).groupBy("user_id").agg(
        F.count(F.when(F.col("action") == "click", True)).alias("total_clicks"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("total_purchases"),
        F.countDistinct("item_id").alias("unique_items_viewed"), F.max("ts").alias("updated_at")))
    upd = (b.where(F.col("ts") >= split).groupBy("user_id").agg(
        F.count(F.when(F.col("action") == "click", True)).alias("total_clicks"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("total_purchases"),
        F.max("ts").alias("updated_at")))
    return upsert_latest(base, upd, "user_id", "updated_at")


@query("online_features", views=("behaviors", "as_of_t"), oracle=f"""
WITH lat AS (SELECT user_id, u_clicks, u_purchases FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS r FROM ({USER_DAILY}))
  WHERE r = 1),
seg AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE action = 'purchase') = 0 THEN 'browser'
          WHEN extract(day FROM (SELECT as_of FROM as_of_t) - max(ts)) > 14 THEN 'dormant'
          WHEN count(*) FILTER (WHERE action = 'purchase') >= 15 THEN 'loyal' ELSE 'regular' END AS user_segment
        FROM behaviors GROUP BY user_id)
SELECT c.c_custkey AS user_id, coalesce(lat.u_clicks, 0) AS u_clicks, coalesce(lat.u_purchases, 0) AS u_purchases,
       coalesce(seg.user_segment, 'unknown') AS user_segment
FROM customer c LEFT JOIN lat ON lat.user_id = c.c_custkey LEFT JOIN seg ON seg.user_id = c.c_custkey""")
def online_features(fx):
    """Latest daily stats and segment for every user, with defaults."""
    b = fx.behaviors
    seg = ft.user_segment_rule(b, fx.as_of).select("user_id", "user_segment", F.col("last_ts"))
    views = [ao.FeatureView("user_daily", ft.daily_stats(b, "user_id", "u_"), ["user_id"],
                            ["u_clicks", "u_purchases"], defaults={"u_clicks": 0, "u_purchases": 0}),
             ao.FeatureView("profile", seg, ["user_id"], ["user_segment"], ts="last_ts",
                            defaults={"user_segment": "unknown"})]
    return ao.online_features(fx.users.select("user_id"), views)
