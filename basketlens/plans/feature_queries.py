"""Queries over user / item / session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import features as ft
from ..operators.io import read_behaviors
from ..operators.sessions import session_counts
from .registry import query

# Shared oracle fragments --------------------------------------------------
AVG_DWELL_SQL = ("CAST(sum(CAST(round(dwell_time * 100) AS BIGINT)) AS DOUBLE)"
                 " / (100.0e0 * count(dwell_time))")

USER_STATS_SQL = f"""
SELECT user_id,
       count(*) FILTER (WHERE action = 'click') AS total_clicks,
       count(*) FILTER (WHERE action = 'add_to_cart') AS total_add_to_cart,
       count(*) FILTER (WHERE action = 'purchase') AS total_purchases,
       count(DISTINCT item_id) AS unique_items_viewed,
       count(DISTINCT session_id) AS total_sessions,
       {AVG_DWELL_SQL} AS avg_dwell_time
FROM behaviors GROUP BY user_id"""

HOUR_HIST_SQL = ("SELECT user_id, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS hour_count "
                 "FROM behaviors GROUP BY ALL")

PEAK_SQL = f"""
SELECT user_id, hour AS peak_hour FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour_count DESC, hour) AS r
  FROM ({HOUR_HIST_SQL})) WHERE r = 1"""

TOPCAT_SQL = """
SELECT user_id, string_agg(category_id, ',' ORDER BY r) AS top_categories FROM (
  SELECT user_id, category_id,
         row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_id) AS r
  FROM (SELECT user_id, category_id, count(*) AS n FROM behaviors
        WHERE action = 'purchase' GROUP BY ALL)) WHERE r <= 3 GROUP BY user_id"""

SESSION_SQL = """
WITH viewed AS (
  SELECT session_id, user_id, string_agg(CAST(item_id AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY first) AS items_viewed
  FROM (SELECT session_id, user_id, item_id, count(*) AS n, min({'t': ts, 'e': event_id}) AS first
        FROM behaviors GROUP BY session_id, user_id, item_id) GROUP BY session_id, user_id),
s AS (
  SELECT session_id, user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS actions_in_session,
         CAST(sum(CASE WHEN action = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases_in_session
  FROM behaviors GROUP BY session_id, user_id)
SELECT session_id, user_id, session_start, session_end, actions_in_session, items_viewed, purchases_in_session,
       date_diff('microsecond', session_start, session_end) / 1e6 AS session_duration,
       CASE WHEN purchases_in_session > 0 THEN 1 ELSE 0 END AS converted
FROM s JOIN viewed USING (session_id, user_id)"""


@query("scan_behaviors", views=("behaviors",), oracle="""
SELECT event_id, user_id, item_id, category_id, action, ts, dwell_time, session_id FROM behaviors""")
def scan_behaviors(fx):
    """7-column behaviour scan (+ event_id); whole log, no day filter."""
    return read_behaviors(fx.sessionized)


@query("user_stats", views=("behaviors",), oracle=USER_STATS_SQL)
def user_stats(fx):
    """A1: per-user behaviour statistics."""
    return ft.user_stats(fx.behaviors, session_counts(fx.behaviors))


@query("user_hour_hist", views=("behaviors",), oracle=HOUR_HIST_SQL)
def user_hour_hist(fx):
    """A2: per-user hour-of-day histogram."""
    return ft.user_hour_hist(fx.behaviors)


@query("peak_hour", views=("behaviors",), oracle=PEAK_SQL)
def peak_hour(fx):
    """Peak hour per user."""
    return ft.peak_hour(ft.user_hour_hist(fx.behaviors))


@query("top_categories", views=("behaviors",), oracle=TOPCAT_SQL)
def top_categories(fx):
    """Top-3 purchase categories per user."""
    return ft.top_categories(fx.behaviors).select(
        "user_id", F.array_join("top_categories", ",").alias("top_categories"))


@query("user_features", views=("behaviors",), oracle=f"""
SELECT st.*, pk.peak_hour, tc.top_categories
FROM ({USER_STATS_SQL}) st LEFT JOIN ({PEAK_SQL}) pk USING (user_id)
     LEFT JOIN ({TOPCAT_SQL}) tc USING (user_id)""")
def user_features(fx):
    """Assembled user profile features (flagship ETL slice)."""
    return ft.user_features(fx.behaviors, session_counts(fx.behaviors)).withColumn(
        "top_categories", F.array_join("top_categories", ","))


@query("item_stats", views=("behaviors",), oracle=f"""
SELECT item_id,
       count(*) FILTER (WHERE action = 'click') AS total_clicks,
       count(*) FILTER (WHERE action = 'purchase') AS total_purchases,
       count(DISTINCT user_id) AS unique_users,
       {AVG_DWELL_SQL} AS avg_dwell_time,
       CASE WHEN count(*) FILTER (WHERE action = 'click') > 0
            THEN CAST(count(*) FILTER (WHERE action = 'purchase') AS DOUBLE)
                 / count(*) FILTER (WHERE action = 'click') ELSE 0.0 END AS purchase_rate
FROM behaviors GROUP BY item_id""")
def item_stats(fx):
    """A4: item statistics with purchase rate."""
    return ft.item_stats(fx.behaviors)


ITEM_POP_SQL = """
SELECT item_id, round(ln(1 + count(*) FILTER (WHERE action = 'click')
                     + 3 * count(*) FILTER (WHERE action = 'add_to_cart')
                     + 5 * count(*) FILTER (WHERE action = 'purchase')), 6) AS popularity_score
FROM behaviors GROUP BY item_id"""


@query("item_popularity", views=("behaviors",), oracle=ITEM_POP_SQL)
def item_popularity(fx):
    """Item popularity score."""
    return ft.item_popularity(fx.behaviors).withColumn("popularity_score", r6("popularity_score"))


@query("session_features", views=("behaviors",), oracle=SESSION_SQL)
def session_features(fx):
    """Session features over 6 h gap sessions."""
    return ft.session_features(fx.sessionized).drop("_dur_us")


@query("recent_items", views=("behaviors",), oracle="""
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY r) AS recent_items FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM behaviors) WHERE r <= 10 GROUP BY user_id""")
def recent_items(fx):
    """Last 10 items per user, newest first."""
    return ft.recent_items(fx.behaviors).select(
        "user_id", F.array_join("recent_items", ",").alias("recent_items"))


@query("recent_sequence", views=("behaviors",), oracle="""
SELECT user_id, count(*) AS seq_len, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, item_id) AS sequence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r
      FROM (SELECT DISTINCT user_id, ts, item_id FROM behaviors)) WHERE r <= 50 GROUP BY user_id""")
def recent_sequence(fx):
    """Last 50 (ts, item) members per user."""
    return ft.recent_sequence(fx.behaviors).select(
        "user_id", "seq_len", F.array_join("sequence", ",").alias("sequence"))


@query("instant_interest", views=("behaviors",), oracle="""
WITH s AS (SELECT event_id, user_id, item_id, ts,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM behaviors)
SELECT a.event_id, a.user_id, a.item_id, a.ts, count(*) AS occurrences, count(*) >= 3 AS interest
FROM s a JOIN s b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 9 AND a.rn AND b.item_id = a.item_id
GROUP BY a.event_id, a.user_id, a.item_id, a.ts""")
def instant_interest(fx):
    """Instant-interest flag per event (>=3 of the last 10 events)."""
    return ft.instant_interest(fx.behaviors)


@query("user_statistics", views=("behaviors", "as_of_t"), oracle=f"""
WITH s AS (
  SELECT user_id,
         count(*) FILTER (WHERE action = 'click' AND ts > (SELECT as_of FROM as_of_t) - INTERVAL 7 DAY) / 7.0e0
           AS click_7d_avg,
         count(*) FILTER (WHERE action = 'purchase' AND ts > (SELECT as_of FROM as_of_t) - INTERVAL 30 DAY)
           AS purchase_30d_total,
         count(DISTINCT CASE WHEN ts > (SELECT as_of FROM as_of_t) - INTERVAL 30 DAY THEN CAST(ts AS DATE) END)
           AS active_days_30d
  FROM behaviors WHERE ts <= (SELECT as_of FROM as_of_t) GROUP BY user_id),
sess AS (SELECT user_id, CAST(sum(date_diff('microsecond', session_start, session_end)) AS DOUBLE)
                        / (count(*) * 1e6) AS session_avg_duration FROM ({SESSION_SQL}) GROUP BY user_id),
c AS (SELECT user_id, category_id, count(*) AS n FROM behaviors WHERE action = 'purchase' GROUP BY ALL),
ent AS (SELECT c.user_id, -sum((n / tot) * ln(n / tot)) AS category_entropy
        FROM c JOIN (SELECT user_id, CAST(sum(n) AS DOUBLE) AS tot FROM c GROUP BY user_id) t USING (user_id)
        GROUP BY c.user_id)
SELECT s.user_id, round(s.click_7d_avg, 6) AS click_7d_avg, s.purchase_30d_total, s.active_days_30d,
       round(sess.session_avg_duration, 6) AS session_avg_duration,
       round(coalesce(ent.category_entropy, 0.0), 6) AS category_entropy
FROM s LEFT JOIN sess USING (user_id) LEFT JOIN ent USING (user_id)""")
def user_statistics(fx):
    """Trailing 7/30-day statistics, entropy, mean session length."""
    b = fx.behaviors
    out = ft.user_statistics(b, ft.session_features(fx.sessionized), fx.as_of)
    return out.select("user_id", r6("click_7d_avg").alias("click_7d_avg"), "purchase_30d_total",
                      "active_days_30d", r6("session_avg_duration").alias("session_avg_duration"),
                      r6("category_entropy").alias("category_entropy"))


@query("user_segments", views=("behaviors", "as_of_t"), oracle="""
WITH s AS (
  SELECT user_id, count(*) FILTER (WHERE action = 'purchase') AS purchases,
         CAST(sum(CASE WHEN action = 'purchase' THEN CAST(round(price * 100) AS BIGINT) END) AS DOUBLE)
           / (count(*) FILTER (WHERE action = 'purchase') * 100.0e0) AS avg_order_value,
         max(ts) AS last_ts
  FROM behaviors GROUP BY user_id),
pr AS (SELECT user_id, percent_rank() OVER (ORDER BY avg_order_value) AS purchase_power
       FROM s WHERE avg_order_value IS NOT NULL)
SELECT s.user_id,
       CASE WHEN purchases = 0 THEN 'browser'
            WHEN extract(day FROM (SELECT as_of FROM as_of_t) - last_ts) > 14 THEN 'dormant'
            WHEN purchases >= 15 THEN 'loyal' ELSE 'regular' END AS user_segment,
       purchases, avg_order_value, round(pr.purchase_power, 6) AS purchase_power
FROM s LEFT JOIN pr USING (user_id)""")
def user_segments(fx):
    """Rule-based segment and purchase power."""
    return ft.user_segments(fx.behaviors, fx.as_of).withColumn("purchase_power", r6("purchase_power"))
