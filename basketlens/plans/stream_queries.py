"""Batch twins of the streaming operators (the same functions, batch input)."""

from __future__ import annotations

from ..streaming import streams as st
from .registry import query


def _wf_sql(interval: str, label: str) -> str:
    return f"""
WITH g AS (SELECT user_id, time_bucket(INTERVAL {interval}, ts) + INTERVAL {interval} AS timestamp,
                  count(*) FILTER (WHERE action = 'click') AS clicks,
                  count(*) FILTER (WHERE action = 'add_to_cart') AS carts,
                  count(*) FILTER (WHERE action = 'purchase') AS purchases
           FROM behaviors GROUP BY ALL)
SELECT user_id, 'click_count_{label}' AS feature_name, CAST(clicks AS DOUBLE) AS feature_value, timestamp,
       '{label}' AS window FROM g
UNION ALL SELECT user_id, 'add_to_cart_count_{label}', CAST(carts AS DOUBLE), timestamp, '{label}' FROM g
UNION ALL SELECT user_id, 'purchase_count_{label}', CAST(purchases AS DOUBLE), timestamp, '{label}' FROM g
UNION ALL SELECT user_id, 'ctr_{label}', CAST(purchases AS DOUBLE) / clicks, timestamp, '{label}' FROM g
          WHERE clicks > 0"""


@query("window_features", views=("behaviors",), oracle=_wf_sql("5 MINUTE", "5min"))
def window_features(fx):
    """ST1: 5-minute tumbling user features in long form (batch twin)."""
    return st.window_features(fx.behaviors, "5 minutes", "5min")


@query("window_features_1h", views=("behaviors",), oracle=_wf_sql("1 HOUR", "1hour"))
def window_features_1h(fx):
    """ST2: 1-hour tumbling user features (batch twin)."""
    return st.window_features(fx.behaviors, "1 hour", "1hour")


@query("window_features_1d", views=("behaviors",), oracle=_wf_sql("1 DAY", "1day"))
def window_features_1d(fx):
    """ST2: 1-day tumbling user features (batch twin)."""
    return st.window_features(fx.behaviors, "1 day", "1day")


@query("hourly_action_counts", views=("behaviors",), oracle="""
SELECT user_id, action, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM behaviors GROUP BY ALL""")
def hourly_action_counts(fx):
    """ST4: per user and action, events per hour bucket (batch twin)."""
    return st.hourly_action_counts(fx.behaviors)


@query("session_windows", views=("behaviors",), oracle="""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events
FROM behaviors GROUP BY user_id, session_id""")
def session_windows(fx):
    """ST9: 6-hour gap session windows (batch twin of the stream)."""
    return st.session_windows(fx.behaviors, "6 hours")
