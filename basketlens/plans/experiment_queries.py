"""Experiment queries: assignment, attribution, results, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import norm_sf_sql, r6
from ..operators import experiments as ex
from .registry import query

_cfg_rows = ",\n".join(
    f"('{e['experiment_id']}', '{e['status']}', {pos}, '{name}', {w})"
    for e in ex.EXPERIMENTS for pos, (name, w, _) in enumerate(e["variants"]))
_active = [e["experiment_id"] for e in ex.EXPERIMENTS if e["status"] == "active"]
_active_sql = ", ".join(f"('{a}')" for a in _active)

EXP_VIEWS = {
    "cfg": ((), f"SELECT * FROM (VALUES {_cfg_rows}) t(experiment_id, status, pos, variant, weight)"),
    "bounds": (("cfg",), """
        SELECT *, CAST(sum(weight) OVER (PARTITION BY experiment_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
                       AS BIGINT) AS hi,
               CAST(sum(weight) OVER (PARTITION BY experiment_id) AS BIGINT) AS tw FROM cfg"""),
    "assign": (("bounds",), """
        SELECT ue.user_id, ue.experiment_id, ue.hash_mod,
               CASE WHEN b.status = 'active' THEN b.variant ELSE 'control' END AS variant
        FROM (SELECT c_custkey AS user_id, e.experiment_id,
                     CAST(CAST('0x' || md5(CAST(c_custkey AS VARCHAR) || ':' || e.experiment_id) AS UHUGEINT)
                          % CAST(e.tw AS UHUGEINT) AS BIGINT) AS hash_mod
              FROM customer, (SELECT DISTINCT experiment_id, tw FROM bounds) e) ue
        JOIN bounds b ON ue.experiment_id = b.experiment_id AND ue.hash_mod >= b.hi - b.weight
                     AND ue.hash_mod < b.hi"""),
    "exposures": (("assign", "behaviors"), f"""
        SELECT b.user_id, a.experiment_id, a.variant, b.ts AS exposure_ts
        FROM behaviors b JOIN assign a ON a.user_id = b.user_id
        WHERE b.action = 'impression' AND a.experiment_id IN (SELECT * FROM (VALUES {_active_sql}))"""),
    "conv": (("behaviors",), f"""
        SELECT event_id, user_id, ts, action AS event_type,
               CASE WHEN action = 'purchase' THEN CAST(round(price * 100) AS BIGINT) ELSE 100 END AS value_cents,
               e.experiment_id
        FROM behaviors, (VALUES {_active_sql}) e(experiment_id) WHERE action IN ('click', 'purchase')"""),
    "attributed": (("conv", "exposures"), """
        SELECT c.*, x.variant, x.exposure_ts AS feature_ts
        FROM conv c ASOF JOIN exposures x
          ON c.user_id = x.user_id AND c.experiment_id = x.experiment_id AND c.ts >= x.exposure_ts
        WHERE x.exposure_ts > c.ts - INTERVAL 30 DAY"""),
    "results": (("exposures", "attributed"), """
        SELECT g.experiment_id, g.variant, g.exposures, g.metric,
               coalesce(c.total, 0.0) AS total, coalesce(c.cnt, 0) AS count,
               coalesce(c.total, 0.0) / g.exposures AS value
        FROM (SELECT experiment_id, variant, count(*) AS exposures, m.metric
              FROM exposures, (VALUES ('ctr'), ('purchase_rate'), ('revenue_per_user')) m(metric)
              GROUP BY ALL) g
        LEFT JOIN (
          SELECT experiment_id, variant, metric, sum(v) / 100.0e0 AS total, count(*) AS cnt FROM (
            SELECT experiment_id, variant, 'ctr' AS metric, 100 AS v FROM attributed WHERE event_type = 'click'
            UNION ALL SELECT experiment_id, variant, 'purchase_rate', 100 FROM attributed
                      WHERE event_type = 'purchase'
            UNION ALL SELECT experiment_id, variant, 'revenue_per_user', value_cents FROM attributed
                      WHERE event_type = 'purchase') GROUP BY ALL) c
        USING (experiment_id, variant, metric)"""),
}


def _ctx(fx):
    spark = fx.spark
    b = fx.behaviors
    assign = ex.assign_variants(fx.users, spark)
    return ex.exposures_and_conversions(b, assign, spark)


@query("assign_variants", views=("assign",), extra_views=EXP_VIEWS, oracle="SELECT * FROM assign")
def assign_variants(fx):
    """Stable md5 variant per (user, experiment); draft -> control."""
    return ex.assign_variants(fx.users, fx.spark)


@query("active_variants", views=("bounds", "assign"), extra_views=EXP_VIEWS, oracle="""
SELECT b.experiment_id, b.variant, b.hi - b.weight AS lo, b.hi, count(a.user_id) AS users
FROM bounds b LEFT JOIN assign a ON a.experiment_id = b.experiment_id AND a.variant = b.variant
WHERE b.status = 'active' GROUP BY ALL""")
def active_variants(fx):
    """Variants of the active experiments, their range, and the users assigned to them."""
    a = ex.assign_variants(fx.users, fx.spark).groupBy("experiment_id", "variant").agg(F.count("user_id").alias("users"))
    v = ex.active_variants(fx.spark).select("experiment_id", "variant", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    return v.join(a, ["experiment_id", "variant"], "left").withColumn("users", F.coalesce("users", F.lit(0).cast("bigint")))


@query("user_variant_params", views=("assign", "cfg"), extra_views=EXP_VIEWS, oracle="""
SELECT a.user_id, a.experiment_id, a.variant,
       CASE WHEN a.experiment_id = 'ranking_model_v2' THEN 'model' WHEN a.experiment_id = 'diversity_strategy'
            THEN 'lambda' ELSE 'strategy' END AS param_key, p.val AS param_value
FROM assign a LEFT JOIN (VALUES
  ('ranking_model_v2', 'control', 'xgboost_v1'), ('ranking_model_v2', 'treatment', 'xgboost_v2'),
  ('diversity_strategy', 'control', '0.5'), ('diversity_strategy', 'treatment_a', '0.3'),
  ('diversity_strategy', 'treatment_b', '0.7'), ('cold_start_strategy', 'control', 'popular'),
  ('cold_start_strategy', 'treatment', 'content_based')) p(experiment_id, variant, val)
  ON p.experiment_id = a.experiment_id AND p.variant = a.variant""")
def user_variant_params(fx):
    """Each user's variant config parameter (e.g. the MMR lambda)."""
    a = ex.variant_params(ex.assign_variants(fx.users, fx.spark), fx.spark)
    key = (F.when(F.col("experiment_id") == "ranking_model_v2", "model")
            .when(F.col("experiment_id") == "diversity_strategy", "lambda").otherwise("strategy"))
    return a.select("user_id", "experiment_id", "variant", key.alias("param_key"),
                    F.col("params")[key].alias("param_value"))


@query("ab_attribution", views=("attributed",), extra_views=EXP_VIEWS, oracle="SELECT * FROM attributed")
def ab_attribution(fx):
    """Conversions attributed to the latest exposure within 30 days."""
    exposures, conv, variants = _ctx(fx)
    return ex.attribute(exposures, conv, variants).select("event_id", "user_id", "ts", "event_type", "value_cents", "experiment_id", "variant", "feature_ts")


def _results(fx):
    exposures, conv, variants = _ctx(fx)
    return ex.experiment_results(exposures, ex.attribute(exposures, conv, variants), variants)


@query("ab_results", views=("results",), extra_views=EXP_VIEWS, oracle="""
SELECT experiment_id, variant, exposures, metric, total, count, value,
       round(CASE WHEN value * (1 - value) / exposures >= 0 THEN sqrt(value * (1 - value) / exposures) END, 6)
         AS stderr FROM results""")
def ab_results(fx):
    """Per variant and metric: exposures, total, count, value, stderr."""
    return _results(fx).withColumn("stderr", r6("stderr")).select(
        "experiment_id", "variant", "exposures", "metric", "total", "count", "value", "stderr")


@query("ab_significance", views=("results",), extra_views=EXP_VIEWS, oracle=f"""
WITH j AS (
  SELECT t.experiment_id, t.metric, t.variant, c.value AS c_value, t.value AS t_value,
         c.exposures AS c_n, t.exposures AS t_n,
         (c.value * c.exposures + t.value * t.exposures) / (c.exposures + t.exposures) AS p_pool
  FROM results t JOIN results c ON t.experiment_id = c.experiment_id AND t.metric = c.metric
  WHERE t.variant <> 'control' AND c.variant = 'control'),
k AS (SELECT *, p_pool * (1 - p_pool) * (1.0e0 / c_n + 1.0e0 / t_n) AS se2 FROM j),
z AS (SELECT *, CASE WHEN c_n > 0 AND t_n > 0 AND se2 > 0 THEN (t_value - c_value) / sqrt(se2) ELSE 0.0 END
                AS z_score FROM k)
SELECT experiment_id, metric, variant, round(c_value, 6) AS c_value, round(t_value, 6) AS t_value,
       round(CASE WHEN c_value > 0 THEN (t_value - c_value) / c_value ELSE 0.0 END, 6) AS lift,
       round(z_score, 6) AS z_score,
       round(CASE WHEN c_n > 0 AND t_n > 0 AND se2 > 0 THEN 2.0 * {norm_sf_sql('abs(z_score)')} ELSE 1.0 END, 6)
         AS p_value,
       (c_n > 0 AND t_n > 0 AND
        CASE WHEN c_n > 0 AND t_n > 0 AND se2 > 0 THEN 2.0 * {norm_sf_sql('abs(z_score)')} ELSE 1.0 END < 0.05)
         AS is_significant
FROM z""")
def ab_significance(fx):
    """Two-proportion z-test of every treatment against control."""
    s = ex.significance(_results(fx))
    return s.select("experiment_id", "metric", "variant",
                    *[r6(c).alias(c) for c in ("c_value", "t_value", "lift", "z_score", "p_value")],
                    "is_significant")


@query("ab_rollup", views=("assign", "behaviors"), extra_views=EXP_VIEWS, oracle="""
WITH pu AS (SELECT user_id, count(*) FILTER (WHERE action = 'impression') AS impressions,
                   count(*) FILTER (WHERE action = 'click') AS clicks,
                   count(*) FILTER (WHERE action = 'purchase') AS purchases,
                   sum(CASE WHEN action = 'purchase' THEN CAST(round(price * 100) AS BIGINT) ELSE 0 END) AS rev
            FROM behaviors GROUP BY user_id),
r AS (SELECT experiment_id, variant, count(DISTINCT a.user_id) AS users, sum(impressions) AS impressions,
             sum(clicks) AS clicks, sum(purchases) AS purchases, CAST(sum(rev) AS DOUBLE) / 100.0e0 AS revenue
      FROM assign a JOIN pu USING (user_id) GROUP BY ALL),
r2 AS (SELECT *, CAST(clicks AS DOUBLE) / NULLIF(impressions, 0) AS ctr,
              CAST(purchases AS DOUBLE) / NULLIF(clicks, 0) AS conversion, revenue / NULLIF(users, 0) AS arpu FROM r)
SELECT r2.experiment_id, r2.variant, r2.users, CAST(r2.impressions AS BIGINT) AS impressions,
       CAST(r2.clicks AS BIGINT) AS clicks, CAST(r2.purchases AS BIGINT) AS purchases, r2.revenue,
       r2.ctr, r2.conversion, r2.arpu,
       CASE WHEN c.ctr > 0 THEN (r2.ctr - c.ctr) / c.ctr END AS ctr_lift,
       CASE WHEN c.conversion > 0 THEN (r2.conversion - c.conversion) / c.conversion END AS conversion_lift,
       CASE WHEN c.arpu > 0 THEN (r2.arpu - c.arpu) / c.arpu END AS arpu_lift
FROM r2 LEFT JOIN (SELECT * FROM r2 WHERE variant = 'control') c USING (experiment_id)""")
def ab_rollup(fx):
    """Experiment roll-up with lift against control."""
    return ex.ab_rollup(fx.behaviors, ex.assign_variants(fx.users, fx.spark))


@query("new_user_retention", views=("behaviors",), oracle="""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM behaviors),
f AS (SELECT user_id, min(d) AS first_day FROM d GROUP BY user_id)
SELECT f.user_id, CAST(f.first_day AS TIMESTAMP) AS first_day,
       EXISTS (SELECT 1 FROM d WHERE d.user_id = f.user_id AND d.d BETWEEN f.first_day + 1 AND f.first_day + 7)
         AS retained
FROM f""")
def new_user_retention(fx):
    """Seen again 1-7 days after the first active day."""
    r = ex.new_user_retention(fx.behaviors)
    return r.withColumn("first_day", F.col("first_day").cast("timestamp_ntz"))


@query("variant_metrics", views=("assign", "behaviors", "users", "as_of_t"), extra_views=EXP_VIEWS, oracle="""
WITH sess AS (SELECT user_id, session_id, count(DISTINCT category_id) AS cats, count(*) AS events
              FROM behaviors GROUP BY ALL),
s AS (SELECT experiment_id, variant, CAST(sum(cats) AS DOUBLE) / count(*) AS diversity_score,
             CAST(sum(events) AS DOUBLE) / count(*) AS session_length
      FROM assign JOIN sess USING (user_id) GROUP BY ALL),
nu AS (SELECT user_id, count(*) FILTER (WHERE action = 'impression') AS imp,
              count(*) FILTER (WHERE action = 'click') AS clk FROM behaviors
       WHERE user_id IN (SELECT user_id FROM users
                         WHERE extract(day FROM (SELECT as_of FROM as_of_t) - first_visit) <= 7)
       GROUP BY user_id),
n AS (SELECT experiment_id, variant, CAST(sum(clk) AS DOUBLE) / NULLIF(sum(imp), 0) AS new_user_ctr
      FROM assign JOIN nu USING (user_id) GROUP BY ALL),
d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM behaviors),
f AS (SELECT user_id, min(d) AS first_day FROM d GROUP BY user_id),
ret AS (SELECT f.user_id, EXISTS (SELECT 1 FROM d WHERE d.user_id = f.user_id
                                  AND d.d BETWEEN f.first_day + 1 AND f.first_day + 7) AS retained FROM f),
rt AS (SELECT experiment_id, variant, CAST(sum(CAST(retained AS INTEGER)) AS DOUBLE) / count(*) AS new_user_retention
       FROM assign JOIN ret USING (user_id) GROUP BY ALL)
SELECT s.experiment_id, s.variant, round(diversity_score, 6) AS diversity_score,
       round(session_length, 6) AS session_length, round(new_user_ctr, 6) AS new_user_ctr,
       round(new_user_retention, 6) AS new_user_retention
FROM s LEFT JOIN n USING (experiment_id, variant) LEFT JOIN rt USING (experiment_id, variant)""")
def variant_metrics(fx):
    """Diversity, session length, new-user CTR and retention per variant."""
    b = fx.sessionized
    v = ex.variant_metrics(b, ex.assign_variants(fx.users, fx.spark), fx.users, fx.as_of)
    return v.select("experiment_id", "variant",
                    *[r6(c).alias(c) for c in ("diversity_score", "session_length", "new_user_ctr",
                                               "new_user_retention")])
