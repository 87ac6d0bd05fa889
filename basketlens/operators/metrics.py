"""KPI, cohort, diversity and monitoring metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket_index, cents, ntz_from_bucket, trunc_hour_ntz, try_ratio, week_start_ntz


def hourly_kpis(b: DataFrame, as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """A7 (+P3 when ``days`` is given): hourly active users, events,
    impressions, clicks, purchases, revenue and the three ratios."""
    d = b
    if days is not None:
        d = d.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    h = d.groupBy(trunc_hour_ntz("ts").alias("hour")).agg(
        F.countDistinct("user_id").alias("active_users"),
        F.count(F.lit(1)).alias("total_events"),
        F.count(F.when(F.col("action") == "impression", True)).alias("impressions"),
        F.count(F.when(F.col("action") == "click", True)).alias("clicks"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("purchases"),
        (F.sum(F.when(F.col("action") == "purchase", cents("price")).otherwise(0)) / F.lit(100.0))
        .alias("revenue"))
    return (h.withColumn("ctr", try_ratio("clicks", "impressions"))
             .withColumn("purchase_rate", try_ratio("purchases", "clicks"))
             .withColumn("revenue_per_user", try_ratio("revenue", "active_users")))


def weekly_report(hourly: DataFrame) -> DataFrame:
    """Per week, the mean of the hourly KPIs (nulls skipped)."""
    return hourly.groupBy(week_start_ntz("hour").alias("week_start")).agg(
        F.count(F.lit(1)).alias("hours"),
        F.avg("active_users").alias("avg_active_users"), F.avg("ctr").alias("avg_ctr"),
        F.avg("purchase_rate").alias("avg_purchase_rate"), F.avg("revenue_per_user").alias("avg_arpu"))


def per_user_rates(b: DataFrame) -> DataFrame:
    """user_behavior_stats: ctr = clicks/impressions, purchase_rate =
    purchases/clicks, avg_order_value = mean purchase price."""
    s = b.groupBy("user_id").agg(
        F.count(F.when(F.col("action") == "impression", True)).alias("impressions"),
        F.count(F.when(F.col("action") == "click", True)).alias("clicks"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("purchases"),
        F.sum(F.when(F.col("action") == "purchase", cents("price"))).alias("_rev"))
    return s.select("user_id", try_ratio("clicks", "impressions").alias("ctr"),
                    try_ratio("purchases", "clicks").alias("purchase_rate"),
                    F.try_divide(F.col("_rev").cast("double"), F.col("purchases") * F.lit(100.0))
                    .alias("avg_order_value"))


def segment_summary(users: DataFrame, rates: DataFrame) -> DataFrame:
    """Profiles LEFT JOIN stats, averaged per segment."""
    return users.join(rates, "user_id", "left").groupBy("user_segment").agg(
        F.countDistinct("user_id").alias("user_count"), F.avg("ctr").alias("avg_ctr"),
        F.avg("purchase_rate").alias("avg_purchase_rate"), F.avg("avg_order_value").alias("avg_order_value"))


# Cohort labels and their limits in days.
def cohort_labels(days_user: Column, days_item: Column) -> tuple[Column, Column]:
    """User cohort (<=7 new, <=30 medium, else old) and item cohort."""
    uc = (F.when(days_user <= 7, "new_user").when(days_user <= 30, "medium_user").otherwise("old_user"))
    ic = F.when(days_item <= 7, "new_item").otherwise("old_item")
    return uc, ic


def cold_start_cohorts(b: DataFrame, users: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Mean clicked per (user cohort, item cohort) over impressions+clicks."""
    d = (b.where(F.col("action").isin("impression", "click"))
          .select("user_id", "item_id", (F.col("action") == "click").cast("int").alias("clicked"))
          .join(users.select("user_id", "first_visit"), "user_id")
          .join(items.select("item_id", "launch_date"), "item_id"))
    du = F.extract(F.lit("DAY"), as_of - F.col("first_visit"))
    di = F.extract(F.lit("DAY"), as_of - F.col("launch_date"))
    uc, ic = cohort_labels(du, di)
    return d.groupBy(uc.alias("user_cohort"), ic.alias("item_cohort")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("clicked").cast("double") / F.count(F.lit(1))).alias("ctr"))


def cold_start_cube(b: DataFrame, users: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """A9 with margins: clicks per impression or click for every (user cohort,
    item cohort), for each cohort alone, and in all. ``margin``: 0 a cell, 1 a
    user cohort, 2 an item cohort, 3 all; the other column is null there. The
    cube runs over the few cohort counts, not over the log."""
    g = cold_start_cohorts(b, users, items, as_of).withColumn("clicks", F.round(F.col("ctr") * F.col("n")).cast("bigint"))
    return g.cube("user_cohort", "item_cohort").agg(
        F.grouping_id().cast("int").alias("margin"), F.sum("n").alias("n"), F.sum("clicks").alias("clicks")).withColumn("ctr", F.col("clicks") / F.col("n"))


def cold_start_pivot(cohorts: DataFrame) -> DataFrame:
    """User cohort x item cohort grid (pivot with fixed values)."""
    return cohorts.groupBy("user_cohort").pivot("item_cohort", ["new_item", "old_item"]).agg(F.first("ctr"))


def cold_start_decay(cohorts: DataFrame) -> DataFrame:
    """Decay of new users / new items / both relative to (old, old)."""
    def cell(u: str, i: str) -> Column:
        return F.max(F.when((F.col("user_cohort") == u) & (F.col("item_cohort") == i), F.col("ctr")))
    g = cohorts.agg(cell("old_user", "old_item").alias("oo"), cell("new_user", "old_item").alias("no"),
                    cell("old_user", "new_item").alias("on"), cell("new_user", "new_item").alias("nn"))
    return g.select(
        F.try_divide(F.col("no") - F.col("oo"), F.col("oo")).alias("user_cold_decay"),
        F.try_divide(F.col("on") - F.col("oo"), F.col("oo")).alias("item_cold_decay"),
        F.try_divide(F.col("nn") - F.col("oo"), F.col("oo")).alias("double_cold_decay"))


def request_diversity(rec_log: DataFrame, item_pop: DataFrame, as_of: Column | None = None,
                      days: int | None = None) -> DataFrame:
    """Per request distinct categories, mean popularity and clicked."""
    r = rec_log
    if days is not None:
        r = r.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    return r.join(item_pop, "item_id").groupBy("request_id").agg(
        F.countDistinct("category_id").alias("category_diversity"),
        F.avg("popularity_score").alias("avg_popularity"),
        F.max("clicked").alias("clicked"))


def ctr_by_diversity(div: DataFrame) -> DataFrame:
    """Requests and mean clicked per diversity level."""
    return div.groupBy("category_diversity").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum("clicked").cast("double") / F.count(F.lit(1))).alias("ctr"))


# -- monitoring -----------------------------------------------------------

def monitoring_events(raw: DataFrame) -> DataFrame:
    """Request-log view of the raw behaviour log: error flag, latency,
    model version and page type (FIXTURES.md section 3)."""
    return raw.select("event_id", "user_id", "item_id", "action", "ts",
                      (F.col("action") == "error").alias("is_error"),
                      F.col("dwell_time").alias("latency"),
                      (F.col("user_id") % 3).alias("model_version"),
                      (F.col("event_id") % 4).alias("page_type"))


def request_rate(m: DataFrame, step: str = "1 minute", step_seconds: int = 60) -> DataFrame:
    """Requests per window and page type, and rate per second."""
    return (m.groupBy(F.window("ts", step).start.alias("window_start"), "page_type")
             .agg(F.count(F.lit(1)).alias("requests"))
             .withColumn("qps", F.col("requests") / F.lit(float(step_seconds))))


def latency_p99(m: DataFrame, step: str = "1 hour", threshold: float = 0.5,
                accuracy: int = 10000) -> DataFrame:
    """p99 latency per window with a bounded-memory quantile sketch
    (``percentile_approx``) and the alert flag ``p99 > threshold``."""
    return (m.groupBy(F.window("ts", step).start.alias("window_start"))
             .agg(F.percentile_approx("latency", 0.99, accuracy).alias("p99_latency"),
                  F.count(F.lit(1)).alias("requests"))
             .withColumn("alert", F.col("p99_latency") > threshold))


def ratio_windows(m: DataFrame, num: Column, den: Column, step_seconds: int) -> DataFrame:
    """Per fixed window: numerator, denominator and ratio, plus the window index."""
    idx = bucket_index("ts", step_seconds)
    return (m.groupBy(idx.alias("window_idx"))
             .agg(F.count(F.when(num, True)).alias("num"), F.count(F.when(den, True)).alias("den"))
             .withColumn("ratio", try_ratio("num", "den")))


def trailing_ratio_windows(m: DataFrame, num: Column, den: Column, step_seconds: int, steps: int) -> DataFrame:
    """Like ``ratio_windows`` at every step, over the last ``steps`` steps:
    rows are counted per step first, and only the counts are spread."""
    per = m.groupBy(bucket_index("ts", step_seconds).alias("_i")).agg(
        F.count(F.when(num, True)).alias("_num"), F.count(F.when(den, True)).alias("_den"))
    spread = per.select(F.explode(F.sequence(F.col("_i"), F.col("_i") + steps - 1)).alias("window_idx"), "_num", "_den")
    return (spread.groupBy("window_idx").agg(F.sum("_num").alias("num"), F.sum("_den").alias("den"))
            .withColumn("ratio", try_ratio("num", "den")))


def alert_islands(windows: DataFrame, condition: Column, min_windows: int, step_seconds: int,
                  series: list[str] | None = None) -> DataFrame:
    """Runs of >= ``min_windows`` consecutive windows where ``condition``
    holds (gaps-and-islands: window index minus row number is constant on a
    run). The window runs over one row per time window per series, so its
    size is bounded by the time span, not by the event volume."""
    keys = series or []
    hit = windows.where(condition)
    w = Window.partitionBy(*keys).orderBy("window_idx") if keys else Window.orderBy("window_idx")
    isl = hit.withColumn("_island", F.col("window_idx") - F.row_number().over(w))
    out = isl.groupBy(*keys, "_island").agg(
        F.min("window_idx").alias("_first"), F.max("window_idx").alias("_last"),
        F.count(F.lit(1)).alias("n_windows"))
    return (out.where(F.col("n_windows") >= min_windows)
               .select(*keys,
                       ntz_from_bucket(F.col("_first"), step_seconds).alias("alert_start"),
                       ntz_from_bucket(F.col("_last") + 1, step_seconds).alias("alert_end"),
                       "n_windows"))


def top_items_by_impression(m: DataFrame, k: int = 10) -> DataFrame:
    """Global top-k items by impressions (TakeOrderedAndProject)."""
    return (m.where(F.col("action") == "impression").groupBy("item_id")
             .agg(F.count(F.lit(1)).alias("impressions"))
             .orderBy(F.desc("impressions"), F.asc("item_id")).limit(k))


def version_share(m: DataFrame) -> DataFrame:
    """Share of requests per model version (total as a scalar subquery)."""
    total = m.select(F.count(F.lit(1))).scalar()
    return (m.groupBy("model_version").agg(F.count(F.lit(1)).alias("requests"))
             .withColumn("share", F.col("requests") / total))


MINUTE = 60


def active_users_sliding(b: DataFrame, length_minutes: int = 5) -> DataFrame:
    """Distinct users of every sliding window (1-minute slide), exactly,
    without a copy of a row for each window it lies in.

    Events become (user, minute) panes once. Of a user's panes in a window the
    first one counts: a pane at minute p, with the user's pane before it at q,
    counts in the windows that start in (max(p - length, q), p]. So each pane
    adds one user where that range begins and takes them off behind it; a
    running sum over the changes (at most two a minute) gives the counts."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    minute = F.floor(F.timestamp_diff("SECOND", zero, F.date_trunc("minute", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")) / MINUTE).cast("long")
    panes = b.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", minute.alias("p")).distinct()
    before = F.lag("p").over(Window.partitionBy("user_id").orderBy("p"))  # a row for each minute of a user
    ranges = panes.withColumn("q", before).select(F.greatest(F.col("p") - length_minutes, F.coalesce("q", F.col("p") - length_minutes)).alias("from"), "p")
    changes = (ranges.select(F.explode(F.array(F.struct((F.col("from") + 1).alias("s"), F.lit(1).alias("d")), F.struct((F.col("p") + 1).alias("s"), F.lit(-1).alias("d")))).alias("x"))
               .groupBy("x.s").agg(F.sum("x.d").alias("d")))
    along = Window.orderBy("s")  # a row for each minute of the log
    runs = changes.withColumn("active_users", F.sum("d").over(along)).withColumn("next", F.lead("s").over(along)).where("active_users > 0")
    starts = runs.select(F.explode(F.sequence("s", F.col("next") - 1)).alias("s"), "active_users")

    def at(minutes: Column) -> Column:
        return zero + F.make_dt_interval(mins=minutes.cast("int"))

    return starts.select(at(F.col("s")).alias("window_start"), at(F.col("s") + length_minutes).alias("window_end"), F.col("active_users").cast("bigint").alias("active_users"))


def active_user_panes(b: DataFrame, pane: str = "1 minute", lg_k: int = 12) -> DataFrame:
    """A29/ST6: a mergeable distinct-users sketch for each pane (tumbling, so
    the same on a stream, where a pane is emitted once)."""
    return (b.groupBy(F.window("ts", pane).alias("w")).agg(F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("users"))
             .select(F.col("w.start").alias("pane_start"), "users"))


def active_users_from_panes(panes: DataFrame, length_minutes: int = 5) -> DataFrame:
    """Estimated distinct users of sliding windows: the sketches of their
    panes merged (panes, not events, are sent to their windows)."""
    back = F.explode(F.sequence(F.lit(0), F.lit(length_minutes - 1))).alias("k")
    return (panes.select("pane_start", "users", back)
            .groupBy((F.col("pane_start") - F.make_dt_interval(mins=F.col("k"))).alias("window_start"))
            .agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users")))


def user_ctr(b: DataFrame) -> DataFrame:
    """Per-user CTR gauge = clicks / impressions."""
    s = b.groupBy("user_id").agg(
        F.count(F.when(F.col("action") == "impression", True)).alias("impressions"),
        F.count(F.when(F.col("action") == "click", True)).alias("clicks"))
    return s.withColumn("ctr", try_ratio("clicks", "impressions"))


def duplicate_keys(df: DataFrame, key: str, key_type: str, case_fold: bool = False) -> DataFrame:
    """Keys declared unique that occur more than once."""
    k = F.lower(F.col(key)) if case_fold else F.col(key)
    return (df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
              .select(F.lit(key_type).alias("key_type"), "key", "n"))
