"""User, item and session features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cents, mean_from_cents, ratio_or_zero
from .sequences import bounded_history, global_rank


def _is(action: str) -> Column:
    return F.col("action") == action


def user_stats(b: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A1: per-user conditional counts, distinct items/sessions, mean dwell.

    ``sessions`` (user_id, total_sessions) replaces ``countDistinct(session_id)``
    when given, so the events need no session id."""
    aggs = [F.count(F.when(_is("click"), True)).alias("total_clicks"),
            F.count(F.when(_is("add_to_cart"), True)).alias("total_add_to_cart"),
            F.count(F.when(_is("purchase"), True)).alias("total_purchases"),
            F.countDistinct("item_id").alias("unique_items_viewed")]
    if sessions is None:
        aggs.append(F.countDistinct("session_id").alias("total_sessions"))
    aggs.append(mean_from_cents(F.sum(cents("dwell_time")), F.count("dwell_time")).alias("avg_dwell_time"))
    s = b.groupBy("user_id").agg(*aggs)
    if sessions is not None:
        s = s.join(sessions, "user_id", "left").select(
            "user_id", "total_clicks", "total_add_to_cart", "total_purchases", "unique_items_viewed",
            F.coalesce("total_sessions", F.lit(0).cast("bigint")).alias("total_sessions"), "avg_dwell_time")
    return s


def user_hour_hist(b: DataFrame) -> DataFrame:
    """A2: events per (user, hour of day)."""
    return (b.groupBy("user_id", F.hour("ts").cast("bigint").alias("hour"))
             .agg(F.count(F.lit(1)).alias("hour_count")))


def peak_hour(hist: DataFrame) -> DataFrame:
    """Most active hour per user; ties go to the lower hour.
    The window runs over at most 24 pre-aggregated rows per user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("hour_count"), F.asc("hour"))
    return (hist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                .select("user_id", F.col("hour").alias("peak_hour")))


def top_categories(b: DataFrame, k: int = 3) -> DataFrame:
    """Top-k purchase categories per user (count desc, name asc),
    as an array in rank order."""
    counts = b.where(_is("purchase")).groupBy("user_id", "category_id").agg(
        F.count(F.lit(1)).alias("purchase_count"))
    w = Window.partitionBy("user_id").orderBy(F.desc("purchase_count"), F.asc("category_id"))
    ranked = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return ranked.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "category_id"))),
                    lambda s: s["category_id"]).alias("top_categories"))


def user_features(b: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Stats LEFT peak hour LEFT top categories."""
    return (user_stats(b, sessions)
            .join(peak_hour(user_hour_hist(b)), "user_id", "left")
            .join(top_categories(b), "user_id", "left"))


def item_stats(b: DataFrame) -> DataFrame:
    """A4: item counts, distinct users, mean dwell, purchase_rate (0 without clicks)."""
    s = b.groupBy("item_id").agg(
        F.count(F.when(_is("click"), True)).alias("total_clicks"),
        F.count(F.when(_is("purchase"), True)).alias("total_purchases"),
        F.countDistinct("user_id").alias("unique_users"),
        mean_from_cents(F.sum(cents("dwell_time")), F.count("dwell_time")).alias("avg_dwell_time"))
    return s.withColumn("purchase_rate", ratio_or_zero("total_purchases", "total_clicks"))


def item_purchase_rate(b: DataFrame) -> DataFrame:
    """A4's purchase_rate alone (no distinct aggregate, so no Expand)."""
    s = b.groupBy("item_id").agg(
        F.count(F.when(_is("click"), True)).alias("total_clicks"),
        F.count(F.when(_is("purchase"), True)).alias("total_purchases"))
    return s.select("item_id", ratio_or_zero("total_purchases", "total_clicks").alias("purchase_rate"))


def item_popularity(b: DataFrame) -> DataFrame:
    """A18 (ours): ``ln(1 + clicks + 3*carts + 5*purchases)``."""
    s = b.groupBy("item_id").agg(
        F.count(F.when(_is("click"), True)).alias("clicks"),
        F.count(F.when(_is("add_to_cart"), True)).alias("carts"),
        F.count(F.when(_is("purchase"), True)).alias("purchases"))
    return s.select("item_id", F.log1p(F.col("clicks") + 3 * F.col("carts") + 5 * F.col("purchases"))
                    .alias("popularity_score"))


def session_features(b: DataFrame) -> DataFrame:
    """Per session start/end/size/items/purchases/duration/converted.

    ``items_viewed`` lists each item with its number of events, ``item:n``,
    in the order of first events. Events are first counted per (session,
    item), so a session's list is as long as its distinct items, however many
    events it has.
    """
    per_item = b.groupBy("session_id", "user_id", "item_id").agg(
        F.min(F.struct("ts", "event_id")).alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(_is("purchase"), 1).otherwise(0)).alias("_bought"))
    s = per_item.groupBy("session_id", "user_id").agg(
        F.min("_first.ts").alias("session_start"), F.max("_last").alias("session_end"),
        F.sum("_n").alias("actions_in_session"),
        F.array_sort(F.collect_list(F.struct("_first", "item_id", "_n"))).alias("_items"),
        F.sum("_bought").cast("bigint").alias("purchases_in_session"))
    items = F.transform("_items", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["_n"].cast("string")))
    return (s.withColumn("items_viewed", F.array_join(items, ",")).drop("_items")
             .withColumn("_dur_us", F.timestamp_diff("MICROSECOND", F.col("session_start"), F.col("session_end")))
             .withColumn("session_duration", F.col("_dur_us") / 1e6)
             .withColumn("converted", F.when(F.col("purchases_in_session") > 0, 1).otherwise(0)))


def recent_items(b: DataFrame, n: int = 10) -> DataFrame:
    """Last-n items per user, newest first, duplicates kept.
    ``row_number() <= n`` is planned with a partial WindowGroupLimit, so a hot
    user contributes at most n rows per map task to the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = b.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "item_id"))), lambda s: s["item_id"])
         .alias("recent_items"))


def recent_sequence(b: DataFrame, n: int = 50) -> DataFrame:
    """Last-n (ts, item) members per user, oldest first; identical
    (ts, item) members collapse as in a sorted set."""
    d = b.select("user_id", "ts", "item_id").distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    top = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("seq_len"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda s: s["item_id"])
         .alias("sequence"))


def instant_interest(b: DataFrame, window_events: int = 10, min_count: int = 3) -> DataFrame:
    """Flag events whose item occurs >= min_count times among the user's
    last ``window_events`` events (this one included, any action)."""
    h = bounded_history(b, "user_id", "ts", "event_id", "item_id", window_events - 1, out="_hist")
    cnt = F.size(F.filter("_hist", lambda x: x == F.col("item_id")))
    return h.select("event_id", "user_id", "item_id", "ts", cnt.cast("bigint").alias("occurrences"),
                    (cnt >= min_count).alias("interest"))


def category_entropy(b: DataFrame) -> DataFrame:
    """A16 (ours): Shannon entropy (natural log) of a user's purchase categories."""
    c = b.where(_is("purchase")).groupBy("user_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("user_id").agg(F.sum("n").alias("tot"))
    p = c.join(tot, "user_id").withColumn("p", F.col("n") / F.col("tot"))
    return p.groupBy("user_id").agg((-F.sum(F.col("p") * F.log(F.col("p")))).alias("category_entropy"))


def user_statistics(b: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """A16/A17 (ours): trailing-window statistics as of ``as_of``.

    click_7d_avg = clicks in (as_of-7d, as_of] / 7; purchase_30d_total and
    active_days_30d over (as_of-30d, as_of]; session_avg_duration = mean A6
    duration; category_entropy = A16.
    """
    in7 = F.col("ts") > as_of - F.expr("INTERVAL 7 DAYS")
    in30 = F.col("ts") > as_of - F.expr("INTERVAL 30 DAYS")
    s = b.where(F.col("ts") <= as_of).groupBy("user_id").agg(
        (F.count(F.when(_is("click") & in7, True)) / F.lit(7.0)).alias("click_7d_avg"),
        F.count(F.when(_is("purchase") & in30, True)).alias("purchase_30d_total"),
        F.countDistinct(F.when(in30, F.to_date("ts"))).alias("active_days_30d"))
    sess = sessions.groupBy("user_id").agg(
        (F.sum("_dur_us").cast("double") / (F.count(F.lit(1)) * 1e6)).alias("session_avg_duration"))
    return (s.join(sess, "user_id", "left").join(category_entropy(b), "user_id", "left")
             .withColumn("category_entropy", F.coalesce("category_entropy", F.lit(0.0))))


def user_segment_rule(b: DataFrame, as_of: Column) -> DataFrame:
    """A19 rule part: segment per user from purchases and recency.

    no purchase -> 'browser'; last event more than 14 days before as_of ->
    'dormant'; 15+ purchases -> 'loyal'; else 'regular'.
    """
    s = b.groupBy("user_id").agg(
        F.count(F.when(_is("purchase"), True)).alias("purchases"),
        F.sum(F.when(_is("purchase"), cents("price"))).alias("_rev_cents"),
        F.max("ts").alias("last_ts"))
    s = s.withColumn("avg_order_value",
                     F.try_divide(F.col("_rev_cents").cast("double"), F.col("purchases") * F.lit(100.0)))
    recency = F.extract(F.lit("DAY"), as_of - F.col("last_ts"))
    return s.withColumn("user_segment",
                        F.when(F.col("purchases") == 0, "browser")
                         .when(recency > 14, "dormant")
                         .when(F.col("purchases") >= 15, "loyal")
                         .otherwise("regular")).drop("_rev_cents")


def user_segments(b: DataFrame, as_of: Column) -> DataFrame:
    """A19 (ours): rule segment plus ``purchase_power`` = percent rank of the
    user's mean order value among purchasing users (distributed rank)."""
    s = user_segment_rule(b, as_of)
    ranked = global_rank(s, "avg_order_value", out="_rank")
    n = s.where(F.col("avg_order_value").isNotNull()).select(F.count(F.lit(1))).scalar()
    return ranked.select(
        "user_id", "user_segment", "purchases", "avg_order_value",
        F.when(F.col("_rank").isNull(), F.lit(None).cast("double"))
         .when(n <= 1, F.lit(0.0))
         .otherwise((F.col("_rank") - 1) / (n - 1)).alias("purchase_power"))


def daily_stats(b: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per key and calendar day: clicks and purchases, stamped at day end
    (the time the day's statistics become available)."""
    day_end = F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return b.groupBy(key, day_end.alias("event_timestamp")).agg(
        F.count(F.when(_is("click"), True)).alias(f"{prefix}clicks"),
        F.count(F.when(_is("purchase"), True)).alias(f"{prefix}purchases"))
