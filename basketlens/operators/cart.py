"""Cart: state, merge, coupons, timeouts, abandonment, checkout funnel
(A32-A34, J17-J19, ST7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import interval_anti_join

# Coupon catalogue (percent off) with validity windows.
COUPONS = [("C10", 10, "2024-01-01 00:00:00", "2024-12-31 23:59:59"),
           ("C20", 20, "2023-01-01 00:00:00", "2023-12-31 23:59:59"),
           ("C30", 30, "2025-01-01 00:00:00", "2025-12-31 23:59:59")]


def cart_events(b: DataFrame, items: DataFrame) -> DataFrame:
    """add_to_cart rows (quantity 1, price in cents) and purchases."""
    price = items.select("item_id", F.col("item_name").alias("name"),
                         F.round(F.col("price") * 100).cast("bigint").alias("price_cents"))
    return (b.where(F.col("action").isin("add_to_cart", "purchase"))
             .select("event_id", "user_id", "item_id", "action", "ts").join(price, "item_id", "left"))


def open_lines(ev: DataFrame) -> DataFrame:
    """Cart lines still open: adds after the last purchase of the same
    (user, item); quantity = number of such adds."""
    last_buy = (ev.where(F.col("action") == "purchase").groupBy("user_id", "item_id")
                  .agg(F.max("ts").alias("_bought")))
    adds = ev.where(F.col("action") == "add_to_cart").join(last_buy, ["user_id", "item_id"], "left")
    adds = adds.where(F.col("_bought").isNull() | (F.col("ts") > F.col("_bought")))
    return adds.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("quantity"), F.max_by("price_cents", "ts").alias("price_cents"),
        F.max("ts").alias("last_ts"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Lines, items and total price per user cart."""
    return lines.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("items"),
        (F.sum(F.col("quantity") * F.col("price_cents")) / F.lit(100.0)).alias("total_price"),
        F.max("last_ts").alias("last_ts"))


def merge_carts(user_cart: DataFrame, session_cart: DataFrame) -> DataFrame:
    """Union both carts; sum quantities per sku, keep the latest price."""
    u = user_cart.unionByName(session_cart)
    return u.groupBy("user_id", "item_id").agg(
        F.sum("quantity").alias("quantity"), F.max_by("price_cents", "ts").alias("price_cents"))


def coupons_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUPONS, "code string, percent int, valid_from string, valid_to string").select(
        "code", "percent", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


def apply_coupons(totals: DataFrame, assigned: DataFrame, coupons: DataFrame) -> DataFrame:
    """Coupon valid at the cart's last event (range predicate on the
    small broadcast coupon table) -> discounted total; otherwise an error
    status and the undiscounted total."""
    j = totals.join(assigned, "user_id", "left").join(F.broadcast(coupons), "code", "left")
    status = (F.when(F.col("code").isNull(), "none")
               .when(F.col("last_ts") < F.col("valid_from"), "not_yet_valid")
               .when(F.col("last_ts") > F.col("valid_to"), "expired")
               .otherwise("applied"))
    pct = F.when(status == "applied", F.col("percent")).otherwise(F.lit(0))
    return j.select("user_id", F.col("code").alias("coupon_code"), status.alias("status"), "total_price",
                    (F.round(F.col("total_price") * 100) * (100 - pct) / F.lit(10000.0)).alias("discounted_total"))


def unanswered(starts: DataFrame, answers: DataFrame, key: str, within_seconds: int) -> DataFrame:
    """J19/A33 kernel: start rows with no answer row of the same key in
    (ts, ts + within] -- a time-bucketed interval anti join."""
    return interval_anti_join(starts, answers, key, within_seconds)


def checkout_funnel(orders: DataFrame) -> DataFrame:
    """Saga stages per order (submitted; reserved for P/F; paid for F;
    aborted for O with priority 5-LOW), terminal state and funnel counts."""
    st = orders.select(
        "o_orderkey", F.lit(1).alias("submitted"),
        F.col("o_orderstatus").isin("P", "F").cast("int").alias("reserved"),
        (F.col("o_orderstatus") == "F").cast("int").alias("paid"),
        ((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")).cast("int").alias("aborted"))
    terminal = (F.when(F.col("paid") == 1, "paid").when(F.col("aborted") == 1, "aborted")
                 .when(F.col("reserved") == 1, "reserved").otherwise("submitted"))
    per = st.groupBy(terminal.alias("terminal_state")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("submitted").alias("submitted"),
        F.sum("reserved").alias("reserved"), F.sum("paid").alias("paid"), F.sum("aborted").alias("aborted"))
    total = orders.select(F.count(F.lit(1))).scalar()
    return per.withColumn("share", F.col("orders") / total)


def cart_history(ev: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """ST7 batch twin: cart events of the last ``hours`` before as_of."""
    return ev.where((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))
