"""Commerce views over the driver tables (see FIXTURES.md section 3).

Each view is a lazy DataFrame; nothing is cached or collected. ``as_of`` is a
scalar subquery on the newest event time (written once a run), so no result
depends on the wall clock and no cross join is needed to attach it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import month_index, number_within
from ..operators.sessions import sessionize
from .shared import materialize
from .tables import Tables

# Event-type to behaviour-action mapping of the fixture.
ACTION_MAP = {"view": "impression", "click": "click", "signup": "add_to_cart", "purchase": "purchase"}
# Ledger op per lineitem return flag.
LEDGER_OP = {"A": "DEDUCT", "N": "RESERVE", "R": "ROLLBACK"}
# The fixture's session gap and the total order of its ledger.
SESSION_GAP_SECONDS = 6 * 3600
LEDGER_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _case_map(col: Column, mapping: dict, default) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def _newest(df: DataFrame, ts: str) -> Column:
    return materialize(df.select(F.max(ts).alias("ts")), "newest").scalar()


class Fixtures(Tables):
    """Driver tables plus the commerce views built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)

    # -- scalars ---------------------------------------------------------
    @cached_property
    def as_of(self) -> Column:
        """Newest event time: found once a run and written, so that no plan
        scans the log for it again; each use is a scalar subquery on one row."""
        return _newest(self.events, "ts")

    @cached_property
    def rec_as_of(self) -> Column:
        return _newest(self.lineitem, "l_shipdate")

    # -- behaviour log ---------------------------------------------------
    def _behavior_rows(self, with_errors: bool, with_category: bool = True) -> DataFrame:
        e = self.events
        if not with_errors:
            # on the source column, so it is pushed into the parquet scan
            e = e.where(F.col("event_type").isin(*ACTION_MAP))
        item = F.get_json_object("props", "$.k").cast("bigint")
        ev = e.select("event_id", "user_id", item.alias("item_id"),
                      _case_map(F.col("event_type"), ACTION_MAP, "error").alias("action"),
                      "ts", F.col("value").alias("dwell_time"),
                      F.when(F.col("event_type") == "purchase", F.col("value"))
                       .otherwise(F.lit(0.0)).alias("price"))
        if not with_category:
            return ev
        part = self.part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category_id"))
        return ev.join(part, "item_id", "left").select(
            "event_id", "user_id", "item_id", "category_id", "action", "ts", "dwell_time", "price")

    @cached_property
    def raw_behaviors(self) -> DataFrame:
        """Every event as a behaviour row, ``error`` rows included (monitoring;
        no category, so no join with the catalogue)."""
        return self._behavior_rows(with_errors=True, with_category=False)

    @cached_property
    def behaviors(self) -> DataFrame:
        """Clean behaviour log (no ``error`` rows)."""
        return self._behavior_rows(with_errors=False)

    @cached_property
    def shared_behaviors(self) -> DataFrame:
        """``behaviors`` written once to shared storage, for plans that read the
        log many times: the JSON is parsed and the catalogue joined once."""
        return materialize(self.behaviors, "behaviors")

    @cached_property
    def sessionized(self) -> DataFrame:
        """Clean behaviour log with 6 h gap sessions (``session_id``); only the
        queries that use sessions pay for sessionisation."""
        return sessionize(self.behaviors, gap_seconds=SESSION_GAP_SECONDS)

    # -- dimensions ------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.customer
        return c.select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
            F.col("c_mktsegment").alias("user_segment"),
            (self.as_of - F.make_dt_interval((F.col("c_custkey") % 60).cast("int"))).alias("first_visit"))

    @cached_property
    def items(self) -> DataFrame:
        p = self.part
        return p.select(
            F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category_id"), F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
            (self.as_of - F.make_dt_interval((F.col("p_partkey") % 45).cast("int"))).alias("launch_date"))

    # -- recommendation log ---------------------------------------------
    @cached_property
    def rec_log(self) -> DataFrame:
        l = self.lineitem
        return l.select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("item_id"),
                        F.col("l_shipdate").alias("ts"),
                        (F.col("l_returnflag") == "A").cast("int").alias("clicked"))

    # -- inventory ledger ------------------------------------------------
    @cached_property
    def ledger_ops(self) -> DataFrame:
        """One op per lineitem, without a number; ``ledger_order`` is the order of a sku's ops."""
        l = self.lineitem
        return l.select(
            F.col("l_partkey").alias("sku"), _case_map(F.col("l_returnflag"), LEDGER_OP, "ADD").alias("op"),
            F.col("l_quantity").cast("int").alias("qty"), F.col("l_shipdate").alias("ts"), *LEDGER_ORDER[1:],
            F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint").alias("unit_price_cents"))

    ledger_order = ["ts", *LEDGER_ORDER[1:]]

    @cached_property
    def ledger(self) -> DataFrame:
        """The ops with ``seq``, their position within the sku's history."""
        led = number_within(self.ledger_ops, "sku", month_index("ts"), [F.col(c) for c in self.ledger_order])
        return led.select("sku", "seq", "op", "qty", "ts", F.col("l_orderkey").alias("order_id"), "unit_price_cents")

    @cached_property
    def opening_stock(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("sku"),
                                (F.lit(100) + F.lit(5) * F.col("p_size")).cast("bigint").alias("opening"))
