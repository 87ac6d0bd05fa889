"""Sessionisation where no session id exists (W12 / ST9 batch twin).

A plain ``lag`` over ``Window.partitionBy(user)`` puts every event of a user
in one task; a bot or shared account holding a third of the log would then
serialise the whole job. Here the per-user timeline is cut into time buckets
(``time_buckets``: finer where a user is dense): gaps are found inside each (user, bucket) partition, and only a
one-row-per-(user, bucket) summary is ordered per user to stitch sessions
across bucket edges. The per-user window therefore sees at most
``time span / bucket`` rows regardless of how many events the user has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import key_concat
from .sequences import _micros, time_buckets


def sessionize(df: DataFrame, key: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
               gap_seconds: int = 6 * 3600, bucket_seconds: int = 3600) -> DataFrame:
    """Add ``session_seq`` (1-based per key) and ``session_id`` = ``key:seq``.

    A new session starts when the gap to the key's previous event is strictly
    greater than ``gap_seconds`` (a gap exactly equal continues the session).
    """
    gap = gap_seconds * 1_000_000
    d = time_buckets([(df, ts)], [key], bucket_seconds)[0].withColumn("_t", _micros(ts))
    w = Window.partitionBy(key, "_b").orderBy("_t", tiebreak)
    d = (d.withColumn("_prev", F.lag("_t").over(w))
          .withColumn("_start", F.when(F.col("_t") - F.col("_prev") > gap, 1).otherwise(0))
          .withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    summary = d.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"),
                                       F.sum("_start").alias("_n_int"))
    wb = Window.partitionBy(key).orderBy("_b")
    summary = (summary
               .withColumn("_prev_last", F.lag("_last").over(wb))
               .withColumn("_first_new", F.when(F.col("_prev_last").isNull()
                                                | (F.col("_first") - F.col("_prev_last") > gap), 1)
                           .otherwise(0))
               .withColumn("_offset", F.coalesce(
                   F.sum(F.col("_first_new") + F.col("_n_int"))
                    .over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select(key, "_b", "_first_new", "_offset"))
    out = (d.join(summary, [key, "_b"])
            .withColumn("session_seq", (F.col("_offset") + F.col("_first_new") + F.col("_run")).cast("bigint"))
            .withColumn("session_id", key_concat(key, "session_seq")))
    return out.drop("_t", "_b", "_prev", "_start", "_run", "_first_new", "_offset")


def session_counts(df: DataFrame, key: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                   gap_seconds: int = 6 * 3600, bucket_seconds: int = 3600) -> DataFrame:
    """Sessions per key from the per-(key, bucket) gap summary alone (the same
    rule as ``sessionize``), without joining session ids back to the events."""
    gap = gap_seconds * 1_000_000
    d = time_buckets([(df, ts)], [key], bucket_seconds)[0].withColumn("_t", _micros(ts))
    w = Window.partitionBy(key, "_b").orderBy("_t", tiebreak)
    d = d.withColumn("_start", F.when(F.col("_t") - F.lag("_t").over(w) > gap, 1).otherwise(0))
    summary = d.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"),
                                       F.sum("_start").alias("_n_int"))
    wb = Window.partitionBy(key).orderBy("_b")
    starts = F.when(F.lag("_last").over(wb).isNull() | (F.col("_first") - F.lag("_last").over(wb) > gap), 1) \
        .otherwise(0) + F.col("_n_int")
    return (summary.withColumn("_s", starts).groupBy(key)
                   .agg(F.sum("_s").cast("bigint").alias("total_sessions")))
