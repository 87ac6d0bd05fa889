"""Sources and sinks (S1-S12) as format-parameterised DataFrame I/O.

Nothing here collects to the driver: writes go straight from executors to
storage, and upserts are joins, so they scale with the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEHAVIOR_COLUMNS = ("event_id", "user_id", "item_id", "category_id", "action", "ts", "dwell_time",
                    "session_id")

# Schema of the behaviour event stream (S2): ids as strings, epoch seconds.
BEHAVIOR_EVENT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("dwell_time", T.DoubleType()),
])


def read_behaviors(df: DataFrame, dt: str | None = None, dt_col: str = "ts", extra: tuple[str, ...] = ()) -> DataFrame:
    """Project the behaviour columns (and ``extra`` ones); optionally keep one day.

    The day filter is a plain predicate, so on a ``dt``-partitioned table it
    becomes partition pruning and on a file scan a pushed filter."""
    out = df.select(*[c for c in (*BEHAVIOR_COLUMNS, *extra) if c in df.columns])
    if dt is not None:
        out = out.where(F.to_date(F.col(dt_col)) == F.lit(dt).cast("date"))
    return out


def decode_behavior_json(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON event strings -> typed behaviour records; dwell_time defaults
    to 0.0 and the epoch becomes a timestamp (F5)."""
    rec = raw.select(F.from_json(F.col(value_col).cast("string"), BEHAVIOR_EVENT_SCHEMA).alias("r")).select("r.*")
    return (rec.withColumn("dwell_time", F.coalesce("dwell_time", F.lit(0.0)))
               .withColumn("ts", F.timestamp_seconds("timestamp")))


def decode_avro_behavior(raw: DataFrame, schema_json: str, value_col: str = "value") -> DataFrame:
    """S3: Avro messages (user_id, item_id, action, event_timestamp long).
    Needs the spark-avro package in the session; without it Spark refuses the
    call (AVRO_NOT_LOADED_SQL_FUNCTIONS_UNUSABLE)."""
    from pyspark.sql.avro.functions import from_avro

    rec = raw.select(from_avro(F.col(value_col), schema_json).alias("r")).select("r.*")
    return rec.withColumn("ts", F.timestamp_seconds(F.col("event_timestamp")))


def read_feature_source(spark: SparkSession, path: str, ts_col: str = "event_timestamp",
                        created_col: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Feature table with its event time (and optional created time)."""
    df = spark.read.format(fmt).load(path)
    cols = [F.col(ts_col).alias("event_timestamp")]
    if created_col:
        cols.append(F.col(created_col).alias("created"))
    return df.select("*", *cols) if ts_col != "event_timestamp" else df


def labelled_interactions(b: DataFrame, start=None, end=None, n: int | None = None) -> DataFrame:
    """Training entity rows with label = purchase. ``n`` keeps the
    first n by event_id (the reference's LIMIT, made deterministic)."""
    d = b
    if start is not None:
        d = d.where(F.col("ts") >= start)
    if end is not None:
        d = d.where(F.col("ts") <= end)
    d = d.select("event_id", "user_id", "item_id", F.col("ts").alias("event_timestamp"),
                 F.when(F.col("action") == "purchase", 1).otherwise(0).alias("label"))
    if n is not None:
        d = d.orderBy("event_id").limit(n)
    return d


def append_raw(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger=None):
    """Append the decoded stream to the raw table, partitioned by day."""
    w = (stream.withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
               .writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
               .partitionBy("dt").outputMode("append"))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def write_daily(df: DataFrame, path: str, dt: str, fmt: str = "parquet") -> None:
    """Overwrite only the ``dt`` partition (dynamic partition overwrite)."""
    (df.withColumn("dt", F.lit(dt)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("dt").format(fmt).save(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table (e.g. item similarity)."""
    df.write.mode(mode).format(fmt).save(path)


def upsert_latest(base: DataFrame, updates: DataFrame, key: str | list[str],
                  ts: str = "updated_at") -> DataFrame:
    """Per-key upsert. Columns present in ``updates`` replace the base
    value when the update is newer (null means "not supplied"); columns only in
    ``base`` are kept; new keys are inserted. One full outer join, no collect.
    Several updates for one key: the newest wins (``max_by`` per key)."""
    keys = [key] if isinstance(key, str) else list(key)
    upd_cols = [c for c in updates.columns if c not in keys]
    latest = updates.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.col(ts)).alias(c) for c in upd_cols if c != ts],
        F.max(ts).alias(ts))
    u = latest.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in upd_cols])
    j = base.join(u, keys, "full_outer")
    newer = F.col(f"_u_{ts}").isNotNull() & (F.col(ts).isNull() | (F.col(f"_u_{ts}") >= F.col(ts)))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in upd_cols:
            out.append(F.when(newer, F.coalesce(F.col(f"_u_{c}"), F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    for c in upd_cols:
        if c not in base.columns:
            out.append(F.col(f"_u_{c}").alias(c))
    return j.select(*out)


def to_json_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as (key, value) JSON strings, the shape of a topic sink."""
    cols = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def emit(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Write rows to a sink, or append a batch to a stream's input dir."""
    df.write.mode(mode).format(fmt).save(path)
