"""Structured Streaming operators (ST1-ST11).

Every windowed operator is a plain function of a DataFrame, so the same code
runs on a batch DataFrame (its batch twin) and on a streaming one. Streaming
adds an explicit event-time watermark (default 10 minutes); rows later than
the watermark are dropped by Spark's state eviction. Keyed state uses
``applyInPandasWithState`` with event-time timeouts; state lives in the
checkpointed state store, not in an external cache.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.inventory import apply_ops
from ..operators.io import BEHAVIOR_EVENT_SCHEMA, decode_behavior_json

DEFAULT_WATERMARK = "10 minutes"


def read_behavior_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """A behaviour event stream from files appended to ``path``
    (parquet rows with the behaviour columns, or JSON lines)."""
    r = spark.readStream.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path)
    if fmt == "text":
        return decode_behavior_json(df, "value")
    return df


def with_event_time(df: DataFrame, ts: str = "ts", watermark: str | None = DEFAULT_WATERMARK) -> DataFrame:
    """Event time as ``timestamp`` (watermarks need it) plus the watermark."""
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return d.withWatermark(ts, watermark) if (watermark and df.isStreaming) else d


def window_features(df: DataFrame, window: str = "5 minutes", label: str = "5min") -> DataFrame:
    """ST1/ST2: per (user, tumbling window) clicks, add-to-carts, purchases and
    ctr = purchases / clicks (only when clicks > 0), in long form
    ``{feature}_{label}`` with the window end as timestamp."""
    g = df.groupBy("user_id", F.window("ts", window).alias("w")).agg(
        F.count(F.when(F.col("action") == "click", True)).alias("clicks"),
        F.count(F.when(F.col("action") == "add_to_cart", True)).alias("add_to_cart"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("purchases"))
    feats = F.array(
        F.struct(F.lit(f"click_count_{label}").alias("name"), F.col("clicks").cast("double").alias("value")),
        F.struct(F.lit(f"add_to_cart_count_{label}").alias("name"), F.col("add_to_cart").cast("double").alias("value")),
        F.struct(F.lit(f"purchase_count_{label}").alias("name"), F.col("purchases").cast("double").alias("value")),
        F.when(F.col("clicks") > 0, F.struct(F.lit(f"ctr_{label}").alias("name"),
                                              (F.col("purchases") / F.col("clicks")).alias("value"))))
    return (g.select("user_id", F.col("w.end").alias("timestamp"), F.explode(feats).alias("f"))
             .where(F.col("f").isNotNull())
             .select("user_id", F.col("f.name").alias("feature_name"), F.col("f.value").alias("feature_value"),
                     "timestamp", F.lit(label).alias("window")))


def hourly_action_counts(df: DataFrame) -> DataFrame:
    """ST4: per user, action and hour bucket, the number of events."""
    return (df.groupBy("user_id", "action", F.window("ts", "1 hour").alias("w"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("user_id", "action", F.col("w.start").alias("hour"), "n"))


def active_users(df: DataFrame, approx: bool = True) -> DataFrame:
    """ST6: sliding 5-minute active users (sketch in streams)."""
    agg = F.approx_count_distinct("user_id") if approx else F.countDistinct("user_id")
    return (df.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(agg.alias("active_users"))
              .select(F.col("w.start").alias("window_start"), "active_users"))


def session_windows(df: DataFrame, gap: str = "6 hours") -> DataFrame:
    """ST9: gap sessions with ``session_window`` (batch and append stream)."""
    return (df.groupBy("user_id", F.session_window("ts", gap).alias("s"))
              .agg(F.count(F.lit(1)).alias("events"))
              .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                      "events"))


# -- ST3 / ST5: keyed user state ------------------------------------------
INTEREST_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("occurrences", T.LongType()), T.StructField("interest", T.BooleanType()),
    T.StructField("recent_items", T.StringType())])
INTEREST_STATE = T.StructType([T.StructField("recent", T.StringType()), T.StructField("seq", T.StringType()),
                               T.StructField("last_ms", T.LongType())])


def _in_time_order(pdfs, columns: list[str], by: tuple[str, ...] = ("ts", "event_id")):
    """Rows of one key's micro-batch in order. Spark hands them over unsorted,
    so the needed columns (only) are held; a micro-batch is as large as the
    source's trigger limit allows (``max_files_per_trigger``)."""
    parts = [pdf[columns] for pdf in pdfs]
    whole = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return whole.sort_values(list(by), kind="mergesort").itertuples(index=False, name=None)


def _interest_fn(window_events: int, min_count: int, seq_len: int, ttl_ms: int | None, timeout_on: bool):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        recent: list[int] = []
        seq: list[str] = []
        last_ms = None
        if state.exists:
            r, s, last_ms = state.get
            recent = [int(x) for x in r.split(",") if x]
            seq = [x for x in s.split(",") if x]
        rows = []
        last_ts = None
        for ev, uid, item, ts in _in_time_order(pdfs, ["event_id", "user_id", "item_id", "ts"]):
            now_ms = int(pd.Timestamp(ts).value // 1_000_000)
            if ttl_ms is not None and last_ms is not None and now_ms - last_ms > ttl_ms:
                recent, seq = [], []             # the user's state expired before this event
            last_ms = now_ms
            recent.insert(0, int(item))          # newest first, duplicates kept
            del recent[window_events:]
            member = f"{pd.Timestamp(ts).value}:{int(item)}"
            if member not in seq:                # sorted-set member collapses
                seq.append(member)
                seq.sort()
                del seq[:-seq_len]
            occ = recent.count(int(item))
            rows.append((int(ev), int(uid), int(item), ts, occ, occ >= min_count,
                         ",".join(str(x) for x in recent)))
            last_ts = ts
        state.update((",".join(str(x) for x in recent), ",".join(seq), last_ms))
        if timeout_on and last_ts is not None:
            state.setTimeoutTimestamp(int(pd.Timestamp(last_ts).value // 1_000_000) + ttl_ms)
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in INTEREST_OUT.fields])
    return fn


def user_interest_state(df: DataFrame, window_events: int = 10, min_count: int = 3, seq_len: int = 50,
                        ttl_hours: float | None = 24.0) -> DataFrame:
    """ST3: per-user keyed state: last-10 items (newest first), last-50
    (ts:item) sequence, instant-interest flag per event; state expires
    ``ttl_hours`` of event time after the user's last event (None: never)."""
    d = df.select("event_id", "user_id", "item_id", "ts")
    ttl_ms = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    timeout = GroupStateTimeout.EventTimeTimeout if (ttl_ms is not None and df.isStreaming) \
        else GroupStateTimeout.NoTimeout
    return d.groupBy("user_id").applyInPandasWithState(
        _interest_fn(window_events, min_count, seq_len, ttl_ms, timeout != GroupStateTimeout.NoTimeout),
        INTEREST_OUT, INTEREST_STATE, "append", timeout)


def refresh_signals(interest: DataFrame) -> DataFrame:
    """ST5: a refresh message (JSON) for every event that raised interest."""
    hits = interest.where(F.col("interest"))
    return hits.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(
        F.col("user_id"), F.col("item_id"), F.lit("instant_interest").alias("reason"), F.col("ts"))).alias("value"))


# -- ST8: reservation expiry -------------------------------------------------
def expired_reservations_stream(reserves: DataFrame, deducts: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """ST8: stream-stream left outer interval join; a reservation with no
    DEDUCT of the same sku within ``ttl`` is emitted (null side) once the
    watermark passes its expiry."""
    r = reserves.select("sku", "seq", F.col("ts").alias("reserved_at"))
    d = deducts.select(F.col("sku").alias("d_sku"), F.col("ts").alias("d_ts"))
    cond = F.expr(f"sku = d_sku AND d_ts > reserved_at AND d_ts <= reserved_at + INTERVAL {ttl}")
    j = r.join(d, cond, "leftOuter")
    return j.where(F.col("d_ts").isNull()).select("sku", "seq", "reserved_at")


# -- ST10: cart abandonment timer -------------------------------------------
ABANDON_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("last_add", T.TimestampType()),
                            T.StructField("status", T.StringType())])
ABANDON_STATE = T.StructType([T.StructField("last_add_ms", T.LongType())])


def cart_abandonment(df: DataFrame, threshold_hours: float = 24.0) -> DataFrame:
    """ST10: per user, an add-to-cart arms an event-time timer; a purchase
    disarms it; when the watermark passes the timer the cart is emitted as
    abandoned (batch twin: A33)."""
    thr = int(threshold_hours * 3_600_000)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            (last_ms,) = state.get
            state.remove()
            yield pd.DataFrame([(int(key[0]), pd.Timestamp(last_ms, unit="ms"), "abandoned")],
                               columns=["user_id", "last_add", "status"])
            return
        last_ms = state.get[0] if state.exists else None
        # only the latest add and the latest purchase matter: one pass, no sort, nothing held
        latest = {"add_to_cart": None, "purchase": None}
        for pdf in pdfs:
            for action, ts in pdf.groupby("action")["ts"].max().items():
                if action in latest and (latest[action] is None or ts > latest[action]):
                    latest[action] = ts
        added, paid = latest["add_to_cart"], latest["purchase"]
        if paid is not None:
            last_ms = None
        if added is not None and (paid is None or added > paid):
            last_ms = int(pd.Timestamp(added).value // 1_000_000)
        if last_ms is None:
            if state.exists:
                state.remove()
        else:
            state.update((last_ms,))
            state.setTimeoutTimestamp(last_ms + thr)
        return
        yield  # pragma: no cover

    d = df.where(F.col("action").isin("add_to_cart", "purchase")).select("user_id", "action", "ts")
    return d.groupBy("user_id").applyInPandasWithState(fn, ABANDON_OUT, ABANDON_STATE, "append",
                                                       GroupStateTimeout.EventTimeTimeout)


# -- ST11: inventory change events from a ledger stream -------------------------
LEDGER_OUT = T.StructType([T.StructField("sku", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("op", T.StringType()), T.StructField("accepted", T.IntegerType()),
                           T.StructField("available_before", T.LongType()),
                           T.StructField("available_after", T.LongType())])
LEDGER_STATE = T.StructType([T.StructField("avail", T.LongType()), T.StructField("total", T.LongType()),
                             T.StructField("reserved", T.LongType()), T.StructField("prev_op", T.StringType()),
                             T.StructField("prev_ok", T.BooleanType()), T.StructField("prev_qty", T.LongType())])


def ledger_state(df: DataFrame) -> DataFrame:
    """ST11: the X2 replay as keyed streaming state per sku (ops of a sku
    must arrive in seq order across micro-batches)."""
    def fn(key, pdfs, state):
        ops = list(_in_time_order(pdfs, ["seq", "op", "qty", "opening"], by=("seq",)))
        if state.exists:
            avail, total, reserved, prev_op, prev_ok, prev_qty = state.get
        else:
            avail = total = int(ops[0][3])
            reserved, prev_op, prev_ok, prev_qty = 0, None, False, 0
        stock = [avail, total, reserved, prev_op, prev_ok, prev_qty]
        done = apply_ops(stock, [o[1] for o in ops], [int(o[2]) for o in ops])
        rows = [(int(key[0]), int(o[0]), o[1], d[0], d[1], d[2]) for o, d in zip(ops, done)]
        avail, total, reserved, prev_op, prev_ok, prev_qty = stock
        state.update((avail, total, reserved, prev_op, prev_ok, prev_qty))
        yield pd.DataFrame(rows, columns=[f.name for f in LEDGER_OUT.fields])

    d = df.select("sku", "seq", "op", "qty", "opening")
    return d.groupBy("sku").applyInPandasWithState(fn, LEDGER_OUT, LEDGER_STATE, "append",
                                                   GroupStateTimeout.NoTimeout)


def start(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet", mode: str = "append",
          available_now: bool = True, query_name: str | None = None, foreach_batch=None):
    """Start a streaming write (file/JSON sink or ``foreachBatch``)
    with a checkpoint, optionally as an ``availableNow`` run."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    elif fmt == "memory":
        w = w.format("memory")
    else:
        w = w.format(fmt).option("path", sink)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


# -- S9: upserted tables --------------------------------------------------------
# <table>/data/e=<epoch>/_bucket=<n>/   rows of the buckets that an epoch rewrote
# <table>/v=<epoch>/                    its manifest: the epoch of every bucket's rows
UPSERT_BUCKETS = 64


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, name: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` in a folder."""
    root, fs = _path(spark, name)
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def _published(spark: SparkSession, table_path: str) -> list[int]:
    """Versions whose manifest has been committed (Spark's _SUCCESS marker)."""
    def done(v: int) -> bool:
        path, fs = _path(spark, f"{table_path}/v={v:012d}/_SUCCESS")
        return fs.exists(path)
    return [v for v in _listed(spark, table_path, "v=") if done(v)]


def _manifest(spark: SparkSession, table_path: str, version: int) -> dict[int, tuple[int, int]]:
    """{bucket: (epoch of its rows, buckets of the table)}; at most a row a bucket."""
    return {r["bucket"]: (r["epoch"], r["buckets"]) for r in spark.read.parquet(f"{table_path}/v={version:012d}").collect()}


def _rows(spark: SparkSession, table_path: str, current: dict[int, tuple[int, int]]) -> DataFrame | None:
    paths = [f"{table_path}/data/e={epoch:012d}/_bucket={bucket}" for bucket, (epoch, _) in sorted(current.items())]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def read_upserted(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The newest published version of an upserted table (of those before an
    epoch); None if there is none. A damaged version raises."""
    versions = [v for v in _published(spark, table_path) if before is None or v < before]
    return _rows(spark, table_path, _manifest(spark, table_path, versions[-1])) if versions else None


def upsert_stream(df: DataFrame, table_path: str, key: str, ts: str, checkpoint: str, keep_versions: int = 2, buckets: int = UPSERT_BUCKETS):
    """S9 for streams: the table is dealt into ``buckets`` by a hash of the
    key (a table keeps the number it began with). Each micro-batch is merged
    (full outer) with the rows of the buckets that hold its keys, as published
    before its epoch, and only those are written anew; then the epoch's
    manifest, which names the rows of every bucket, is published. A replayed
    epoch starts from the same manifest and rewrites its own rows, so the sink
    is idempotent; a base that can't be read fails the batch. Versions beyond
    the last ``keep_versions`` are removed, with the rows that only they name."""
    from ..operators.io import upsert_latest

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        versions = [v for v in _published(spark, table_path) if v < epoch]
        current = _manifest(spark, table_path, versions[-1]) if versions else {}
        n = next(iter(current.values()))[1] if current else buckets
        of = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        batch = batch.persist()
        try:
            touched = {r["b"] for r in batch.select(of.alias("b")).distinct().collect()}  # buckets at most
            if touched:
                base = _rows(spark, table_path, {b: x for b, x in current.items() if b in touched})
                out = upsert_latest(batch.limit(0) if base is None else base, batch, key, ts)
                (out.withColumn("_bucket", of).repartition(len(touched), "_bucket").write.mode("overwrite")
                 .option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(f"{table_path}/data/e={epoch:012d}"))
        finally:
            batch.unpersist()
        current = {**current, **{b: (epoch, n) for b in touched}}
        rows = [(b, e, n) for b, (e, _) in sorted(current.items())]
        spark.createDataFrame(rows, "bucket int, epoch long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{table_path}/v={epoch:012d}")
        _clean(spark, table_path, epoch, keep_versions)

    return start(df, table_path, checkpoint, foreach_batch=merge)


def _clean(spark: SparkSession, table_path: str, epoch: int, keep_versions: int) -> None:
    """Remove old manifests, and bucket rows of earlier epochs that no kept one names."""
    old = [v for v in _published(spark, table_path) if v < epoch]
    gone, kept = old[:-keep_versions] if keep_versions else old, [*(old[-keep_versions:] if keep_versions else []), epoch]
    if not gone:
        return
    named = {(e, b) for v in kept for b, (e, _) in _manifest(spark, table_path, v).items()}
    for v in gone:
        path, fs = _path(spark, f"{table_path}/v={v:012d}")
        fs.delete(path, True)
    for e in (e for e in _listed(spark, f"{table_path}/data", "e=") if e < epoch):
        folder = f"{table_path}/data/e={e:012d}"
        rest = [b for b in _listed(spark, folder, "_bucket=") if (e, b) in named]
        for name in [f"{folder}/_bucket={b}" for b in _listed(spark, folder, "_bucket=") if b not in rest] if rest else [folder]:
            path, fs = _path(spark, name)
            fs.delete(path, True)


def distinct_events(df: DataFrame, id_col: str = "event_id", ts: str = "ts", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Each event once: repeats of an id that arrive within the watermark
    are dropped (``dropDuplicatesWithinWatermark``; the state keeps an id no
    longer than that). On a batch: one row for each id."""
    if not df.isStreaming:
        return df.dropDuplicates([id_col])
    return with_event_time(df, ts, watermark).dropDuplicatesWithinWatermark([id_col])


def late_rows(progress) -> int:
    """Rows that a query's stateful operators dropped as later than the
    watermark, from its ``recentProgress``."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))


def unpaid_orders_stream(orders: DataFrame, payments: DataFrame, timeout: str = "15 minutes") -> DataFrame:
    """J19 streaming form: orders (add_to_cart) with no payment (purchase) of
    the same user within ``timeout``: a stream-stream left outer interval
    join, emitted once the watermark passes the deadline."""
    o = orders.select("event_id", "user_id", F.col("ts").alias("created_at"))
    p = payments.select(F.col("user_id").alias("p_user"), F.col("ts").alias("paid_at"))
    cond = F.expr(f"user_id = p_user AND paid_at > created_at AND paid_at <= created_at + INTERVAL {timeout}")
    return o.join(p, cond, "leftOuter").where(F.col("paid_at").isNull()).select("event_id", "user_id", "created_at")
