"""Streaming operators against their batch twins (two micro-batches)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from basketlens.operators import features, inventory
from basketlens.sources.fixtures import Fixtures
from basketlens.streaming import streams as st

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_SMALL)


def _two_files(df, cut_col, cut_value):
    d = tempfile.mkdtemp(prefix="basketlens-stream-")
    df.where(F.col(cut_col) < cut_value).coalesce(1).write.mode("overwrite").parquet(f"{d}/part=1")
    df.where(F.col(cut_col) >= cut_value).coalesce(1).write.mode("overwrite").parquet(f"{d}/part=2")
    return d


def _run(spark, stream_df, name):
    ck = tempfile.mkdtemp(prefix="basketlens-ck-")
    q = st.start(stream_df, None, ck, fmt="memory", query_name=name)
    q.awaitTermination()
    return spark.table(name)


def test_window_features_stream_equals_batch(spark, fx):
    b = fx.behaviors.select("event_id", "user_id", "item_id", "action", "ts")
    src = _two_files(b, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
    out = _run(spark, st.window_features(st.with_event_time(stream), "1 hour", "1hour"), "wf_stream")
    batch = st.window_features(b.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "1hour")
    max_ts = b.select(F.max("ts").cast("timestamp")).collect()[0][0]
    closed = batch.where(F.col("timestamp") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    got = {tuple(r) for r in out.select("user_id", "feature_name", "feature_value", "timestamp").collect()}
    exp = {tuple(r) for r in closed.select("user_id", "feature_name", "feature_value", "timestamp").collect()}
    assert got == exp and len(got) > 0


def test_interest_state_equals_batch_twin(spark, fx):
    b = fx.behaviors.select("event_id", "user_id", "item_id", "ts")
    src = _two_files(b, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
    out = _run(spark, st.user_interest_state(st.with_event_time(stream), ttl_hours=None), "interest_stream")
    got = {r.event_id: (r.occurrences, r.interest) for r in out.collect()}
    exp = {r.event_id: (r.occurrences, r.interest) for r in features.instant_interest(fx.behaviors).collect()}
    assert got == exp
    recent = {r.user_id: r.recent_items for r in features.recent_items(fx.behaviors).collect()}
    last = {}
    for r in out.collect():
        if r.user_id not in last or (r.ts, r.event_id) > last[r.user_id][0]:
            last[r.user_id] = ((r.ts, r.event_id), r.recent_items)
    assert {u: [int(x) for x in v[1].split(",")] for u, v in last.items()} == recent
    assert st.refresh_signals(out).count() == sum(1 for v in got.values() if v[1])


def test_ledger_state_equals_replay(spark, fx):
    led = fx.ledger.join(fx.opening_stock, "sku")
    src = _two_files(led, "seq", 10)
    stream = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
    out = _run(spark, st.ledger_state(stream), "ledger_stream")
    got = {(r.sku, r.seq): (r.accepted, r.available_after) for r in out.collect()}
    exp = {(r.sku, r.seq): (r.accepted, r.available_after)
           for r in inventory.replay(fx.ledger, fx.opening_stock).collect()}
    assert got == exp


def test_session_windows_and_timers_run(spark, fx):
    b = fx.behaviors.select("event_id", "user_id", "item_id", "action", "ts")
    src = _two_files(b, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    stream = st.with_event_time(spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1)
                                .parquet(f"{src}/part=*"))
    sess = _run(spark, st.session_windows(stream, "6 hours"), "sess_stream")
    batch = fx.sessionized.groupBy("user_id", "session_id").count().count()
    n = sess.count()
    assert 0 < n <= batch          # sessions still open at the end are not emitted
    ab = _run(spark, st.cart_abandonment(stream, 24.0), "abandon_stream")
    adders = {r.user_id for r in b.where(F.col("action") == "add_to_cart").select("user_id").distinct().collect()}
    assert {r.user_id for r in ab.collect()} <= adders
    act = _run(spark, st.active_users(stream), "active_stream")
    assert act.count() > 0


def test_stream_interval_join_expiry(spark, fx):
    led = fx.ledger.select("sku", "seq", "op", F.col("ts").cast("timestamp").alias("ts"))
    src = _two_files(led, "seq", 10)
    s = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
    s = s.withWatermark("ts", "1 day")
    r = s.where(F.col("op") == "RESERVE")
    d = s.where(F.col("op") == "DEDUCT")
    out = _run(spark, st.expired_reservations_stream(r, d, "1 day"), "expiry_stream")
    batch = {(x.sku, x.seq) for x in inventory.expired_reservations(fx.ledger, 86400).collect()}
    assert {(x.sku, x.seq) for x in out.collect()} <= batch


def test_hourly_counts_stream_and_raw_append(spark, fx):
    b = fx.behaviors.select("event_id", "user_id", "item_id", "action", "ts")
    src = _two_files(b, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    stream = st.with_event_time(spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1)
                                .parquet(f"{src}/part=*"))
    out = _run(spark, st.hourly_action_counts(stream), "hourly_stream")
    batch = st.hourly_action_counts(b.withColumn("ts", F.col("ts").cast("timestamp")))
    max_ts = b.select(F.max("ts").cast("timestamp")).collect()[0][0]
    closed = batch.where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in closed.collect()}
    # Append the raw stream to a dt-partitioned table
    from basketlens.operators.io import append_raw
    dest, ck = tempfile.mkdtemp(prefix="basketlens-raw-"), tempfile.mkdtemp(prefix="basketlens-ck-")
    q = append_raw(stream, dest, ck, trigger={"availableNow": True})
    q.awaitTermination()
    back = spark.read.parquet(dest)
    assert back.count() == b.count() and "dt" in back.columns


def test_unpaid_orders_stream_subset_of_batch(spark, fx):
    from basketlens.operators import cart
    b = fx.behaviors.select("event_id", "user_id", "item_id", "action", "ts")
    src = _two_files(b, "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    s = st.with_event_time(spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1)
                           .parquet(f"{src}/part=*"))
    out = _run(spark, st.unpaid_orders_stream(s.where(F.col("action") == "add_to_cart"),
                                              s.where(F.col("action") == "purchase")), "unpaid_stream")
    starts = b.where(F.col("action") == "add_to_cart").select("event_id", "user_id", "item_id", "ts")
    paid = b.where(F.col("action") == "purchase").select("user_id", "ts")
    batch = {r.event_id for r in cart.unanswered(starts, paid, "user_id", 900).collect()}
    got = {r.event_id for r in out.collect()}
    assert got and got <= batch


def test_interest_state_expires_after_ttl(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1, 5, t0), (2, 1, 5, t0 + timedelta(hours=1)), (3, 1, 5, t0 + timedelta(hours=30)),
            (4, 1, 5, t0 + timedelta(hours=31)), (5, 1, 5, t0 + timedelta(hours=32))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, ts timestamp_ntz")
    src = _two_files(df, "event_id", 3)
    res = {}
    for ttl in (24.0, None):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
        out = _run(spark, st.user_interest_state(st.with_event_time(stream), ttl_hours=ttl),
                   f"ttl_{'none' if ttl is None else int(ttl)}")
        res[ttl] = {r.event_id: r.occurrences for r in out.collect()}
    assert res[24.0] == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}
    assert res[None] == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "user_id long, score double, updated_at long")


def test_upsert_stream_merges_replays_and_fails_on_a_damaged_base(spark):
    import glob
    import os

    src, table, ck = (tempfile.mkdtemp(prefix="basketlens-up-") for _ in range(3))
    table = f"{table}/t"

    def feed(rows):
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint):
        s = spark.readStream.schema("user_id long, score double, updated_at long").parquet(src)
        q = st.upsert_stream(s, table, "user_id", "updated_at", checkpoint)
        q.awaitTermination()
        return q

    feed([(1, 1.0, 10), (2, 2.0, 10)])
    run(ck)
    feed([(2, 5.0, 20), (3, 3.0, 20)])
    run(ck)
    want = {(1, 1.0), (2, 5.0), (3, 3.0)}
    assert {(r.user_id, r.score) for r in st.read_upserted(spark, table).collect()} == want
    # the last epoch again (its commit was lost): the same base, the same result
    last = sorted(glob.glob(f"{ck}/commits/[0-9]*"))[-1]
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run(ck)
    assert {(r.user_id, r.score) for r in st.read_upserted(spark, table).collect()} == want
    # a damaged base fails the batch; nothing is published over it
    newest = sorted(glob.glob(f"{table}/v=*"))[-1]
    for f in glob.glob(f"{newest}/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not parquet")
    for f in glob.glob(f"{newest}/.*.crc"):
        os.remove(f)
    feed([(4, 4.0, 30)])
    with pytest.raises(Exception):
        run(ck)
    assert sorted(glob.glob(f"{table}/v=*/_SUCCESS"))[-1].startswith(newest)


def test_an_epoch_rewrites_only_the_buckets_of_its_keys(spark):
    import glob

    src, table, ck = (tempfile.mkdtemp(prefix="basketlens-up-") for _ in range(3))
    table = f"{table}/t"

    def epoch(rows, schema="user_id long, score double, updated_at long"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = st.upsert_stream(spark.readStream.schema("user_id long, score double, updated_at long, level int").parquet(src), table, "user_id", "updated_at", ck, keep_versions=1, buckets=8)
        q.awaitTermination()

    def written():
        return sorted(glob.glob(f"{sorted(glob.glob(f'{table}/data/e=*'))[-1]}/_bucket=*"))

    want = {i: (float(i), None) for i in range(200)}
    epoch([(i, float(i), 10) for i in range(200)])
    assert len(written()) == 8
    for k in range(3):
        want[5] = (50.0 + k, None)
        epoch([(5, 50.0 + k, 20 + k)])
        assert len(written()) == 1
        assert {r.user_id: (r.score, r.level) for r in st.read_upserted(spark, table).collect()} == want
    # rows that no kept manifest names are gone
    names = [glob.glob(f"{e}/_bucket=*") for e in sorted(glob.glob(f"{table}/data/e=*"))]
    assert [len(x) for x in names] == [7, 1, 1] and len(glob.glob(f"{table}/v=*")) == 2
    # an older update changes nothing, a new column is added
    epoch([(5, 1.0, 1), (300, 3.0, 30)])
    epoch([(7, 7.5, 40, 3)], "user_id long, score double, updated_at long, level int")
    want |= {300: (3.0, None), 7: (7.5, 3)}
    assert {r.user_id: (r.score, r.level) for r in st.read_upserted(spark, table).collect()} == want


def test_distinct_events_and_late_rows(spark, fx):
    b = fx.behaviors.select("event_id", "user_id", "ts")
    twice = b.unionByName(b)
    src = tempfile.mkdtemp(prefix="basketlens-dedup-")
    twice.coalesce(1).write.mode("overwrite").parquet(f"{src}/part=1")
    s = spark.readStream.schema(b.schema).parquet(f"{src}/part=*")
    out = _run(spark, st.distinct_events(s).select("event_id"), "dedup_stream")
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in b.collect())
    assert st.distinct_events(twice).count() == b.count()
    assert st.late_rows([{"stateOperators": [{"numRowsDroppedByWatermark": 2}, {}]}, {}]) == 2
