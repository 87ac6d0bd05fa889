"""Keyed state processors against their batch twins, over several micro-batches and restarts."""

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlens.operators import inventory, sequences
from basketlens.streaming import processors as pr

from .test_ledger import SCHEMA, ledger

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    pr.use_rocksdb(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


class Feed:
    """A stream of files, run to the end of what is there; each run is a restart from the checkpoint."""

    def __init__(self, spark, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.src, self.out, self.checkpoint = (tempfile.mkdtemp(prefix="basketlens-tws-") for _ in range(3))

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)
        s = self.make(self.spark.readStream.schema(self.schema).parquet(self.src))
        s.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(self.out).collect()


def test_ledger_in_any_order_of_arrival(spark):
    rows = ledger(3, 500)
    opening = spark.createDataFrame([(1, 100), (2, 5)], "sku long, opening long")
    want = sorted((r.sku, r.seq, r.op, r.accepted, r.available_before, r.available_after) for r in inventory.replay(spark.createDataFrame(rows, SCHEMA), opening).collect())
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    feed = Feed(spark, SCHEMA, lambda s: pr.ledger_changes(s, opening))
    first = feed.run(mixed[:250])
    assert 0 < len(first) < 250                              # ops after a gap wait
    got = feed.run(mixed[250:] + mixed[:40])                 # and repeats change nothing
    assert sorted(tuple(r) for r in got) == want


def events(seed, n=400):
    rng = random.Random(seed)
    at = T0
    rows = []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 7, 400]))
        rows.append((i, 1 if i % 4 else rng.randrange(2, 6), rng.randrange(4), at))
    return rows


EVENTS = "event_id long, user_id long, item_id long, ts timestamp"


def test_interest_in_event_time_order(spark):
    rows = events(2)
    df = spark.createDataFrame(rows, EVENTS)
    h = sequences.bounded_history(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "user_id", "ts", "event_id", "item_id", 9, out="h")
    want = {r.event_id: ",".join(map(str, reversed(r.h))) for r in h.collect()}
    feed = Feed(spark, EVENTS, lambda s: pr.interest(s.withWatermark("ts", "3 hours"), ttl_hours=None))
    late = rows[:200]
    random.Random(5).shuffle(late)                            # disorder within a micro-batch and, below, across them
    feed.run([r for r in late if r[0] % 5 or r[0] < 150])
    feed.run([r for r in late if not (r[0] % 5 or r[0] < 150)] + rows[200:])
    got = feed.run([(10_000, 99, 1, rows[-1][3] + timedelta(days=2)), (10_001, 99, 1, rows[-1][3] + timedelta(days=2))])
    found = {r.event_id: r.recent_items for r in got if r.user_id != 99}
    assert found == want
    assert all(r.interest == (r.occurrences >= 3) and r.occurrences == Counter(r.recent_items.split(","))[str(r.item_id)] for r in got)


def test_interest_starts_from_a_batch_and_expires(spark):
    start = spark.createDataFrame([(1, "7,7", T0)], "user_id long, recent_items string, last_ts timestamp")
    feed = Feed(spark, EVENTS, lambda s: pr.interest(s.withWatermark("ts", "1 minute"), ttl_hours=1, initial=start))
    feed.run([(1, 1, 7, T0 + timedelta(minutes=10)), (2, 2, 7, T0 + timedelta(minutes=11))])
    feed.run([(3, 9, 0, T0 + timedelta(hours=5))])            # the watermark passes user 1's hour
    got = feed.run([(4, 1, 7, T0 + timedelta(hours=5, minutes=1)), (5, 9, 0, T0 + timedelta(hours=9))])
    got = {r.event_id: (r.recent_items, r.interest) for r in feed.run([(6, 9, 0, T0 + timedelta(hours=19))])}
    assert got[1] == ("7,7,7", True) and got[2] == ("7", False) and got[4] == ("7", False)


def test_carts_are_abandoned_by_event_time(spark):
    schema = "user_id long, action string, ts timestamp"
    feed = Feed(spark, schema, lambda s: pr.abandoned_carts(s.withWatermark("ts", "10 minutes"), 24))
    h = timedelta(hours=1)
    feed.run([(1, "add_to_cart", T0), (2, "add_to_cart", T0), (2, "purchase", T0 + h), (3, "add_to_cart", T0 + 2 * h)])
    feed.run([(1, "add_to_cart", T0 + 5 * h), (4, "click", T0 + 5 * h), (4, "add_to_cart", T0 + 40 * h)])
    got = feed.run([(5, "add_to_cart", T0 + 41 * h)])
    assert sorted((r.user_id, r.last_add, r.status) for r in got) == [(1, T0 + 5 * h, "abandoned"), (3, T0 + 2 * h, "abandoned")]
