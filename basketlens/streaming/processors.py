"""Keyed stream operators on ``transformWithStateInPandas`` (ST3, ST10, ST11).

State lives in the state store (RocksDB, checkpointed), a key's rows never
pass through memory together: a frame of a micro-batch is worked on or put
away as it comes.

* ``interest`` orders a user's events by event time, across micro-batches too:
  events wait in map state by minute until the watermark has passed the
  minute, then a minute's events are taken in order. What a user did expires
  ``ttl_hours`` of event time after the last event, by a timer.
* ``ledger_changes`` applies a sku's ops strictly in ``seq`` order: an op that
  comes early waits in map state for the ones before it. Opening stock is
  initial state, from a batch.
* ``abandoned_carts`` keeps the last add of a user and an event-time timer.

The session needs ``spark.sql.streaming.stateStore.providerClass`` set to
RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.inventory import apply_ops, new_stock

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_MS = 60_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


# -- ST3 ----------------------------------------------------------------------
INTEREST_SCHEMA = "event_id long, user_id long, item_id long, ts timestamp, occurrences long, interest boolean, recent_items string"


class Interest(StatefulProcessor):
    """Last items of a user (newest first) and whether an event's item occurs
    ``min_count`` times among them."""

    def __init__(self, window_events: int, min_count: int, ttl_ms: int | None):
        self.window_events, self.min_count, self.ttl_ms = window_events, min_count, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "item long")
        self.last = handle.getValueState("last", "ms long")
        self.chunks = handle.getValueState("chunks", "n long")
        self.waiting = handle.getMapState("waiting", "minute long, chunk long", "event_ids array<long>, items array<long>, micros array<long>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A row a user: recent_items (comma-joined, newest first) and last_ts."""
        row = initialState.iloc[0]
        self.recent.put([(int(x),) for x in str(row["recent_items"]).split(",") if x][: self.window_events])
        self.last.update((int(_ms(initialState["last_ts"]).iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk = self.chunks.get()[0] if self.chunks.exists() else 0
        first = None
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            for minute, part in pdf.assign(_us=micros).groupby(micros // (MINUTE_MS * 1000)):
                chunk += 1
                self.waiting.updateValue((int(minute), chunk), ([int(x) for x in part["event_id"]], [int(x) for x in part["item_id"]], [int(x) for x in part["_us"]]))
                first = int(minute) if first is None else min(first, int(minute))
        self.chunks.update((chunk,))
        if first is not None:
            self.handle.registerTimer((first + 1) * MINUTE_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        minutes: dict[int, list[int]] = {}
        for minute, chunk in self.waiting.keys():
            minutes.setdefault(minute, []).append(chunk)
        for minute in sorted(m for m in minutes if (m + 1) * MINUTE_MS <= passed):
            yield self._minute(key, minute, minutes.pop(minute))
        if minutes:
            self.handle.registerTimer((min(minutes) + 1) * MINUTE_MS)
            return
        if self.ttl_ms is not None and self.last.exists():
            end = self.last.get()[0] + self.ttl_ms
            if end <= passed:
                for state in (self.recent, self.last, self.chunks):
                    state.clear()
            else:
                self.handle.registerTimer(end)

    def _minute(self, key, minute: int, chunks: list[int]) -> pd.DataFrame:
        events = []
        for chunk in chunks:
            ids, items, micros = self.waiting.getValue((minute, chunk))
            events += zip(micros, ids, items)
            self.waiting.removeKey((minute, chunk))
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for us, event, item in sorted(events):
            if self.ttl_ms is not None and last is not None and us // 1000 - last > self.ttl_ms:
                recent = []
            last = us // 1000
            recent = [item, *recent][: self.window_events]
            n = recent.count(item)
            out.append((event, int(key[0]), item, pd.Timestamp(us, unit="us"), n, n >= self.min_count, ",".join(map(str, recent))))
        self.recent.put([(x,) for x in recent])
        self.last.update((last,))
        return pd.DataFrame(out, columns=["event_id", "user_id", "item_id", "ts", "occurrences", "interest", "recent_items"])

    def close(self) -> None:
        pass


def interest(events: DataFrame, window_events: int = 10, min_count: int = 3, ttl_hours: float | None = 24.0, initial: DataFrame | None = None) -> DataFrame:
    """ST3 in event-time order: ``events`` (event_id, user_id, item_id, ts) with
    a watermark on ``ts``; ``initial`` (user_id, recent_items, last_ts) is where users start."""
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    start = None if initial is None else initial.select("user_id", "recent_items", "last_ts").groupBy("user_id")
    return events.select("event_id", "user_id", "item_id", "ts").groupBy("user_id").transformWithStateInPandas(
        Interest(window_events, min_count, ttl), outputStructType=INTEREST_SCHEMA, outputMode="append", timeMode="eventTime", initialState=start)


# -- ST10 ---------------------------------------------------------------------
class Carts(StatefulProcessor):
    """The last add of a user that no purchase has followed."""

    def __init__(self, threshold_ms: int):
        self.threshold_ms = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.added = handle.getValueState("added", "ms long")
        self.paid = handle.getValueState("paid", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = {"add_to_cart": self.added.get()[0] if self.added.exists() else None, "purchase": self.paid.get()[0] if self.paid.exists() else None}
        for pdf in rows:
            for action, ms in _ms(pdf["ts"]).groupby(pdf["action"]).max().items():
                newest[action] = int(ms) if newest.get(action) is None else max(newest[action], int(ms))
        added, paid = newest["add_to_cart"], newest["purchase"]
        if paid is not None:
            self.paid.update((paid,))
        if added is not None and (paid is None or added > paid):
            self.added.update((added,))
            self.handle.registerTimer(added + self.threshold_ms)
        elif self.added.exists():
            self.added.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an earlier add finds a later one, or none
        if self.added.exists() and self.added.get()[0] + self.threshold_ms <= expiredTimerInfo.getExpiryTimeInMs():
            added = self.added.get()[0]
            self.added.clear()
            yield pd.DataFrame({"user_id": [int(key[0])], "last_add": [pd.Timestamp(added, unit="ms")], "status": ["abandoned"]})

    def close(self) -> None:
        pass


def abandoned_carts(events: DataFrame, threshold_hours: float = 24.0) -> DataFrame:
    """ST10: carts (user_id, last_add, status) whose last add no purchase has
    followed when the watermark passes it by the threshold."""
    d = events.where(F.col("action").isin("add_to_cart", "purchase")).select("user_id", "action", "ts")
    return d.groupBy("user_id").transformWithStateInPandas(Carts(int(threshold_hours * 3_600_000)), outputStructType="user_id long, last_add timestamp, status string",
                                                           outputMode="append", timeMode="eventTime")


# -- ST11 ---------------------------------------------------------------------
class Ledger(StatefulProcessor):
    """Stock of a sku, and ops that wait for the ones before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "next long, available long, total long, reserved long, prev_op string, prev_ok boolean, prev_qty long")
        self.early = handle.getMapState("early", "seq long", "op string, qty long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.stock.update((1, *new_stock(int(initialState["opening"].iloc[0]))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, *state = self.stock.get() if self.stock.exists() else (1, *new_stock(0))
        state = list(state)
        for pdf in rows:
            out = []
            ops = list(zip(pdf["seq"].tolist(), pdf["op"].tolist(), pdf["qty"].tolist()))
            heapq.heapify(ops)
            while True:
                if ops and ops[0][0] <= due:
                    seq, op, q = heapq.heappop(ops)
                    if seq < due:
                        continue  # a repeat
                elif self.early.containsKey((due,)):
                    seq, (op, q) = due, self.early.getValue((due,))
                    self.early.removeKey((due,))
                else:
                    break
                ok, before, after, *_ = apply_ops(state, [op], [int(q)])[0]
                out.append((int(key[0]), seq, op, ok, before, after))
                due += 1
            for seq, op, q in ops:
                self.early.updateValue((int(seq),), (op, int(q)))
            if out:
                yield pd.DataFrame(out, columns=["sku", "seq", "op", "accepted", "available_before", "available_after"])
        self.stock.update((due, *state))

    def close(self) -> None:
        pass


def ledger_changes(ops: DataFrame, opening: DataFrame) -> DataFrame:
    """ST11: the X2 replay of a stream of ``ops`` (sku, seq, op, qty) in ``seq``
    order from 1, in whatever order they arrive; ``opening`` (sku, opening)
    is a batch. Ops wait until all before them have come; repeats are ignored."""
    return ops.select("sku", "seq", "op", "qty").groupBy("sku").transformWithStateInPandas(
        Ledger(), outputStructType="sku long, seq long, op string, accepted int, available_before long, available_after long",
        outputMode="append", timeMode="none", initialState=opening.select("sku", "opening").groupBy("sku"))
