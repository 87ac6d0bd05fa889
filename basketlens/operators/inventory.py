"""Inventory: stock ledger replay and what is derived from it
(X2, P15, A21, A22, J15, ST8 batch twin).

Accepting or rejecting an op depends on every earlier accept of the same
sku, so the replay is a sequential fold per sku: one streaming pass over
sku-clustered partitions sorted by (sku, order) (``mapInPandas``), with a
handful of integers as state. Different skus run in parallel.

A sku with more than SEGMENT_ROWS ops is cut into segments that are replayed
in parallel. Stock enters an op only through comparisons, so a replay of a
segment from assumed stock also tells for which other stock all its ops would
be decided alike: a range of available and one of reserved quantity, for
which the closing stock is the opening stock moved by the same amounts. Walking
the segments of a sku over these pieces (a few rows a segment) gives the true
stock before each, or the first segment for which no piece is known; such
segments, and those after it from the best guess, are replayed once more.
Every round settles at least one further segment, and all of them once
the stock runs low or high anywhere. At last all segments are replayed from
known stock. An op that undoes the one before stays in its segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import _shuffle_partitions, interval_anti_join, lag_within, month_index

# How long a reservation holds, in seconds.
RESERVATION_TTL_SECONDS = 3600

SEGMENT_ROWS = 100_000   # ops that one task replays of a sku
FAR = 1 << 62            # no bound

OPS_OUT = ["sku", "seq", "op", "qty", "ts"]
REPLAY_SCHEMA = ("sku long, seq long, op string, qty int, ts timestamp_ntz, accepted int, "
                 "available_before long, available_after long, total_after long, reserved_after long")


def new_stock(available: int, reserved: int = 0) -> list:
    """Replay state: available, total, reserved, and of the last op its kind,
    whether it was accepted, and its quantity."""
    return [available, available + reserved, reserved, None, False, 0]


def apply_ops(state: list, ops: list, quantities: list, strict: bool = True, bounds: list | None = None) -> list[tuple]:
    """Advance ``state`` over a sku's ops in order: for each (accepted,
    available before, available, total, reserved). ``bounds`` narrows to the
    least and largest changes of available and of reserved stock at the start
    that leave every decision as it is."""
    avail, total, reserved, prev_op, prev_ok, prev_qty = state
    out = []
    for op, q in zip(ops, quantities):
        before, ok = avail, False
        if op == "DEDUCT" or op == "RESERVE":
            ok = avail >= q
            if bounds is not None:
                if ok:
                    bounds[0] = max(bounds[0], q - avail)
                else:
                    bounds[1] = min(bounds[1], q - avail - 1)
            if ok:
                avail -= q
                if op == "DEDUCT":
                    total -= q
                else:
                    reserved += q
        elif op == "ROLLBACK":
            # strict: restores the previous op's quantity when it was an
            # accepted DEDUCT; that DEDUCT has no other successor, so once
            # only. Not strict: always restores its own quantity.
            ok = not strict or prev_op == "DEDUCT" and prev_ok
            if ok:
                back = prev_qty if strict else q
                avail += back
                total += back
        elif op == "CANCEL":
            ok = reserved >= q
            if bounds is not None:
                if ok:
                    bounds[2] = max(bounds[2], q - reserved)
                else:
                    bounds[3] = min(bounds[3], q - reserved - 1)
            if ok:
                reserved -= q
                avail += q
        elif op == "ADD":
            ok = True
            avail += q
            total += q
        out.append((1 if ok else 0, before, avail, total, reserved))
        prev_op, prev_ok, prev_qty = op, ok, q
    state[:] = avail, total, reserved, prev_op, prev_ok, prev_qty
    return out


def _runs(pdf, keys: list[str]):
    """(start, end) of the runs of equal keys."""
    import numpy as np

    change = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        x = pdf[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    edges = [0, *np.flatnonzero(change).tolist(), len(pdf)]
    return zip(edges[:-1], edges[1:])


def _replay_batches(batches, strict: bool, keys: list[str]):
    """Replay rows sorted by (keys, order); available and reserved stock at
    the start of a key are columns. Rows without a ``seq`` are numbered."""
    import numpy as np
    import pandas as pd

    current, state, seq = None, None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        ops, quantities = pdf["op"].tolist(), pdf["qty"].tolist()
        rows, numbers = [], []
        for start, end in _runs(pdf, keys):
            key = tuple(pdf[k].iloc[start] for k in keys)
            if key != current:
                current, seq = key, 0
                state = new_stock(int(pdf["opening"].iloc[start]), int(pdf["held"].iloc[start]))
            rows += apply_ops(state, ops[start:end], quantities[start:end], strict)
            numbers.append(np.arange(seq + 1, seq + 1 + end - start))
            seq += end - start
        out = pd.DataFrame(rows, columns=["accepted", "available_before", "available_after", "total_after", "reserved_after"], index=pdf.index)
        seqs = pdf["seq"] if "seq" in pdf else pd.Series(np.concatenate(numbers), index=pdf.index, name="seq")
        yield pd.concat([pdf["sku"], seqs, pdf[["op", "qty", "ts"]], out], axis=1)


def _piece_batches(batches, strict: bool):
    """The piece that each (sku, seg) in rows sorted by them gives."""
    import pandas as pd

    current = state = bounds = first = None

    def piece():
        return (*current, *first, state[0], state[2], *bounds)

    for pdf in batches:
        found = []
        ops, quantities = pdf["op"].tolist(), pdf["qty"].tolist()
        for start, end in _runs(pdf, ["sku", "seg"]) if len(pdf) else ():
            key = (int(pdf["sku"].iloc[start]), int(pdf["seg"].iloc[start]))
            if key != current:
                if current is not None:
                    found.append(piece())
                current, bounds, first = key, [-FAR, FAR, -FAR, FAR], (int(pdf["opening"].iloc[start]), int(pdf["held"].iloc[start]))
                state = new_stock(*first)
            apply_ops(state, ops[start:end], quantities[start:end], strict, bounds)
        if found:
            yield pd.DataFrame(found, columns=PIECE_COLUMNS)
    if current is not None:
        yield pd.DataFrame([piece()], columns=PIECE_COLUMNS)


PIECE_COLUMNS = ["sku", "seg", "a_in", "r_in", "a_out", "r_out", "a_least", "a_most", "r_least", "r_most"]
PIECE_SCHEMA = ", ".join(f"{c} long" for c in PIECE_COLUMNS)


def _walk(pdf):
    """Stock before each segment of a sku (one row each), from the pieces
    known: known (the stock is true) and fits (a piece holds for it)."""
    import pandas as pd

    pdf = pdf.sort_values("seg")
    by = {seg: list(g[PIECE_COLUMNS[2:]].itertuples(index=False, name=None)) for seg, g in pdf.groupby("seg")}
    a, r = int(pdf["start"].iloc[0]), 0
    out, known = [], True
    for seg in sorted(by):
        fit = None
        for p in by[seg]:
            if p[4] <= a - p[0] <= p[5] and p[6] <= r - p[1] <= p[7]:
                fit = p
                break
        out.append((int(pdf["sku"].iloc[0]), int(seg), a, r, known, fit is not None))
        p = fit or min(by[seg], key=lambda p: abs(a - p[0]) + abs(r - p[1]))
        known = known and fit is not None
        a, r = p[2] + a - p[0], max(0, p[3] + r - p[1])
        if fit is None:
            a = max(0, a)
    return pd.DataFrame(out, columns=["sku", "seg", "opening", "held", "known", "fits"])


def _segmented(ops: DataFrame, strict: bool, n: int, segment_rows: int) -> DataFrame:
    """Replay of the skus of ``ops`` (sku, seq, op, qty, ts, opening, prev_op)
    in segments."""
    from ..sources.shared import materialize

    undone = (F.col("op") == "ROLLBACK") & (F.col("prev_op") == "DEDUCT")
    at = F.col("seq") - F.when(undone, 2).otherwise(1)
    ops = materialize(ops.withColumn("seg", F.floor(F.greatest(at, F.lit(0)) / segment_rows)).drop("prev_op"), "ledger-segments")
    rows = ops.drop("opening").withColumnRenamed("seg", "_seg")
    start = ops.groupBy("sku").agg(F.max("opening").alias("start"))
    stock = materialize(ops.select("sku", "seg", "opening", F.lit(0).cast("long").alias("held")).distinct(), "ledger-stock")  # a first guess

    def dealt(stock: DataFrame) -> DataFrame:
        s = stock.select(F.col("sku").alias("_sku"), "seg", "opening", "held")
        return (rows.join(s, (F.col("sku") == F.col("_sku")) & (F.col("_seg") == F.col("seg"))).drop("_sku", "_seg")
                .repartition(n, "sku", "seg").sortWithinPartitions("sku", "seg", "seq"))

    pieces = None
    while True:
        made = dealt(stock).select("sku", "seg", "opening", "held", "op", "qty").mapInPandas(lambda b: _piece_batches(b, strict), PIECE_SCHEMA)
        pieces = materialize(made if pieces is None else pieces.unionByName(made), "ledger-pieces")
        walked = materialize(pieces.join(start, "sku").groupBy("sku").applyInPandas(_walk, "sku long, seg long, opening long, held long, known boolean, fits boolean"), "ledger-walk")
        stock = walked.where("NOT fits")
        if stock.isEmpty():
            return dealt(walked).mapInPandas(lambda b: _replay_batches(b, strict, ["sku", "seg"]), REPLAY_SCHEMA)


def replay(ledger: DataFrame, opening: DataFrame, partitions: int | None = None, strict: bool = True, order: list[str] | None = None,
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Replay every sku's ops in ``seq`` order from its opening stock; with
    ``order`` (columns, the first of them ``ts``) the ops have no ``seq`` and are numbered in it.

    DEDUCT n: rejected if available < n, else available -= n, total -= n.
    RESERVE n: rejected if available < n, else available -= n, reserved += n.
    ROLLBACK: accepted only if the previous op (seq - 1) is an accepted
    DEDUCT; restores that op's quantity to available and total.
    CANCEL n: releases a reservation (reserved -= n, available += n).
    ADD n: available += n, total += n.

    ``strict=False`` accepts every ROLLBACK n (available += n, total += n), so
    a rollback can be repeated and its amount isn't checked.

    A sku with more than ``segment_rows`` ops is replayed in segments.
    """
    n = partitions or _shuffle_partitions(ledger.sparkSession)
    by = order or ["seq"]
    zero = F.lit(0).cast("bigint")
    d = (ledger.select("sku", "op", "qty", "ts", *[c for c in by if c != "ts"]).join(opening, "sku", "left")
               .withColumn("opening", F.coalesce(F.col("opening").cast("bigint"), zero)).withColumn("held", zero))
    hot = ledger.groupBy("sku").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > segment_rows) & F.col("sku").isNotNull()).select("sku")
    no_hot = hot.isEmpty()
    cold = d if no_hot else d.join(hot, "sku", "left_anti")
    out = (cold.repartition(n, "sku").sortWithinPartitions("sku", *by).select("sku", *([] if order else ["seq"]), "op", "qty", "ts", "opening", "held")
           .mapInPandas(lambda b: _replay_batches(b, strict, ["sku"]), REPLAY_SCHEMA))
    if no_hot:
        return out
    many = d.drop("held").join(hot, "sku", "left_semi")
    many = lag_within(many, "sku", month_index("ts"), by, {"op": "prev_op"}, number=None if not order else "seq")
    return out.unionByName(_segmented(many.select(*OPS_OUT, "opening", "prev_op"), strict, n, segment_rows))


def balances(replayed: DataFrame) -> DataFrame:
    """Final state per sku (newest op wins, via a partial ``max_by``)."""
    last = replayed.groupBy("sku").agg(
        F.max_by(F.struct("available_after", "total_after", "reserved_after"), F.col("seq")).alias("s"),
        F.count(F.lit(1)).alias("ops"), F.sum("accepted").alias("accepted_ops"))
    return last.select("sku", F.col("s.available_after").alias("available"),
                       F.col("s.total_after").alias("total"), F.col("s.reserved_after").alias("reserved"),
                       "ops", F.col("accepted_ops").cast("bigint").alias("accepted_ops"))


def change_log(replayed: DataFrame) -> DataFrame:
    """One row per op that changed available stock: DEDUCT when it went
    down, ADD when up; quantity = |delta|, with before/after."""
    delta = F.col("available_after") - F.col("available_before")
    return (replayed.where(delta != 0)
                    .select("sku", "seq", "ts", F.when(delta < 0, "DEDUCT").otherwise("ADD").alias("change_type"),
                            F.abs(delta).alias("quantity"), F.col("available_before").alias("before"),
                            F.col("available_after").alias("after")))


def low_stock(bal: DataFrame, threshold: int = 20) -> DataFrame:
    """Alert rows {sku, current, threshold, type}: OUT at 0, else LOW."""
    return (bal.where(F.col("available") <= threshold)
               .select("sku", F.col("available").alias("current"), F.lit(threshold).alias("threshold"),
                       F.when(F.col("available") <= 0, "OUT").otherwise("LOW").alias("alert_type")))


def daily_snapshot(replayed: DataFrame) -> DataFrame:
    """State of every sku at the end of each day it had ops."""
    s = replayed.groupBy("sku", F.to_date("ts").alias("day")).agg(
        F.max_by(F.struct("available_after", "total_after", "reserved_after"), F.col("seq")).alias("s"))
    return s.select("sku", F.col("day").cast("timestamp_ntz").alias("snapshot_day"),
                    F.col("s.available_after").alias("available"), F.col("s.total_after").alias("total"),
                    F.col("s.reserved_after").alias("reserved"))


def _with_previous(ledger: DataFrame, values: dict[str, str], order: list[str] | None) -> DataFrame:
    """Each op with ``seq`` and the previous op's ``values`` (a lag by month
    buckets, so no window over a sku; numbers in the same pass)."""
    if order:
        return lag_within(ledger, "sku", month_index("ts"), order, values, number="seq").withColumn("prev_seq", F.when(F.col("seq") > 1, F.col("seq") - 1))
    return lag_within(ledger, "sku", month_index("ts"), ["seq"], {**values, "seq": "prev_seq"})


def orphan_rollbacks(ledger: DataFrame, order: list[str] | None = None) -> DataFrame:
    """ROLLBACK ops whose original (seq - 1 of the same sku) is missing
    or is not a DEDUCT. With ``order`` the ops have no ``seq`` and are numbered in it."""
    kept = [c for c in order if c != "ts"] if order else ["seq"]
    d = _with_previous(ledger.select("sku", "ts", "op", *kept), {"op": "prev_op"}, order)
    original = (F.col("prev_op") == "DEDUCT") & (F.col("prev_seq") == F.col("seq") - 1)
    return d.where((F.col("op") == "ROLLBACK") & ~F.coalesce(original, F.lit(False))).select("sku", (F.col("seq") - 1).alias("orig_seq"), "seq")


def expired_reservations(ledger: DataFrame, ttl_seconds: int = RESERVATION_TTL_SECONDS) -> DataFrame:
    """ST8 batch twin: RESERVE ops with no DEDUCT of the same sku within
    (reserve time, reserve time + ttl] (time-bucketed interval anti join)."""
    r = ledger.where(F.col("op") == "RESERVE").select("sku", "seq", "ts")
    d = ledger.where(F.col("op") == "DEDUCT").select("sku", "ts")
    out = interval_anti_join(r, d, "sku", ttl_seconds)
    return out.select("sku", "seq", F.col("ts").alias("reserved_at"),
                      (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def price_changes(ledger: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each price point against the previous one of the same sku (with
    ``order``, points have no ``seq`` and are numbered in it), with the change
    amount and the percentage string: HALF_UP to 4 decimals of the ratio,
    times 100, trailing zeros stripped, '%' suffix; 'N/A' when old is 0."""
    kept = [c for c in order if c != "ts"] if order else ["seq"]
    cur = ledger.select("sku", "ts", *kept, F.col("unit_price_cents").alias("new_cents"))
    j = _with_previous(cur, {"new_cents": "old_cents"}, order).where("prev_seq = seq - 1")
    diff = F.col("new_cents") - F.col("old_cents")
    q = diff * 10000
    d = F.col("old_cents")
    # integer HALF_UP of q / d (away from zero at .5)
    mag = F.floor((F.abs(q) * 2 + F.abs(d)) / (F.abs(d) * 2)).cast("bigint")
    q4 = F.when(F.signum(q) * F.signum(d) < 0, -mag).otherwise(mag)
    a = F.abs(q4)
    ip = ((a - F.pmod(a, F.lit(100))) / 100).cast("bigint").cast("string")
    fp = F.pmod(a, F.lit(100))
    frac = (F.when(fp == 0, F.lit(""))
             .when(F.pmod(fp, F.lit(10)) == 0, F.concat(F.lit("."), (fp / 10).cast("bigint").cast("string")))
             .otherwise(F.concat(F.lit("."), F.lpad(fp.cast("string"), 2, "0"))))
    pct = F.concat(F.when(q4 < 0, F.lit("-")).otherwise(F.lit("")), ip, frac, F.lit("%"))
    return j.select("sku", "seq", "ts", (F.col("old_cents") / 100.0).alias("old_price"),
                    (F.col("new_cents") / 100.0).alias("new_price"), (diff / 100.0).alias("change_amount"),
                    F.when(d == 0, F.lit("N/A")).otherwise(pct).alias("change_percentage"))
