"""Replay of a hot sku in segments against the fold of whole skus."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlens.operators import inventory as inv

T0 = datetime(2024, 1, 1)
SCHEMA = "sku long, seq long, op string, qty int, ts timestamp_ntz"


def ledger(seed, n=4_000, kinds=("DEDUCT", "RESERVE", "ROLLBACK", "CANCEL", "ADD"), weights=(5, 4, 3, 3, 2)):
    """Sku 1 holds nine tenths of the ops."""
    rng, seqs, rows = random.Random(seed), Counter(), []
    for i in range(n):
        sku = 1 if i % 10 else rng.randrange(2, 30)
        seqs[sku] += 1
        rows.append((sku, seqs[sku], rng.choices(kinds, weights)[0], rng.randrange(1, 30), T0 + timedelta(hours=i)))
    return rows


def fold(rows, opening, strict=True):
    out, state = [], {}
    for sku, seq, op, q, ts in sorted(rows):
        s = state.setdefault(sku, inv.new_stock(opening.get(sku, 0)))
        out.append((sku, seq, op, q, ts, *inv.apply_ops(s, [op], [q], strict)[0]))
    return sorted(out)


@pytest.mark.parametrize("seed,strict,kinds", [(1, True, {}), (2, False, {}), (3, True, {"kinds": ("DEDUCT", "ADD"), "weights": (1, 1)}), (4, True, {"kinds": ("RESERVE", "CANCEL", "ROLLBACK", "DEDUCT"), "weights": (3, 3, 1, 1)})])
def test_segments_equal_the_fold(spark, seed, strict, kinds):
    rows = ledger(seed, **kinds)
    opening = {1: 100, 2: 5, 3: 10 ** 12}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stock = spark.createDataFrame(list(opening.items()), "sku long, opening long")
    want = fold(rows, opening, strict)
    got = inv.replay(df, stock, strict=strict, segment_rows=150)
    assert sorted(tuple(r) for r in got.collect()) == want
    # the hot sku's rows come from many tasks
    share = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in share) < len(rows) / 2
    assert sorted(tuple(r) for r in inv.replay(df, stock, strict=strict).collect()) == want


def test_ops_without_numbers(spark):
    rows = ledger(5)
    df = spark.createDataFrame(rows, SCHEMA).drop("seq").withColumn("other", F.lit(1))
    stock = spark.createDataFrame([(1, 60)], "sku long, opening long")
    for size in (200, 10 ** 9):
        assert sorted(tuple(r) for r in inv.replay(df, stock, order=["ts", "other"], segment_rows=size).collect()) == fold(rows, {1: 60})


def test_a_piece_holds_within_its_bounds():
    rng = random.Random(8)
    for _ in range(60):
        ops = [rng.choice(["DEDUCT", "RESERVE", "CANCEL", "ADD", "ROLLBACK"]) for _ in range(12)]
        quantities = [rng.randrange(1, 9) for _ in ops]
        state, bounds = inv.new_stock(20, 10), [-inv.FAR, inv.FAR, -inv.FAR, inv.FAR]
        decided = [x[0] for x in inv.apply_ops(state, ops, quantities, True, bounds)]
        for a in range(-20, 25):
            for r in range(-10, 15):
                other = inv.new_stock(20 + a, 10 + r)
                same = [x[0] for x in inv.apply_ops(other, ops, quantities)] == decided
                inside = bounds[0] <= a <= bounds[1] and bounds[2] <= r <= bounds[3]
                assert inside == same or not inside
                if inside:
                    assert same and (other[0], other[2]) == (state[0] + a, state[2] + r)


def test_an_undone_op_stays_with_the_op_before(spark):
    """A rollback at the start of a segment needs the decision on its deduct."""
    ops = ["ADD", "DEDUCT", "ROLLBACK", "ROLLBACK", "DEDUCT", "ROLLBACK"] * 40
    rows = [(1, i + 1, op, 3 + i % 5, T0 + timedelta(hours=i)) for i, op in enumerate(ops)]
    df = spark.createDataFrame(rows, SCHEMA)
    stock = spark.createDataFrame([(1, 4)], "sku long, opening long")
    for size in (1, 2, 3, 7):
        assert sorted(tuple(r) for r in inv.replay(df, stock, segment_rows=size).collect()) == fold(rows, {1: 4})


def test_prices_and_orphans_number_in_one_pass(spark):
    rows = ledger(6, 600)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("unit_price_cents", F.col("qty").cast("long") * 10).withColumn("other", F.lit(0))
    for fn in (inv.price_changes, inv.orphan_rollbacks):
        assert sorted(map(str, fn(df.drop("seq"), ["ts", "other"]).collect())) == sorted(map(str, fn(df).collect()))
    plan = inv.price_changes(df.drop("seq"), ["ts", "other"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # the rows (in both branches of the plan, run once), and a row for each bucket twice
