"""Hand-made micro fixtures per operator (FIXTURES.md section 4)."""

import hashlib
import math
import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from basketlens.functions import exprs as ex
from basketlens.operators import asof, catalog, features, inventory, metrics, ml, recommend, sequences
from basketlens.operators import similarity as sm
from basketlens.operators.io import upsert_latest

T0 = datetime(2024, 1, 1, 0, 0, 0)


def ts(minutes):
    return T0 + timedelta(minutes=minutes)


def beh(spark, rows):
    """rows: (event_id, user_id, item_id, action, minutes[, category, dwell])"""
    full = [(r[0], r[1], r[2], r[3], ts(r[4]), r[5] if len(r) > 5 else "C", r[6] if len(r) > 6 else 1.0,
             0.0) for r in rows]
    return spark.createDataFrame(
        full, "event_id long, user_id long, item_id long, action string, ts timestamp_ntz, category_id string, "
              "dwell_time double, price double")


def test_cooccurrence_matches_combinations(spark):
    # user 1 buys a three times and b once; user 2 buys only c; user 3 buys b, d
    rows = [(1, 1, 10, "purchase", 1), (2, 1, 10, "purchase", 2), (3, 1, 10, "purchase", 3),
            (4, 1, 11, "purchase", 4), (5, 2, 12, "purchase", 5), (6, 3, 11, "purchase", 6),
            (7, 3, 13, "purchase", 7), (8, 3, 13, "click", 8)]
    b = beh(spark, rows)
    got = {(r.item_i, r.item_j): r.cooccurrence for r in sm.item_cooccurrence(b, block_items=1).collect()}
    brute = {}
    for u in (1, 2, 3):
        items = sorted(r[2] for r in rows if r[1] == u and r[3] == "purchase")
        for p in combinations(items, 2):
            brute[p] = brute.get(p, 0) + 1
    assert got == brute
    assert got[(10, 10)] == 3  # self pairs m*(m-1)/2


def test_cooccurrence_block_salting_is_exact(spark):
    rows = [(i, 1, i % 17, "purchase", i) for i in range(60)] + [(100 + i, 2, i % 5, "purchase", i) for i in range(9)]
    b = beh(spark, rows)
    one = {tuple(r[:2]): r[2] for r in sm.item_cooccurrence(b, block_items=10_000).collect()}
    many = {tuple(r[:2]): r[2] for r in sm.item_cooccurrence(b, block_items=3).collect()}
    assert one == many


def test_similarity_symmetric_and_bounded(spark):
    rows = [(i, u, it, "purchase", i) for i, (u, it) in enumerate([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3)])]
    sim = sm.item_similarity(sm.item_cooccurrence(beh(spark, rows))).collect()
    assert all(0 <= r.similarity <= 1 for r in sim)
    left = {(r.item_i, r.item_j) for r in sm.item_similarity_left(sm.item_cooccurrence(beh(spark, rows))).collect()}
    # item 3 never appears on the left, so the reference form drops (2, 3)
    assert (2, 3) in {(r.item_i, r.item_j) for r in sim} and (2, 3) not in left


def test_sessionize_gap_rules_and_buckets(spark):
    gap = 6 * 60
    # user 1: 0, +6h exactly (same session), +6h1m (new); user 2 single event
    rows = [(1, 1, 1, "click", 0), (2, 1, 1, "click", gap), (3, 1, 1, "click", 2 * gap + 1), (4, 2, 1, "click", 5)]
    from basketlens.operators.sessions import sessionize
    for bucket in (60, 3600, 86400):
        out = {r.event_id: r.session_seq for r in sessionize(beh(spark, rows), bucket_seconds=bucket).collect()}
        assert out == {1: 1, 2: 1, 3: 2, 4: 1}


def test_bounded_history_matches_naive(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(1, 3), rnd.randint(1, 4), "click", rnd.randint(0, 5000)) for i in range(300)]
    b = beh(spark, rows)
    got = {r.event_id: list(r.h) for r in
           sequences.bounded_history(b, "user_id", "ts", "event_id", "item_id", 4, bucket_seconds=3600, out="h")
           .collect()}
    for u in (1, 2, 3):
        seq = sorted([r for r in rows if r[1] == u], key=lambda r: (r[4], r[0]))
        for k, r in enumerate(seq):
            assert got[r[0]] == [x[2] for x in seq[max(0, k - 4):k + 1]]


def test_instant_interest_third_occurrence(spark):
    # item 7 at positions 1, 5, 10 -> interest at the 10th; at 1, 5, 11 -> the window lost the first
    items = [7, 1, 2, 3, 7, 4, 5, 6, 8, 7, 7]
    rows = [(i, 1, it, "click", i) for i, it in enumerate(items)]
    out = {r.event_id: r.interest for r in features.instant_interest(beh(spark, rows)).collect()}
    assert out[9] is True
    assert out[10] is True   # last 10 = positions 1..10 hold 7 at 4, 9, 10


def test_global_rank_matches_sql_rank(spark):
    vals = [(i, float(v)) for i, v in enumerate([5, 3, 3, 9, 1, 5, 5, 2])]
    df = spark.createDataFrame(vals, "id long, v double")
    got = {r.id: r.rk for r in sequences.global_rank(df, "v", out="rk", partitions=3).collect()}
    srt = sorted(v for _, v in vals)
    assert got == {i: srt.index(v) + 1 for i, v in vals}


@pytest.mark.parametrize("reuse,adaptive", [("true", "true"), ("false", "true"), ("false", "false")])
def test_global_rank_does_not_depend_on_the_plan(spark, reuse, adaptive):
    """Every price of lineitem: the same as SQL rank(), whether or not Spark reuses the range exchange."""
    import duckdb
    path = "/root/testdata/sf0.1/lineitem.parquet"
    want = duckdb.sql(f"SELECT l_extendedprice AS p, min(r) AS r FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS r FROM '{path}') GROUP BY 1").df()
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.read.parquet(path).select(F.col("l_extendedprice").alias("p"))
        got = sequences.global_rank(df, "p", out="rk").groupBy("p").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi")).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    both = want.merge(got, on="p", how="outer")
    assert len(both) == len(want) and (both.lo == both.r).all() and (both.hi == both.r).all()


def test_category_tree_is_as_deep_as_the_data_and_refuses_loops(spark):
    chain = [(i, f"c{i}", i - 1 if i else None) for i in range(25)]
    schema = "category_id long, name string, parent_id long"
    out = {r.category_id: r.level for r in catalog.category_tree(spark.createDataFrame(chain, schema)).collect()}
    assert out == {i: i + 1 for i in range(25)}
    with pytest.raises(Exception, match="loop"):
        catalog.category_tree(spark.createDataFrame([(1, "a", None), (2, "b", 1), (1, "a", 2)], schema))


def test_category_loops_and_orphans_are_reported(spark):
    schema = "category_id long, name string, parent_id long"
    rows = [(1, "root", None), (2, "a", 1), (3, "b", 4), (4, "c", 3), (5, "d", 3), (6, "e", 99), (7, "f", 6), (8, "self", 8), (None, "g", 1), (9, None, 2)]
    out = {r.category_id: (r.level, r.path, r.status) for r in catalog.category_ancestry(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: (1, "root", "ok"), 2: (2, "root > a", "ok"), 3: (None, None, "loop"), 4: (None, None, "loop"), 5: (None, None, "loop"), 6: (None, None, "orphan"),
                   7: (None, None, "orphan"), 8: (None, None, "loop"), None: (None, None, "orphan"), 9: (3, "root > a", "ok")}
    with pytest.raises(Exception, match="loop at"):
        catalog.category_tree(spark.createDataFrame(rows, schema)).collect()
    assert catalog.category_ancestry(spark.createDataFrame([], schema)).count() == 0


def test_a_deep_category_chain_takes_few_rounds(spark, monkeypatch):
    from basketlens.sources import shared
    chain = [(i, f"c{i}", i - 1 if i else None) for i in range(1000)]
    real, rounds = shared.materialize, []
    monkeypatch.setattr(shared, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    out = catalog.category_ancestry(spark.createDataFrame(chain, "category_id long, name string, parent_id long").repartition(3))
    last = out.where("category_id = 999").first()
    assert last.level == 1000 and last.path.startswith("c0 > c1 > ") and last.path.endswith("c999") and len(rounds) <= 11


def test_number_and_lag_within_equal_plain_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(40), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r.id: (r.s, r.p) for r in df.withColumn("s", F.row_number().over(w)).withColumn("p", F.lag("v").over(w)).collect()}
    bucket = F.floor(F.col("t") / 7)
    got_n = {r.id: r.s for r in sequences.number_within(df, "k", bucket, [F.col("t"), F.col("id")], out="s").collect()}
    got_l = {r.id: r.p for r in sequences.lag_within(df, "k", bucket, ["t", "id"], {"v": "p"}).collect()}
    assert {i: (got_n[i], got_l[i]) for i in want} == want


def test_interval_anti_join_equals_brute_force(spark):
    import datetime as dt
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    s = [(rng.choice([1, 1, 1, 2, None]), t0 + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(300)]
    a = [(rng.choice([1, 2, 2, None]), t0 + dt.timedelta(seconds=rng.randrange(4000))) for _ in range(25)]
    out = sequences.interval_anti_join(spark.createDataFrame(s, "k long, ts timestamp_ntz, id long"), spark.createDataFrame(a, "k long, ts timestamp_ntz"), "k", 300)
    assert out.columns == ["k", "ts", "id"]
    want = {i for k, t, i in s if not any(k is not None and k == ak and t < at <= t + dt.timedelta(seconds=300) for ak, at in a)}
    assert {r.id for r in out.collect()} == want


def test_md5_mod_matches_python(spark):
    keys = [f"{u}:ranking_model_v2" for u in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r.h for r in df.select(ex.md5_mod(F.col("k"), 100).alias("h")).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 100 for k in keys]


def test_two_sided_p_matches_erfc(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 2.5, 3.3, 5.0, 7.9]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.p for r in df.select(ex.two_sided_p(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got):
        assert abs(p - math.erfc(z / math.sqrt(2))) < 2e-7


def test_asof_join_edge_cases(spark):
    e = spark.createDataFrame([(1, 1, ts(100)), (2, 1, ts(50)), (3, 2, ts(10))],
                              "eid long, k long, t timestamp_ntz")
    f = spark.createDataFrame([
        (1, ts(100), 1, 10.0),   # equal timestamp: used
        (1, ts(100), 2, 11.0),   # same ts, later created wins
        (1, ts(50 - 30), 1, 5.0),  # exactly TTL (30 min) before entity 2: excluded
        (2, ts(11), 1, 7.0),     # after the entity: never used
    ], "k long, ft timestamp_ntz, created long, v double")
    out = {r.eid: r.v for r in asof.asof_join(e, f, ["k"], "t", "ft", ["v"], ttl_seconds=1800, created="created",
                                                bucket_seconds=600).collect()}
    assert out == {1: 11.0, 2: None, 3: None}


def test_replay_cases(spark):
    led = spark.createDataFrame([
        (1, 1, "DEDUCT", 20, ts(1)),    # insufficient (opening 10)
        (1, 2, "DEDUCT", 4, ts(2)),     # ok -> 6
        (1, 3, "ROLLBACK", 0, ts(3)),   # restores 4 -> 10
        (1, 4, "ROLLBACK", 0, ts(4)),   # previous op is a rollback -> rejected
        (1, 5, "RESERVE", 7, ts(5)),    # ok -> 3, reserved 7
        (1, 6, "DEDUCT", 3, ts(6)),     # remainder -> 0
        (2, 1, "ROLLBACK", 0, ts(1)),   # no original -> rejected
    ], "sku long, seq long, op string, qty int, ts timestamp_ntz")
    opening = spark.createDataFrame([(1, 10), (2, 5)], "sku long, opening long")
    r = {(x.sku, x.seq): (x.accepted, x.available_after) for x in inventory.replay(led, opening).collect()}
    assert r == {(1, 1): (0, 10), (1, 2): (1, 6), (1, 3): (1, 10), (1, 4): (0, 10), (1, 5): (1, 3),
                 (1, 6): (1, 0), (2, 1): (0, 5)}


def test_price_change_formatting(spark):
    led = spark.createDataFrame([
        (1, 1, 0), (1, 2, 100),          # old 0 -> N/A
        (2, 1, 300), (2, 2, 400),        # +33.333..% -> 33.33%
        (3, 1, 1000), (3, 2, 1200),      # 20% (trailing zeros stripped)
        (4, 1, 30000), (4, 2, 30001),    # 0.00333% -> 0.0033 ratio half-up 4dp = 0.0000 -> 0%
        (5, 1, 8), (5, 2, 7),            # -12.5%
    ], "sku long, seq long, unit_price_cents long").withColumn("ts", F.lit(T0))
    got = {r.sku: r.change_percentage for r in inventory.price_changes(led).collect()}
    assert got == {1: "N/A", 2: "33.33%", 3: "20%", 4: "0%", 5: "-12.5%"}


def test_typed_values(spark):
    df = spark.createDataFrame([("12",), ("1.50",), ("abc",), ("",)], "raw string")
    got = [(r.kind, r.int_val, r.dbl_val, r.str_val) for r in ml.typed_values(df).collect()]
    assert got == [("int", 12, None, None), ("float", None, 1.5, None), ("string", None, None, "abc"),
                   ("string", None, None, "")]


def test_product_validation_rules(spark):
    df = spark.createDataFrame([
        (1, "ok", "d", 10.0, 1, "c"), (2, "  ", "d", 10.0, 1, "c"), (3, "x" * 101, "d", 0.001, -1, None),
    ], "id long, name string, description string, price double, stock long, category_id string")
    got = {r.id: r.reasons for r in catalog.validate_products(df).collect()}
    assert got[1] == ""
    assert got[2] == "name_blank"
    assert got[3] == "name_too_long,price_below_min,price_digits,stock_negative,category_missing"


def test_alert_islands(spark):
    w = spark.createDataFrame([(i, 1.0 if i in (1, 2, 4, 6, 7, 8) else 0.0) for i in range(10)],
                              "window_idx long, ratio double")
    out = sorted((r.n_windows,) for r in metrics.alert_islands(w, F.col("ratio") > 0.5, 2, 3600).collect())
    assert out == [(2,), (3,)]


def test_mmr_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    cats = ["AAA1", "AAA2", "BBB", "", "CCC"]
    rows = [(u, i, round(rnd.random(), 3), rnd.choice(cats)) for u in range(1, 4) for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, score double, category_id string")

    def sim(a, b):
        if a == b:
            return 0.8
        if a and b and a[:3] == b[:3]:
            return 0.5
        return 0.1

    for lam in (0.3, 0.5, 0.7):
        for engine in ("pandas", "native"):
            got = {}
            for r in recommend.mmr_rerank(df, lam, engine=engine).collect():
                got.setdefault(r.user_id, []).append((r.mmr_rank, r.item_id))
            for u in range(1, 4):
                cands = sorted([(s, i, c) for uu, i, s, c in rows if uu == u], key=lambda x: (-x[0], x[1]))
                sel, rest = [cands[0]], cands[1:]
                while len(sel) < min(50, len(cands)) and rest:
                    best, bm = None, -float("inf")
                    for c in rest:
                        m = lam * c[0] - (1 - lam) * max(sim(c[2], s[2]) for s in sel)
                        if m > bm:
                            bm, best = m, c
                    sel.append(best)
                    rest.remove(best)
                assert [i for _, i in sorted(got[u])] == [c[1] for c in sel], (lam, engine, u)


def test_assign_variants_draft_is_control(spark):
    from basketlens.operators import experiments as exps
    users = spark.range(0, 300).withColumnRenamed("id", "user_id")
    a = exps.assign_variants(users, spark)
    cold = a.where(F.col("experiment_id") == "cold_start_strategy").select("variant").distinct().collect()
    assert [r.variant for r in cold] == ["control"]
    shares = {r.variant: r["count"] for r in
              a.where(F.col("experiment_id") == "diversity_strategy").groupBy("variant").count().collect()}
    assert set(shares) == {"control", "treatment_a", "treatment_b"}
    for v, w in (("control", 33), ("treatment_a", 33), ("treatment_b", 34)):
        p = w / 100
        assert abs(shares[v] - 300 * p) < 4 * math.sqrt(300 * p * (1 - p))


def test_significance_guards(spark):
    from basketlens.operators import experiments as exps
    res = spark.createDataFrame([
        ("e", "control", "m", 0, 0.0), ("e", "t", "m", 10, 0.2),            # zero exposures in control
        ("f", "control", "m", 100, 0.0), ("f", "t", "m", 100, 0.0),         # se 0
        ("g", "control", "m", 100, 2.0), ("g", "t", "m", 100, 3.0),         # pooled p > 1
    ], "experiment_id string, variant string, metric string, exposures long, value double")
    out = {r.experiment_id: (r.z_score, r.p_value, r.is_significant, r.lift)
           for r in exps.significance(res).collect()}
    assert out["e"][:3] == (0.0, 1.0, False)
    assert out["f"] == (0.0, 1.0, False, 0.0)
    assert out["g"][:3] == (0.0, 1.0, False) and out["g"][3] == 0.5


def test_upsert_partial_columns(spark):
    base = spark.createDataFrame([(1, 5, 2.0, T0), (2, 1, 9.0, T0)], "k long, a long, b double, updated_at timestamp_ntz")
    upd = spark.createDataFrame([(1, 7, ts(5)), (3, 1, ts(5))], "k long, a long, updated_at timestamp_ntz")
    out = {r.k: (r.a, r.b) for r in upsert_latest(base, upd, "k").collect()}
    assert out == {1: (7, 2.0), 2: (1, 9.0), 3: (1, None)}


def test_category_tree_levels(spark):
    cats = spark.createDataFrame([(1, "root", None), (2, "mid", 1), (3, "leaf", 2), (9, "orphan", 99)],
                                 "category_id long, name string, parent_id long")
    out = {r.category_id: (r.level, r.path) for r in catalog.category_tree(cats).collect()}
    assert out == {1: (1, "root"), 2: (2, "root > mid"), 3: (3, "root > mid > leaf")}


def test_auc_rank_matches_pairwise(spark):
    rows = [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (0.4, 0), (0.9, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    auc = ml.auc_rank(df).collect()[0].auc
    pos = [s for s, l in rows if l == 1]
    neg = [s for s, l in rows if l == 0]
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert abs(auc - pairs / (len(pos) * len(neg))) < 1e-12


def _recalled(spark):
    rng = random.Random(8)
    users = spark.createDataFrame([(u if u < 30 else None,) for u in range(31)] + [(3,)], "user_id long")
    recalled = spark.createDataFrame([(rng.choice([*range(34), None]), rng.choice([*range(40), None]), rng.choice([1, 3])) for _ in range(400)], "user_id long, item_id long, path int")
    popular = spark.createDataFrame([(i,) for i in range(0, 24, 2)], "item_id long")
    out = spark.createDataFrame([(rng.randrange(30), rng.randrange(40)) for _ in range(80)], "user_id long, item_id long")
    return users, recalled, popular, out


def test_merged_candidates_are_those_of_the_union(spark):
    users, recalled, popular, out = _recalled(spark)
    known = users.where("user_id IS NOT NULL")
    paths = [recalled.join(known.distinct(), "user_id", "left_semi"), recommend.recall_popular(known, popular)]
    want = sorted(map(tuple, recommend.recall_candidates(paths, out).select("user_id", "item_id", "path").collect()), key=str)
    got = recommend.merge_popular(known, paths[0], popular, out).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_columns_of_items_and_users_come_with_the_candidates(spark):
    users, recalled, popular, out = _recalled(spark)
    items = spark.createDataFrame([(i, f"c{i}") for i in range(0, 40, 3)] + [(6, "again"), (7, "a"), (7, "b"), (None, "no")], "item_id long, cat string")
    lam = spark.createDataFrame([(u, u / 2) for u in range(0, 40, 2)] + [(4, 9.0)], "user_id long, lam double")
    plain = recommend.merge_popular(users, recalled, popular, out)
    want = plain.join(items, "item_id", "left").join(lam, "user_id", "left").select("user_id", "item_id", "path", "cat", "lam")
    got = recommend.merge_popular(users, recalled, popular, out, of_items=items, of_users=lam).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tasks_of_users_are_bounded(spark, monkeypatch):
    import __spark_entry__ as entry
    from .conftest import SF_SMALL
    monkeypatch.setattr(recommend, "USERS_PER_TASK", 10)
    users = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert users > 80 and recommend.user_parts(spark.range(users)) == -(-users // 10)
    for name in ("recommend", "impressions"):
        plan = entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(xxhash64\(user_id#\d+L, 42\), {-(-users // 10)}\), REPARTITION_BY_NUM", plan[plan.index("MapInPandas"):]), name


def test_reasons_are_the_same_with_frequent_items(spark):
    recs = spark.createDataFrame([(u, i) for u in range(20) for i in (1, 2, 3, u)] + [(None, 1), (2, None)], "user_id long, item_id long")
    recent = spark.createDataFrame([(u, [u]) for u in range(0, 20, 3)], "user_id long, recent_items array<long>")
    stats = spark.createDataFrame([(i, i / 20) for i in range(12)], "item_id long, purchase_rate double")
    frequent = spark.createDataFrame([(1,), (3,), (3,), (77,)], "item_id long")
    want = sorted(map(str, recommend.with_reasons(recs, recent, stats).collect()))
    got = recommend.with_reasons(recs, recent, stats, frequent).select("item_id", "user_id", "reason")
    assert sorted(map(str, got.collect())) == sorted(map(str, recommend.with_reasons(recs, recent, stats).select(*got.columns).collect())) and len(want) == 82


def test_every_user_is_ranked_once_with_repeated_customers(spark, tmp_path):
    import shutil
    import __spark_entry__ as entry
    sf = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", sf, copy_function=shutil.copyfile)
    (tmp_path / "sf").chmod(0o755)
    users = spark.read.parquet(f"{sf}/customer.parquet").toPandas()
    spark.createDataFrame(users).union(spark.createDataFrame(users[:15])).toPandas().to_parquet(f"{sf}/customer.parquet")
    rows = entry.queries()["recommend"](spark, sf).groupBy("user_id", "mmr_rank").count().toPandas()
    assert (rows["count"] == 1).all() and len(rows) == 20 * len(users)
