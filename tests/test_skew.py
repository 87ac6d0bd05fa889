"""Hot-key inputs: one user holds most rows. The split/bucketed kernels must
give exactly what a naive per-key computation gives."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from basketlens.operators import asof, sequences
from basketlens.operators.sessions import sessionize
from basketlens.operators import similarity as sm

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(1500):
        user = 1 if i % 3 else rnd.randint(2, 20)          # user 1 holds two thirds
        minute = rnd.randint(0, 60 * 24 * 5)
        rows.append((i, user, rnd.randint(1, 40), rnd.choice(["click", "purchase", "impression"]),
                     T0 + timedelta(minutes=minute, seconds=rnd.randint(0, 59))))
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "item_id", "action", "ts"])
    df = spark.createDataFrame(pdf, "event_id long, user_id long, item_id long, action string, ts timestamp_ntz")
    return pdf, df


def test_sessionize_hot_user(hot):
    pdf, df = hot
    got = {r.event_id: r.session_seq for r in sessionize(df, gap_seconds=1800, bucket_seconds=600).collect()}
    exp = {}
    for _, g in pdf.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        seq, prev = 0, None
        for ev, t in zip(g["event_id"], g["ts"]):
            if prev is None or (t - prev).total_seconds() > 1800:
                seq += 1
            exp[ev] = seq
            prev = t
    assert got == exp


def test_bounded_history_hot_user(hot):
    pdf, df = hot
    got = {r.event_id: list(r.h) for r in sequences.bounded_history(
        df, "user_id", "ts", "event_id", "item_id", 9, bucket_seconds=900, out="h").collect()}
    for _, g in pdf.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        items = list(g["item_id"])
        for k, ev in enumerate(g["event_id"]):
            assert got[ev] == items[max(0, k - 9):k + 1]


def test_asof_hot_user(spark, hot):
    pdf, df = hot
    ent = df.where("action = 'purchase'").select("event_id", "user_id", "ts")
    feat = df.where("action = 'click'").select("user_id", df.ts.alias("fts"), df.item_id.alias("clicked"))
    got = {r.event_id: r.clicked for r in asof.asof_join(ent, feat, ["user_id"], "ts", "fts", ["clicked"],
                                                          ttl_seconds=6 * 3600, bucket_seconds=1800).collect()}
    p = pdf[pdf.action == "purchase"].sort_values("ts")
    c = pdf[pdf.action == "click"].rename(columns={"ts": "fts", "item_id": "clicked"}).sort_values("fts")
    m = pd.merge_asof(p, c[["user_id", "fts", "clicked"]], left_on="ts", right_on="fts", by="user_id",
                      allow_exact_matches=True, direction="backward")
    m.loc[(m.ts - m.fts) >= pd.Timedelta(hours=6), "clicked"] = None
    exp = {int(e): (None if pd.isna(v) else int(v)) for e, v in zip(m.event_id, m.clicked)}
    assert got == exp


def test_interval_anti_join_hot_user(hot):
    pdf, df = hot
    starts = df.where("action = 'click'").select("event_id", "user_id", "ts")
    answers = df.where("action = 'purchase'").select("user_id", "ts")
    got = {r.event_id for r in sequences.interval_anti_join(starts, answers, "user_id", 3600).collect()}
    exp = set()
    buys = pdf[pdf.action == "purchase"].groupby("user_id")["ts"].apply(list).to_dict()
    for _, r in pdf[pdf.action == "click"].iterrows():
        if not any(r.ts < t <= r.ts + timedelta(hours=1) for t in buys.get(r.user_id, [])):
            exp.add(r.event_id)
    assert got == exp


def test_cooccurrence_hot_buyer_blocks(hot):
    pdf, df = hot
    small = {tuple(r[:2]): r[2] for r in sm.item_cooccurrence(df, block_items=3).collect()}
    big = {tuple(r[:2]): r[2] for r in sm.item_cooccurrence(df, block_items=1 << 20).collect()}
    assert small == big and len(small) > 0


def test_session_counts_match_sessionize(hot):
    from basketlens.operators.sessions import session_counts
    pdf, df = hot
    for gap, bucket in ((1800, 600), (6 * 3600, 3600)):
        got = {r.user_id: r.total_sessions for r in session_counts(df, gap_seconds=gap, bucket_seconds=bucket).collect()}
        s = sessionize(df, gap_seconds=gap, bucket_seconds=bucket)
        exact = {r.user_id: r["count"] for r in s.select("user_id", "session_id").distinct().groupBy("user_id").count().collect()}
        assert got == exact


@pytest.fixture(scope="module")
def dense(spark):
    """One user holds nine tenths of the rows, most of them within one hour of one day."""
    rnd = random.Random(5)
    rows = []
    for i in range(2000):
        user = 1 if i % 10 else rnd.randint(2, 9)
        at = timedelta(hours=30, microseconds=rnd.randrange(3_600_000_000)) if i % 5 else timedelta(minutes=rnd.randrange(60 * 24 * 4))
        rows.append((i, user, rnd.randint(1, 9), rnd.choice(["click", "purchase"]), T0 + at))
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "item_id", "action", "ts"])
    return pdf, spark.createDataFrame(pdf, "event_id long, user_id long, item_id long, action string, ts timestamp_ntz")


LIMIT = 60


def test_no_bucket_is_larger_than_the_limit(dense):
    pdf, df = dense
    (one,) = sequences.time_buckets([(df, "ts")], ["user_id"], 86400, limit=LIMIT)
    sizes = one.groupBy("user_id", "_b").count().collect()
    assert max(r["count"] for r in sizes) <= LIMIT and sum(r["count"] for r in sizes) == len(pdf)
    assert max(pdf[pdf.user_id == 1].groupby(pdf.ts.dt.date).size()) > 10 * LIMIT      # what a fixed day would hold
    rows = sorted(((r.user_id, r.ts, r["_b"]) for r in one.select("user_id", "ts", "_b").collect()))
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])           # buckets follow time
    a, b = sequences.time_buckets([(df.where("action = 'click'"), "ts"), (df.where("action = 'purchase'"), "ts")], ["user_id"], 86400, limit=LIMIT)
    both = {(r.event_id, r["_b"]) for x in (a, b) for r in x.collect()}
    assert both == {(r.event_id, r["_b"]) for r in one.collect()}                      # the same for all frames
    few = sequences.time_buckets([(df, "ts")], ["user_id"], 86400)[0].select("_b").distinct().count()
    assert few == 4


def test_kernels_with_cut_buckets(dense, monkeypatch):
    pdf, df = dense
    kernels = {
        "sessions": lambda: {r.event_id: r.session_seq for r in sessionize(df, gap_seconds=60).collect()},
        "history": lambda: {r.event_id: list(r.h) for r in sequences.bounded_history(df, "user_id", "ts", "event_id", "item_id", 9, out="h").collect()},
        "asof": lambda: {r.event_id: (r.item_id, r.clicked) for r in asof.asof_join(
            df.where("action = 'purchase'"), df.where("action = 'click'").select("user_id", df.ts.alias("fts"), df.event_id.alias("clicked"), df.event_id.alias("made")),
            ["user_id"], "ts", "fts", ["clicked"], ttl_seconds=3600, created="made").collect()}}
    whole = {k: f() for k, f in kernels.items()}
    monkeypatch.setattr(sequences, "BUCKET_ROWS", LIMIT)
    assert {k: f() for k, f in kernels.items()} == whole
    assert len(whole["sessions"]) == len(pdf) and any(x[1] is not None for x in whole["asof"].values())


def test_rows_at_one_moment_stay_together(spark):
    df = spark.createDataFrame([(1, T0)] * 50 + [(None, T0 + timedelta(microseconds=3))] * 40, "user_id long, ts timestamp_ntz")
    (one,) = sequences.time_buckets([(df, "ts")], ["user_id"], 86400, limit=20)
    assert sorted(r["count"] for r in one.groupBy("user_id", "_b").count().collect()) == [40, 50]
