"""Sources/sinks round trips, status audit, model version, ML jobs."""

import json

import pytest
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from basketlens.operators import catalog, ml
from basketlens.operators import io as bio
from basketlens.sources.fixtures import Fixtures

from .conftest import SF_SMALL

T0 = datetime(2024, 1, 1)


def test_decode_behavior_json_defaults(spark):
    raw = spark.createDataFrame([(json.dumps({"user_id": "u1", "item_id": "i1", "action": "click",
                                              "timestamp": 1704067200.5, "session_id": "s", "page_url": "/"}),),
                                 (json.dumps({"user_id": "u2", "item_id": "i2", "action": "purchase",
                                              "timestamp": 1704067201.0, "dwell_time": 3.5}),)], "value string")
    rows = {r.user_id: (r.dwell_time, r.ts) for r in bio.decode_behavior_json(raw).collect()}
    assert rows["u1"][0] == 0.0 and rows["u2"][0] == 3.5
    assert rows["u1"][1].replace(tzinfo=None) == datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_write_daily_overwrites_one_partition(spark):
    d = tempfile.mkdtemp(prefix="basketlens-daily-")
    df1 = spark.createDataFrame([(1, 1.0)], "user_id long, v double")
    bio.write_daily(df1, d, "2024-01-01")
    bio.write_daily(df1.withColumn("v", F.lit(2.0)), d, "2024-01-02")
    bio.write_daily(df1.withColumn("v", F.lit(3.0)), d, "2024-01-02")
    got = {(str(r.dt), r.v) for r in spark.read.parquet(d).collect()}
    assert got == {("2024-01-01", 1.0), ("2024-01-02", 3.0)}


def test_feature_source_and_write_table(spark):
    d = tempfile.mkdtemp(prefix="basketlens-feat-")
    df = spark.createDataFrame([(1, T0, T0)], "user_id long, ts timestamp_ntz, created timestamp_ntz")
    bio.write_table(df, d)
    back = bio.read_feature_source(spark, d, ts_col="ts", created_col="created")
    assert set(back.columns) >= {"event_timestamp", "created", "user_id"}


def test_emit_json_rows(spark):
    d = tempfile.mkdtemp(prefix="basketlens-emit-")
    df = spark.createDataFrame([(1, "x")], "user_id long, item string")
    bio.emit(bio.to_json_rows(df, key="user_id"), d)
    rows = spark.read.json(d).collect()
    assert json.loads(rows[0].value) == {"user_id": 1, "item": "x"}


def test_order_status_audit(spark):
    ev = spark.createDataFrame([
        (1, 1, "CREATED"), (1, 2, "PAID"), (1, 3, "SHIPPED"), (1, 4, "COMPLETED"),
        (2, 1, "CREATED"), (2, 2, "SHIPPED"), (3, 1, "PAID")], "order_id long, seq long, status string"
    ).withColumn("ts", F.lit(T0))
    got = {(r.order_id, r.seq): r.valid for r in catalog.order_status_audit(ev).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): True, (2, 1): True, (2, 2): False,
                   (3, 1): False}


def test_latest_version(spark):
    m = spark.createDataFrame([("ctr", "v1"), ("ctr", "v10"), ("ctr", "v2"), ("als", "a")], "model_name string, version string")
    assert {r.model_name: r.latest_version for r in catalog.latest_version(m).collect()} == {"ctr": "v2", "als": "a"}


def test_gbt_grid_search_and_permutation_importance(spark):
    from basketlens.operators import asof
    from basketlens.operators.io import labelled_interactions
    from basketlens.plans.store_queries import _views
    fx = Fixtures(spark, SF_SMALL)
    pit = asof.historical_features(labelled_interactions(fx.behaviors), _views(fx))
    d = ml.hash_split(pit.join(fx.items.select("item_id", "category_id"), "item_id", "left"), "event_id")
    feats = ["u_clicks", "u_purchases", "i_clicks", "i_purchases"]
    pipe, t = ml.training_matrix(d, feats, ["category_id"])
    train = t.where(F.col("split") == "train").cache()
    cv = ml.grid_search_gbt(train, folds=2, grid={"maxDepth": [2, 3], "maxIter": [5]}, parallelism=2)
    assert len(cv.avgMetrics) == 2 and all(0.0 <= m <= 1.0 for m in cv.avgMetrics)
    test = t.where(F.col("split") == "test")
    scored = ml.positive_probability(cv.bestModel, test)
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    raw = d.where(F.col("split") == "test")
    for c in feats:
        raw = raw.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))

    class Chain:
        def transform(self, df):
            return cv.bestModel.transform(pipe.transform(df))

    imp = ml.permutation_importance(Chain(), raw.select("event_id", "label", "category_id", *feats), feats)
    assert {r.feature for r in imp.collect()} == set(feats)


def test_als_scores_only_candidates_and_takes_large_ids(spark):
    fx = Fixtures(spark, SF_SMALL)
    big = 5_000_000_000
    m = ml.interaction_matrix(fx.behaviors).withColumn("user_id", F.col("user_id") + big).withColumn("item_id", F.col("item_id") + big)
    cands = m.where("weight > 2").select("user_id", "item_id")
    recs = ml.als_top_n(m, cands, 5, rank=4, max_iter=3).collect()
    allowed = {(r.user_id, r.item_id) for r in cands.collect()}
    assert recs and {(r.user_id, r.item_id) for r in recs} <= allowed
    per = {}
    for r in sorted(recs, key=lambda r: (r.user_id, r["rank"])):
        per.setdefault(r.user_id, []).append((r["rank"], -r.rating))
    assert all([k for k, _ in v] == list(range(len(v))) and [s for _, s in v] == sorted(s for _, s in v) and len(v) <= 5 for v in per.values())


def test_permuted_keeps_every_row_and_value(spark):
    rows = [(i, float(i % 7), i % 2) for i in range(300)]          # many equal rows but for the id
    df = spark.createDataFrame(rows, "event_id long, x double, label int")
    out = ml.permuted(df, "x", "event_id").collect()
    assert sorted((r.event_id, r.label) for r in out) == [(i, l) for i, _, l in rows]
    assert sorted(r.x for r in out) == sorted(x for _, x, _ in rows)
    assert sum(r.x != rows[r.event_id][1] for r in out) > 100
    with pytest.raises(ValueError, match="unique"):
        ml.permuted(df.unionByName(df.limit(1)), "x", "event_id")


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from basketlens import session
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077", setCheckpointDir=lambda p: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_avro_needs_its_package(spark):
    from basketlens.operators.io import decode_avro_behavior
    raw = spark.createDataFrame([(bytearray(b"x"),)], "value binary")
    with pytest.raises(Exception, match="(?i)avro"):
        decode_avro_behavior(raw, '{"type":"record","name":"b","fields":[]}').collect()
