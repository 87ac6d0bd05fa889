"""Point-in-time (as-of) join and feature-store operators.

``asof_join`` attaches to every entity row the newest feature row of the same
key with ``feature_ts <= entity_ts`` (ties: later ``created`` wins; a feature
at exactly the entity time is used) and ``feature_ts > entity_ts - ttl``.

There is no as-of join in Spark's DataFrame API, and a window over
``partitionBy(key)`` would put a hot key's whole history into one task, so
the time axis is cut into buckets (``time_buckets``: finer where a key is dense):

1. inside each (key, bucket) the entity and feature rows are unioned and a
   ``last(..., ignorenulls)`` running window finds the in-bucket match;
2. the newest feature row per (key, bucket) is a partial aggregate
   (``max_by``); a running ``last`` over that summary (one row per key and
   bucket, bounded by the time span) gives the newest row of all earlier
   buckets;
3. the in-bucket match wins over the earlier-bucket one; the TTL is applied.

No theta join, no cross product, no collect.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import time_buckets


def asof_join(entities: DataFrame, features: DataFrame, keys: list[str], entity_ts: str,
              feature_ts: str, feature_cols: list[str], ttl_seconds: int | None = None,
              created: str | None = None, bucket_seconds: int = 86400,
              prefix: str = "", entity_rows: int | None = None) -> DataFrame:
    """Left as-of join of ``features`` onto ``entities`` (see module doc).

    Output: all entity columns plus ``feature_cols`` (renamed ``prefix+col``)
    and ``{prefix}feature_ts``; nulls where no row qualifies.
    """
    ord_cols = [feature_ts] + ([created] if created else [])
    payload = F.struct(*[F.col(c).alias(c) for c in ord_cols], *[F.col(c) for c in feature_cols])
    payload_type = features.select(payload.alias("p")).schema["p"].dataType
    null_payload = F.lit(None).cast(payload_type)

    e, f = time_buckets([(entities, entity_ts), (features, feature_ts)], keys, bucket_seconds, counts=[entity_rows, None])
    ent_struct = F.struct(*[F.col(c) for c in entities.columns])
    ent_type = entities.select(ent_struct.alias("e")).schema["e"].dataType
    c_type = features.schema[created].dataType if created else "int"

    # 1. in-bucket match: feature rows sort before entity rows at equal time.
    #    Entity rows carry their own columns through the union (no re-join on a
    #    generated id, which would not be stable under recomputation).
    ent_side = e.select(*keys, "_b", F.col(entity_ts).alias("_t"), F.lit(None).cast(c_type).alias("_c"),
                        F.lit(1).alias("_side"), ent_struct.alias("_e"), null_payload.alias("_p"))
    feat_side = f.select(*keys, "_b", F.col(feature_ts).cast(entities.schema[entity_ts].dataType).alias("_t"),
                         (F.col(created) if created else F.lit(None).cast(c_type)).alias("_c"),
                         F.lit(0).alias("_side"), F.lit(None).cast(ent_type).alias("_e"), payload.alias("_p"))
    w_in = (Window.partitionBy(*keys, "_b").orderBy("_t", "_side", F.col("_c").asc_nulls_first())
                  .rowsBetween(Window.unboundedPreceding, 0))
    inb = (ent_side.unionByName(feat_side)
                   .withColumn("_in", F.last("_p", ignorenulls=True).over(w_in))
                   .where(F.col("_side") == 1).select(*keys, "_b", "_e", "_in"))

    # 2. newest feature row of all earlier buckets, via a per-(key, bucket) summary.
    summary = f.groupBy(*keys, "_b").agg(F.max_by(payload, F.struct(*ord_cols)).alias("_p"))
    markers = e.select(*keys, "_b").distinct().select(*keys, "_b", null_payload.alias("_p"),
                                                      F.lit(1).alias("_m"))
    w_prev = (Window.partitionBy(*keys).orderBy("_b", F.col("_m").desc())
                    .rowsBetween(Window.unboundedPreceding, -1))
    prev = (summary.withColumn("_m", F.lit(0)).unionByName(markers)
                   .withColumn("_prev", F.last("_p", ignorenulls=True).over(w_prev))
                   .where(F.col("_m") == 1).select(*keys, "_b", "_prev"))

    # 3. combine and apply the TTL (exclusive lower bound).
    j = inb.join(prev, [*keys, "_b"], "left")
    best = F.coalesce(F.col("_in"), F.col("_prev"))
    if ttl_seconds is not None:
        alive = best[feature_ts] > F.col("_e")[entity_ts] - F.make_dt_interval(secs=F.lit(ttl_seconds))
        best = F.when(alive, best)
    j = j.withColumn("_best", best)
    out = [F.col("_e")[c].alias(c) for c in entities.columns]
    out += [F.col("_best")[c].alias(prefix + c) for c in feature_cols]
    out.append(F.col("_best")[feature_ts].alias(f"{prefix}feature_ts"))
    return j.select(*out)


@dataclass
class FeatureView:
    """A feature table with entity keys, event time, TTL and typed fields."""
    name: str
    df: DataFrame
    keys: list[str]
    features: list[str]
    ts: str = "event_timestamp"
    ttl_seconds: int | None = None
    created: str | None = None
    defaults: dict = field(default_factory=dict)


def historical_features(entity_df: DataFrame, views: list[FeatureView], entity_ts: str = "event_timestamp",
                        bucket_seconds: int = 86400) -> DataFrame:
    """Point-in-time correct training frame; each view joined independently."""
    out, n = entity_df, entity_df.count()  # each join keeps the rows
    for v in views:
        out = asof_join(out, v.df, v.keys, entity_ts, v.ts, v.features, v.ttl_seconds, v.created,
                        bucket_seconds=bucket_seconds, prefix="", entity_rows=n).drop("feature_ts")
    return out


def latest_rows(df: DataFrame, keys: list[str], ts: str, created: str | None = None,
                start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Newest row per key in (start, end]; ``max_by`` is map-side
    combined, so a hot key costs no sort."""
    d = df
    if start is not None:
        d = d.where(F.col(ts) > start)
    if end is not None:
        d = d.where(F.col(ts) <= end)
    rest = [c for c in d.columns if c not in keys]
    order = F.struct(F.col(ts), *([F.col(created)] if created else []))
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def online_features(entities: DataFrame, views: list[FeatureView]) -> DataFrame:
    """Latest row of each view for an entity set, with fallback defaults."""
    out = entities
    for v in views:
        latest = latest_rows(v.df, v.keys, v.ts, v.created).select(*v.keys, *v.features)
        out = out.join(latest, v.keys, "left")
        for c, d in v.defaults.items():
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)))
    return out
