"""Experiments: variant assignment, attribution, read-out and significance
(X4, F7, W10, P16, J13, J14, A12-A15, A36).

The experiment configuration is a small literal (a handful of experiments
and variants), so its rows are broadcast; everything that grows with the
data (users, exposures, conversions) is joined on equality keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import cents, md5_mod, try_ratio, two_sided_p
from .asof import asof_join

# The default experiment configuration (declared order matters
# for the variant ranges).
EXPERIMENTS = [
    {"experiment_id": "ranking_model_v2", "status": "active",
     "variants": [("control", 50, {"model": "xgboost_v1"}), ("treatment", 50, {"model": "xgboost_v2"})],
     "metrics": ["ctr", "purchase_rate", "revenue_per_user"]},
    {"experiment_id": "diversity_strategy", "status": "active",
     "variants": [("control", 33, {"lambda": "0.5"}), ("treatment_a", 33, {"lambda": "0.3"}),
                  ("treatment_b", 34, {"lambda": "0.7"})],
     "metrics": ["ctr", "diversity_score", "session_length"]},
    {"experiment_id": "cold_start_strategy", "status": "draft",
     "variants": [("control", 50, {"strategy": "popular"}), ("treatment", 50, {"strategy": "content_based"})],
     "metrics": ["new_user_ctr", "new_user_retention"]},
]

# Which conversion event feeds which metric, and its value.
METRIC_EVENTS = {"ctr": "click", "purchase_rate": "purchase", "revenue_per_user": "purchase_value"}

CONFIG_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("variants", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("weight", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("metrics", T.ArrayType(T.StringType())),
])


def experiments_df(spark: SparkSession, config: list[dict] = EXPERIMENTS) -> DataFrame:
    rows = [(e["experiment_id"], e["status"], [(n, w, p) for n, w, p in e["variants"]], e["metrics"]) for e in config]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def variant_bounds(exp: DataFrame) -> DataFrame:
    """[lo, hi) hash range per variant from running weight sums in
    declared order; total weight per experiment."""
    v = exp.select("experiment_id", "status", F.posexplode("variants").alias("pos", "v"))
    w = Window.partitionBy("experiment_id").orderBy("pos")
    return (v.select("experiment_id", "status", "pos", F.col("v.name").alias("variant"),
                     F.col("v.weight").alias("weight"), F.col("v.params").alias("params"))
             .withColumn("hi", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("lo", F.col("hi") - F.col("weight"))
             .withColumn("total_weight", F.sum("weight").over(Window.partitionBy("experiment_id"))))


def assign_variants(users: DataFrame, spark: SparkSession, config: list[dict] = EXPERIMENTS,
                    user_col: str = "user_id") -> DataFrame:
    """Stable variant per (user, experiment) = the variant whose weight
    range holds ``int(md5(f"{user}:{experiment}"), 16) % total_weight``;
    inactive experiments give 'control'.

    Users are fanned out over the literal list of experiment ids (no join),
    then matched to their range with an equi-join on experiment id against
    the broadcast variant table.
    """
    totals = {e["experiment_id"]: sum(w for _, w, _ in e["variants"]) for e in config}
    ids = F.array(*[F.lit(e) for e in totals])
    ue = users.select(F.col(user_col).alias("user_id"), F.explode(ids).alias("experiment_id"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("experiment_id"))
    bucket = None
    for eid, tw in totals.items():
        h = md5_mod(key, tw)
        bucket = F.when(F.col("experiment_id") == eid, h) if bucket is None else bucket.when(
            F.col("experiment_id") == eid, h)
    ue = ue.withColumn("hash_mod", bucket)
    bounds = variant_bounds(experiments_df(spark, config))
    j = ue.join(F.broadcast(bounds), "experiment_id").where(
        (F.col("hash_mod") >= F.col("lo")) & (F.col("hash_mod") < F.col("hi")))
    return j.select("user_id", "experiment_id", "hash_mod",
                    F.when(F.col("status") == "active", F.col("variant")).otherwise(F.lit("control"))
                    .alias("variant"))


def active_variants(spark: SparkSession, config: list[dict] = EXPERIMENTS) -> DataFrame:
    """The variants of the active experiments, with their hash range."""
    return variant_bounds(experiments_df(spark, config).where(F.col("status") == "active")).select("experiment_id", "variant", "lo", "hi", "params")


def variant_params(assign: DataFrame, spark: SparkSession, config: list[dict] = EXPERIMENTS) -> DataFrame:
    """Config lookup by (experiment, variant); unknown -> empty map."""
    bounds = variant_bounds(experiments_df(spark, config)).select("experiment_id", "variant", "params")
    j = assign.join(F.broadcast(bounds), ["experiment_id", "variant"], "left")
    return j.withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))


def exposures_and_conversions(b: DataFrame, assign: DataFrame, spark: SparkSession,
                              config: list[dict] = EXPERIMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exposures = impressions (user_id, exposure_ts), in every active
    experiment with the user's variant; conversions = clicks (value 1) and
    purchases (value = price); and the users' variants in active experiments."""
    active = [e["experiment_id"] for e in config if e["status"] == "active"]
    variants = assign.where(F.col("experiment_id").isin(active)).select("user_id", "experiment_id", "variant")
    exp = b.where(F.col("action") == "impression").select("user_id", F.col("ts").alias("exposure_ts"))
    conv = (b.where(F.col("action").isin("click", "purchase"))
              .select("event_id", "user_id", "ts", F.col("action").alias("event_type"),
                      F.when(F.col("action") == "purchase", cents("price")).otherwise(F.lit(100))
                      .alias("value_cents")))
    return exp, conv, variants


def attribute(exposures: DataFrame, conversions: DataFrame, variants: DataFrame, ttl_days: int = 30) -> DataFrame:
    """A conversion counts in an experiment only with an exposure of the
    same user at or before it and at most ``ttl_days`` old; it takes the
    user's variant. Unmatched conversions are dropped. A user is exposed to
    all active experiments alike, so the as-of join runs once a user and the
    matched conversions are fanned out over experiments after it."""
    j = asof_join(conversions, exposures.withColumn("exposed", F.lit(True)), ["user_id"], "ts", "exposure_ts", ["exposed"], ttl_seconds=ttl_days * 86400)
    return j.where("exposed").drop("exposed").join(variants, "user_id")


def experiment_results(exposures: DataFrame, attributed: DataFrame, variants: DataFrame) -> DataFrame:
    """Per (experiment, variant, metric): exposures, total, count,
    value = total / exposures and its binomial standard error."""
    per_user = exposures.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    ex = variants.join(per_user, "user_id").groupBy("experiment_id", "variant").agg(F.sum("_n").alias("exposures"))
    m = attributed.select(
        "experiment_id", "variant",
        F.explode(F.array(
            F.when(F.col("event_type") == "click", F.struct(F.lit("ctr").alias("metric"),
                                                            F.lit(100).cast("bigint").alias("v"))),
            F.when(F.col("event_type") == "purchase", F.struct(F.lit("purchase_rate").alias("metric"),
                                                               F.lit(100).cast("bigint").alias("v"))),
            F.when(F.col("event_type") == "purchase", F.struct(F.lit("revenue_per_user").alias("metric"),
                                                               F.col("value_cents").alias("v"))))).alias("x"))
    m = m.where(F.col("x").isNotNull())
    conv = m.groupBy("experiment_id", "variant", F.col("x.metric").alias("metric")).agg(
        (F.sum("x.v") / F.lit(100.0)).alias("total"), F.count(F.lit(1)).alias("count"))
    metrics = F.explode(F.array(*[F.lit(k) for k in METRIC_EVENTS])).alias("metric")
    grid = ex.select("experiment_id", "variant", "exposures", metrics)
    r = (grid.join(conv, ["experiment_id", "variant", "metric"], "left")
             .withColumn("total", F.coalesce("total", F.lit(0.0)))
             .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
             .withColumn("value", try_ratio("total", "exposures")))
    var = F.col("value") * (F.lit(1.0) - F.col("value")) / F.col("exposures")
    return r.withColumn("stderr", F.when(var >= 0, F.sqrt(var)))


def significance(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each treatment row against its experiment's control row:
    lift (0 when control is 0), pooled two-proportion z-test, two-sided p,
    significant at ``alpha``. Guards as in the reference: no exposures ->
    z 0, p 1, not significant; a non-positive variance -> z 0, p 1."""
    # control values beside every row: a window over the few variant rows of
    # one (experiment, metric), so the results are computed once (no self-join)
    w = Window.partitionBy("experiment_id", "metric")
    is_c = F.col("variant") == "control"
    j = (results.withColumn("c_value", F.max(F.when(is_c, F.col("value"))).over(w))
                .withColumn("c_n", F.max(F.when(is_c, F.col("exposures"))).over(w))
                .withColumn("_has_c", F.max(is_c.cast("int")).over(w))
                .where(~is_c & (F.col("_has_c") == 1))
                .select("experiment_id", "metric", "variant", F.col("value").alias("t_value"),
                        F.col("exposures").alias("t_n"), "c_value", "c_n"))
    lift = F.when(F.col("c_value") > 0, (F.col("t_value") - F.col("c_value")) / F.col("c_value")).otherwise(0.0)
    both = (F.col("c_n") > 0) & (F.col("t_n") > 0)
    p_pool = (F.col("c_value") * F.col("c_n") + F.col("t_value") * F.col("t_n")) / (F.col("c_n") + F.col("t_n"))
    se2 = p_pool * (F.lit(1.0) - p_pool) * (F.lit(1.0) / F.col("c_n") + F.lit(1.0) / F.col("t_n"))
    se = F.when(se2 > 0, F.sqrt(se2))
    z = F.when(both & se.isNotNull(), (F.col("t_value") - F.col("c_value")) / se).otherwise(F.lit(0.0))
    out = (j.withColumn("lift", lift).withColumn("z_score", z)
             .withColumn("p_value", F.when(both & se.isNotNull(), two_sided_p(F.col("z_score")))
                         .otherwise(F.lit(1.0))))
    return out.withColumn("is_significant", both & (F.col("p_value") < alpha)).select(
        "experiment_id", "metric", "variant", "c_value", "t_value", "lift", "z_score", "p_value",
        "is_significant")


def ab_rollup(b: DataFrame, assign: DataFrame) -> DataFrame:
    """Per (experiment, variant) users, impressions, clicks, purchases,
    revenue, ctr, conversion, arpu and lift of each against control."""
    per_user = b.groupBy("user_id").agg(
        F.count(F.when(F.col("action") == "impression", True)).alias("impressions"),
        F.count(F.when(F.col("action") == "click", True)).alias("clicks"),
        F.count(F.when(F.col("action") == "purchase", True)).alias("purchases"),
        F.sum(F.when(F.col("action") == "purchase", cents("price")).otherwise(0)).alias("rev_cents"))
    r = (assign.join(per_user, "user_id").groupBy("experiment_id", "variant").agg(
        F.countDistinct("user_id").alias("users"), F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"), F.sum("purchases").alias("purchases"),
        (F.sum("rev_cents") / F.lit(100.0)).alias("revenue")))
    r = (r.withColumn("ctr", try_ratio("clicks", "impressions"))
          .withColumn("conversion", try_ratio("purchases", "clicks"))
          .withColumn("arpu", try_ratio("revenue", "users")))
    ctl = r.where(F.col("variant") == "control").select(
        "experiment_id", *[F.col(m).alias(f"_c_{m}") for m in ("ctr", "conversion", "arpu")])
    r = r.join(ctl, "experiment_id", "left")
    for m in ("ctr", "conversion", "arpu"):
        r = r.withColumn(f"{m}_lift", F.when(F.col(f"_c_{m}") > 0,
                                             (F.col(m) - F.col(f"_c_{m}")) / F.col(f"_c_{m}")))
    return r.drop(*[f"_c_{m}" for m in ("ctr", "conversion", "arpu")])


def _retained(days: Column, first_day: Column) -> Column:
    """Whether one of the days is 1 to 7 after the first."""
    return F.exists(days, lambda x: (F.datediff(x, first_day) >= 1) & (F.datediff(x, first_day) <= 7))


def new_user_retention(b: DataFrame) -> DataFrame:
    """A36 (ours): per user, retained = an event 1..7 days after the day of
    the first event. Uses the distinct (user, day) set, bounded by the
    number of days, so no self-join over raw events is needed."""
    days = b.select("user_id", F.to_date("ts").alias("d")).distinct()
    per = days.groupBy("user_id").agg(F.min("d").alias("first_day"), F.collect_set("d").alias("_days"))
    return per.select("user_id", "first_day", _retained(F.col("_days"), F.col("first_day")).alias("retained"))


def variant_metrics(b: DataFrame, assign: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """A36 (ours): per (experiment, variant): diversity_score = mean distinct
    categories per session, session_length = mean events per session,
    new_user_ctr = clicks / impressions of users whose first visit is <= 7
    days before as_of, new_user_retention = share of retained users.

    The log is read once: a state for each session (its categories and days
    are small sets), states summed to a row a user, and users to variants."""
    sessions = b.groupBy("user_id", "session_id").agg(
        F.size(F.collect_set("category_id")).alias("cats"), F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("action") == "impression", True)).alias("imp"), F.count(F.when(F.col("action") == "click", True)).alias("clk"),
        F.collect_set(F.to_date("ts")).alias("days"))
    per_user = sessions.groupBy("user_id").agg(
        F.sum("cats").alias("cats"), F.sum("events").alias("events"), F.count(F.lit(1)).alias("sessions"), F.sum("imp").alias("imp"), F.sum("clk").alias("clk"),
        F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"))
    new = F.extract(F.lit("DAY"), as_of - F.col("first_visit")) <= 7
    per_user = (per_user.withColumn("retained", _retained(F.col("days"), F.array_min("days")).cast("int")).drop("days")
                .join(users.select("user_id", new.alias("new")), "user_id", "left"))
    return (assign.join(per_user, "user_id").groupBy("experiment_id", "variant").agg(
        (F.sum("cats") / F.sum("sessions")).alias("diversity_score"), (F.sum("events") / F.sum("sessions")).alias("session_length"),
        try_ratio(F.sum(F.when(F.col("new"), F.col("clk"))), F.sum(F.when(F.col("new"), F.col("imp")))).alias("new_user_ctr"),
        (F.sum("retained") / F.count(F.lit(1))).alias("new_user_retention")))
