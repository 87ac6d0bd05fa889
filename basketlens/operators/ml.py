"""Training data, models and evaluation as Spark jobs (M1-M7, P7, P8, U3,
U4, F17, F18, A31).

Models are Spark MLlib estimators (GBT, ALS); evaluation (AUC) is a
rank-sum data job; permutation importance shuffles a column with a seeded
hash join, so nothing leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_mod
from .sequences import global_rank

# Implicit-feedback weight per action for the interaction matrix.
ACTION_WEIGHT = {"impression": 1, "click": 2, "add_to_cart": 3, "purchase": 5}


def feature_vector(df: DataFrame, features: list[str], out: str = "features_arr") -> DataFrame:
    """Features in declared order, missing/None -> 0, as doubles."""
    return df.withColumn(out, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))


def typed_values(kv: DataFrame, value_col: str = "raw") -> DataFrame:
    """Loose typing of string values: int, else float, else string."""
    s = F.trim(F.col(value_col))
    as_int = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    as_dbl = F.when(as_int.isNull(), s.try_cast("double"))
    kind = (F.when(as_int.isNotNull(), "int").when(as_dbl.isNotNull(), "float").otherwise("string"))
    return kv.select("*", as_int.alias("int_val"), as_dbl.alias("dbl_val"),
                     F.when(kind == "string", F.col(value_col)).alias("str_val"), kind.alias("kind"))


def interaction_matrix(b: DataFrame) -> DataFrame:
    """(user, item, weight) implicit feedback, weights per action."""
    w = None
    for a, v in ACTION_WEIGHT.items():
        w = F.when(F.col("action") == a, v) if w is None else w.when(F.col("action") == a, v)
    return b.groupBy("user_id", "item_id").agg(F.sum(w.otherwise(0)).cast("double").alias("weight"))


def viewed_not_purchased(b: DataFrame) -> DataFrame:
    """U4: (user, item) viewed or clicked but never bought (EXCEPT DISTINCT)."""
    seen = b.where(F.col("action").isin("impression", "click")).select("user_id", "item_id")
    bought = b.where(F.col("action") == "purchase").select("user_id", "item_id")
    return seen.subtract(bought)


def hash_split(df: DataFrame, key: str, train_pct: int = 80, seed: int = 42) -> DataFrame:
    """M2: deterministic split: md5(key:seed) mod 100 < train_pct -> train.
    Stratified in expectation (the hash is independent of the label) and
    stable across reruns and executor loss, unlike ``randomSplit``."""
    b = md5_mod(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 100)
    return df.withColumn("split", F.when(b < train_pct, "train").otherwise("test"))


def auc_rank(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """M7: ROC AUC by the rank-sum statistic with average ranks on ties,
    ranks from a distributed range sort (no single-partition window)."""
    r = global_rank(scored.select(score, label), score, out="_rk")
    avg_rank = F.col("_rk") + (F.col("_rk_ties") - 1) / 2.0
    s = r.agg(F.sum(F.when(F.col(label) == 1, avg_rank)).alias("rsum"),
              F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("npos"),
              F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("nneg"))
    return s.select(((F.col("rsum") - F.col("npos") * (F.col("npos") + 1) / 2.0)
                     / (F.col("npos") * F.col("nneg"))).alias("auc"),
                    F.col("npos").cast("bigint").alias("positives"),
                    F.col("nneg").cast("bigint").alias("negatives"))


def cold_start_score_gap(scored: DataFrame, users: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Mean score per (new user?, new item?) and its gap to
    (existing user, existing item)."""
    d = (scored.join(users.select("user_id", "first_visit"), "user_id")
               .join(items.select("item_id", "launch_date"), "item_id")
               .select("score",
                       (F.extract(F.lit("DAY"), as_of - F.col("first_visit")) <= 7).alias("user_new"),
                       (F.extract(F.lit("DAY"), as_of - F.col("launch_date")) <= 7).alias("item_new")))
    g = d.groupBy("user_new", "item_new").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    # a window over the (at most four) grouped rows: no second pass over the input
    base = F.max(F.when(~F.col("user_new") & ~F.col("item_new"), F.col("mean_score"))).over(Window.partitionBy())
    return g.withColumn("gap", F.col("mean_score") - base)


def pair_cosine(pairs: DataFrame, emb: DataFrame, left: str, right: str, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """cosine of given (left, right) id pairs (e.g. co-purchased items),
    by two equi joins to the vectors; no all-pairs product."""
    e = emb.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("v"))
    j = (pairs.join(e.withColumnRenamed(id_col, left).withColumnRenamed("v", "_a"), left)
              .join(e.withColumnRenamed(id_col, right).withColumnRenamed("v", "_b"), right))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.transform("_a", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    nb = F.sqrt(F.aggregate(F.transform("_b", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    return j.withColumn("cosine", F.try_divide(dot, na * nb)).drop("_a", "_b")


def embedding_neighbours(pairs: DataFrame, emb: DataFrame, n: int = 10) -> DataFrame:
    """each item's ``n`` nearest items by embedding cosine among the given
    pairs (item_i, item_j), both ways; ties to the smaller id."""
    d = pair_cosine(pairs.where("item_i <> item_j").select("item_i", "item_j"), emb, "item_i", "item_j").where(F.col("cosine").isNotNull())
    both = d.select(F.explode(F.array(F.struct(F.col("item_i").alias("item_id"), F.col("item_j").alias("neighbour")),
                                      F.struct(F.col("item_j").alias("item_id"), F.col("item_i").alias("neighbour")))).alias("e"), "cosine")
    w = Window.partitionBy("item_id").orderBy(F.desc("cosine"), F.asc("neighbour"))
    return (both.select("e.item_id", "e.neighbour", "cosine").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def dimension_contributions(emb: DataFrame, k: int = 10) -> DataFrame:
    """Per dimension, mean |v_d * centroid(label)_d| over all
    vectors; top-k dimensions. Centroids are one row per label (bounded)."""
    pe = emb.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    cent = pe.groupBy("label", "dim").agg(F.avg("x").alias("c"))
    contrib = pe.join(cent, ["label", "dim"]).groupBy("dim").agg(
        F.avg(F.abs(F.col("x") * F.col("c"))).alias("mean_abs_contribution"))
    return contrib.orderBy(F.desc("mean_abs_contribution"), F.asc("dim")).limit(k)


def training_matrix(entities_with_features: DataFrame, numeric: list[str], categorical: list[str],
                    split_col: str = "split"):
    """M1: label-encode categoricals (``handleInvalid='keep'``), assemble and
    standardise; the encoders and the scaler are fit on the train split only.
    Returns (fitted feature model, transformed DataFrame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    d = entities_with_features
    for c in numeric:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    asm = VectorAssembler(inputCols=numeric + [f"{c}_idx" for c in categorical], outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    pipe = Pipeline(stages=[*idx, asm, scaler])
    model = pipe.fit(d.where(F.col(split_col) == "train"))
    return model, model.transform(d)


def fit_gbt(train: DataFrame, max_iter: int = 20, max_depth: int = 4, seed: int = 42):
    """M3: gradient-boosted trees CTR classifier."""
    from pyspark.ml.classification import GBTClassifier
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                         seed=seed).fit(train)


# The search grid (depth, trees, step size, row and feature sampling).
FULL_GRID = {"maxDepth": [3, 5, 7], "maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1],
             "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["all", "sqrt"]}


def grid_search_gbt(train: DataFrame, folds: int = 3, grid: dict | None = None, parallelism: int = 4):
    """M3: grid search with k-fold cross-validation on AUC."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=42)
    grid = grid or FULL_GRID
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(getattr(gbt, name), values)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=b.build(),
                        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"),
                        numFolds=folds, parallelism=parallelism, seed=42)
    return cv.fit(train)


def positive_probability(model, df: DataFrame) -> DataFrame:
    """M6: model score = probability of the positive class."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def fit_als(matrix: DataFrame, rank: int = 16, reg: float = 0.1, alpha: float = 1.0, max_iter: int = 10,
            seed: int = 42):
    """M4: implicit-feedback ALS on (user, item, weight)."""
    from pyspark.ml.recommendation import ALS
    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="weight", implicitPrefs=True, rank=rank,
              regParam=reg, alpha=alpha, maxIter=max_iter, seed=seed, coldStartStrategy="drop")
    return als.fit(matrix)


def _dense(df: DataFrame, col: str) -> DataFrame:
    """(col, _id): the distinct ids numbered from 1 (a distributed rank)."""
    return global_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), col, out="_id").select(col, F.col("_id").cast("int").alias("_id"))


def als_top_n(matrix: DataFrame, candidates: DataFrame, n: int = 10, **params) -> DataFrame:
    """M4: the ``n`` best candidates (user_id, item_id) of each user by ALS.
    Only given candidates (the recall result) are scored, never every user
    with every item. ALS takes 32-bit ids, so users and items are numbered
    densely first; ids of any size are right. Output: user_id, rank (0-based),
    item_id, rating."""
    users, items = _dense(matrix, "user_id"), _dense(matrix, "item_id")

    def coded(df: DataFrame) -> DataFrame:
        u, i = users.withColumnRenamed("_id", "_u"), items.withColumnRenamed("_id", "_i")
        return df.join(u, "user_id").join(i, "item_id").withColumnsRenamed({"user_id": "_user", "item_id": "_item", "_u": "user_id", "_i": "item_id"})

    model = fit_als(coded(matrix).select("user_id", "item_id", "weight"), **params)
    scored = model.transform(coded(candidates.select("user_id", "item_id").distinct()))
    w = Window.partitionBy("_user").orderBy(F.desc("prediction"), F.asc("_item"))
    top = scored.select("_user", "_item", "prediction").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.select(F.col("_user").alias("user_id"), (F.col("_r") - 1).cast("bigint").alias("rank"), F.col("_item").alias("item_id"), F.col("prediction").alias("rating"))


def permuted(df: DataFrame, feature: str, id_col: str, seed: int = 42) -> DataFrame:
    """``df`` with one column permuted among its rows. Rows are ranked by
    their id and, again, by a seeded hash of it; each takes the value of the
    row whose second rank is its first. ``id_col`` must be unique and not null
    (else ranks would be shared and rows multiplied or lost), which is checked."""
    bad = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if not bad.isEmpty():
        raise ValueError(f"{id_col} must be unique and not null")
    first = global_rank(df.withColumn("_k", F.struct(id_col)), "_k", out="_ra").drop("_ra_ties", "_k")
    second = global_rank(df.select(feature, F.struct(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).alias("_k")), "_k", out="_ra")
    return first.drop(feature).join(second.select("_ra", feature), "_ra").select(*df.columns)


def permutation_importance(model, scored_input: DataFrame, features: list[str], id_col: str = "event_id",
                           seed: int = 42) -> DataFrame:
    """M5: AUC drop when one raw feature column is permuted (``permuted``):
    one distributed evaluation for each feature."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    base = ev.evaluate(model.transform(scored_input))
    rows = [(f, base - ev.evaluate(model.transform(permuted(scored_input, f, id_col, seed + i)))) for i, f in enumerate(features)]
    return scored_input.sparkSession.createDataFrame(rows, "feature string, auc_drop double")
