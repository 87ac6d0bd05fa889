"""Training-data, model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import asof as ao
from ..operators import boosting as bo
from ..operators import ml
from ..operators import neighbours as nb
from ..operators import similarity as sm
from ..operators.io import labelled_interactions
from ..sources.shared import materialize
from .recommend_queries import SCORED_SQL, _candidates, _recall_parts, _scored
from .registry import query
from .similarity_queries import COOC_SQL, POP_SQL, catalogue_popularity
from .store_queries import ITEM_DAILY, USER_DAILY, _views

FEATURES = ["u_clicks", "u_purchases", "i_clicks", "i_purchases"]


@query("feature_vector", views=("behaviors",), oracle="""
WITH e AS (SELECT event_id, user_id, item_id, ts AS event_timestamp,
                  CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS label FROM behaviors),
ud AS (SELECT user_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS fts,
              count(*) FILTER (WHERE action = 'click') AS c, count(*) FILTER (WHERE action = 'purchase') AS p
       FROM behaviors GROUP BY ALL),
idl AS (SELECT item_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS fts,
               count(*) FILTER (WHERE action = 'click') AS c, count(*) FILTER (WHERE action = 'purchase') AS p
        FROM behaviors GROUP BY ALL)
SELECT e.event_id,
  coalesce(CAST(CASE WHEN ud.fts > e.event_timestamp - INTERVAL 30 DAY THEN ud.c END AS DOUBLE), 0.0) AS f_u_clicks,
  coalesce(CAST(CASE WHEN ud.fts > e.event_timestamp - INTERVAL 30 DAY THEN ud.p END AS DOUBLE), 0.0) AS f_u_purchases,
  coalesce(CAST(CASE WHEN idl.fts > e.event_timestamp - INTERVAL 7 DAY THEN idl.c END AS DOUBLE), 0.0) AS f_i_clicks,
  coalesce(CAST(CASE WHEN idl.fts > e.event_timestamp - INTERVAL 7 DAY THEN idl.p END AS DOUBLE), 0.0)
    AS f_i_purchases
FROM e ASOF LEFT JOIN ud ON e.user_id = ud.user_id AND e.event_timestamp >= ud.fts
       ASOF LEFT JOIN idl ON e.item_id = idl.item_id AND e.event_timestamp >= idl.fts""")
def feature_vector(fx):
    """Null-safe feature vector in declared order (as columns f_*)."""
    pit = ao.historical_features(labelled_interactions(fx.behaviors), _views(fx))
    v = ml.feature_vector(pit, FEATURES, "arr")
    return v.select("event_id", *[F.col("arr")[i].alias(f"f_{c}") for i, c in enumerate(FEATURES)])


@query("parse_kv_values", oracle="""
WITH kv AS (
  SELECT o_orderkey AS order_id, k.key, k.raw FROM orders,
    (SELECT unnest(['customer', 'total', 'priority']) AS key,
            unnest([CAST(o_custkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), o_orderpriority]) AS raw) k)
SELECT order_id, key, raw,
       CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS BIGINT) END AS int_val,
       CASE WHEN NOT regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS dbl_val,
       CASE WHEN NOT regexp_matches(trim(raw), '^[+-]?[0-9]+$') AND TRY_CAST(trim(raw) AS DOUBLE) IS NULL
            THEN raw END AS str_val,
       CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN 'int'
            WHEN TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind
FROM kv""")
def parse_kv_values(fx):
    """Loose typing of key-value strings (int, else float, else string)."""
    o = fx.orders
    kv = o.select(F.col("o_orderkey").alias("order_id"), F.explode(F.map_from_arrays(
        F.array(F.lit("customer"), F.lit("total"), F.lit("priority")),
        F.array(F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"),
                F.col("o_orderpriority")))).alias("key", "raw"))
    return ml.typed_values(kv)


@query("interaction_matrix", views=("behaviors",), oracle="""
SELECT user_id, item_id, CAST(sum(CASE action WHEN 'impression' THEN 1 WHEN 'click' THEN 2
       WHEN 'add_to_cart' THEN 3 WHEN 'purchase' THEN 5 ELSE 0 END) AS DOUBLE) AS weight
FROM behaviors GROUP BY ALL""")
def interaction_matrix(fx):
    """Implicit-feedback (user, item, weight) matrix for ALS."""
    return ml.interaction_matrix(fx.behaviors)


@query("viewed_not_purchased", views=("behaviors",), oracle="""
SELECT user_id, item_id FROM behaviors WHERE action IN ('impression', 'click')
EXCEPT SELECT user_id, item_id FROM behaviors WHERE action = 'purchase'""")
def viewed_not_purchased(fx):
    """U4: viewed but never purchased (set difference)."""
    return ml.viewed_not_purchased(fx.behaviors)


@query("train_split", views=("behaviors",), oracle="""
SELECT event_id, CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS label,
       CASE WHEN CAST(CAST('0x' || md5(CAST(event_id AS VARCHAR) || ':42') AS UHUGEINT) % CAST(100 AS UHUGEINT)
                 AS BIGINT) < 80 THEN 'train' ELSE 'test' END AS split
FROM behaviors""")
def train_split(fx):
    """M2: deterministic hash 80/20 split (seed 42)."""
    e = labelled_interactions(fx.behaviors).select("event_id", "label")
    return ml.hash_split(e, "event_id")


AUC_INPUT_SQL = f"""
SELECT CASE WHEN b.action = 'purchase' THEN 1 ELSE 0 END AS label, coalesce(p.popularity_score, 0.0) AS score
FROM behaviors b LEFT JOIN ({POP_SQL}) p ON p.item_id = b.item_id"""


@query("auc_rank", views=("behaviors", "items"), oracle=f"""
WITH s AS ({AUC_INPUT_SQL}),
r AS (SELECT label, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS ties FROM s),
a AS (SELECT sum(CASE WHEN label = 1 THEN rk + (ties - 1) / 2.0e0 END) AS rsum,
             sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nneg
      FROM r)
SELECT round((rsum - npos * (npos + 1) / 2.0e0) / (npos * nneg), 6) AS auc, CAST(npos AS BIGINT) AS positives,
       CAST(nneg AS BIGINT) AS negatives FROM a""")
def auc_rank(fx):
    """M7: rank-sum AUC of item popularity as a purchase predictor."""
    e = labelled_interactions(fx.behaviors).select("item_id", "label")
    pop = catalogue_popularity(fx).select("item_id", "popularity_score")
    s = e.join(pop, "item_id", "left").select("label", F.coalesce("popularity_score", F.lit(0.0)).alias("score"))
    return ml.auc_rank(s).withColumn("auc", r6("auc"))


@query("cold_start_score_gap", views=("behaviors", "items", "users", "as_of_t"), oracle=f"""
WITH d AS (SELECT s.score, extract(day FROM (SELECT as_of FROM as_of_t) - u.first_visit) <= 7 AS user_new,
                  extract(day FROM (SELECT as_of FROM as_of_t) - i.launch_date) <= 7 AS item_new
           FROM ({SCORED_SQL}) s JOIN users u USING (user_id) JOIN items i USING (item_id)),
g AS (SELECT user_new, item_new, avg(score) AS mean_score, count(*) AS n FROM d GROUP BY ALL)
SELECT user_new, item_new, round(mean_score, 6) AS mean_score, n,
       round(mean_score - (SELECT mean_score FROM g WHERE NOT user_new AND NOT item_new), 6) AS gap FROM g""")
def cold_start_score_gap(fx):
    """Mean candidate score by user/item newness and gap to existing x existing."""
    g = ml.cold_start_score_gap(_scored(fx), fx.users, fx.items, fx.as_of)
    return g.select("user_new", "item_new", r6("mean_score").alias("mean_score"), "n", r6("gap").alias("gap"))


@query("embedding_similarity", views=("behaviors",), oracle=f"""
SELECT p.item_i, p.item_j,
       round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
FROM (SELECT item_i, item_j FROM ({COOC_SQL})) p
JOIN embeddings a ON a.vec_id = p.item_i JOIN embeddings b ON b.vec_id = p.item_j""")
def embedding_similarity(fx):
    """embedding cosine of every co-purchased item pair (vectors keyed
    by item id); only given pairs are compared, never all pairs."""
    pairs = sm.item_cooccurrence(fx.behaviors).select("item_i", "item_j")
    out = ml.pair_cosine(pairs, fx.embeddings, "item_i", "item_j")
    return out.select("item_i", "item_j", r6("cosine").alias("cosine"))


@query("feature_importance", oracle="""
WITH pe AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS dim,
                   unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
c AS (SELECT label, dim, avg(x) AS c FROM pe GROUP BY ALL)
SELECT dim, round(avg(abs(x * c)), 6) AS mean_abs_contribution FROM pe JOIN c USING (label, dim)
GROUP BY dim ORDER BY avg(abs(x * c)) DESC, dim LIMIT 10""")
def feature_importance(fx):
    """Top-10 embedding dimensions by mean |value x class centroid|."""
    d = ml.dimension_contributions(fx.embeddings)
    return d.select(F.col("dim").cast("bigint").alias("dim"),
                    r6("mean_abs_contribution").alias("mean_abs_contribution"))


@query("embedding_neighbours", views=("behaviors",), oracle=f"""
WITH c AS (
  SELECT p.item_i, p.item_j,
         list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
           / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
              * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS cosine
  FROM ({COOC_SQL}) p JOIN embeddings a ON a.vec_id = p.item_i JOIN embeddings b ON b.vec_id = p.item_j
  WHERE p.item_i <> p.item_j)
SELECT item_id, neighbour, round(cosine, 6) AS cosine, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, neighbour) AS rank
  FROM (SELECT item_i AS item_id, item_j AS neighbour, cosine FROM c UNION ALL SELECT item_j, item_i, cosine FROM c))
WHERE rank <= 10""")
def embedding_neighbours(fx):
    """top-10 items by embedding cosine among the co-purchased ones."""
    pairs = materialize(sm.item_cooccurrence(fx.behaviors).select("item_i", "item_j"), "copurchased")
    return ml.embedding_neighbours(pairs, fx.embeddings).withColumn("cosine", r6("cosine"))


@query("item_neighbours", oracle="""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT a.vec_id AS item_id, b.vec_id AS neighbour,
             list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS cosine
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT item_id, neighbour, round(cosine, 6) AS cosine, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 12) DESC, neighbour) AS rank FROM c)
WHERE rank <= 10""")
def item_neighbours(fx):
    """top-10 items by embedding cosine for every item against all items (exact up to two blocks of vectors, measured recall beyond)."""
    return nb.all_neighbours(fx.embeddings).withColumn("cosine", r6("cosine"))


def _frame(fx, b=None):
    """Labelled events (of ``b``, the clean log if not given) with point-in-time
    features, category and split, written once: fits and scores read it several times."""
    b = fx.behaviors if b is None else b
    pit = ao.historical_features(labelled_interactions(b), _views(fx, b))
    items = fx.items.select("item_id", "category_id")
    d = ml.hash_split(pit.join(items, "item_id", "left"), "event_id")
    for c in FEATURES:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return materialize(d.select("event_id", "user_id", "item_id", "label", "split", "category_id", *FEATURES), "training-frame")


def _model(frame):
    """(best model of the whole grid on the train split, scores of the grid)."""
    return bo.train_model(frame.where(F.col("split") == "train"), FEATURES, ["category_id"])


_STANDARD = ", ".join(f"round((t.{c} - s.m_{c}) / s.d_{c}, 6) AS f_{c}" for c in [*FEATURES, "category"])
_MOMENTS = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in [*FEATURES, "category"])


@query("training_matrix", views=("behaviors", "items"), oracle=f"""
WITH e AS (SELECT event_id, user_id, item_id, ts AS event_timestamp, CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS label,
                  CASE WHEN CAST(CAST('0x' || md5(CAST(event_id AS VARCHAR) || ':42') AS UHUGEINT) % CAST(100 AS UHUGEINT) AS BIGINT) < 80
                       THEN 'train' ELSE 'test' END AS split FROM behaviors),
ud AS ({USER_DAILY}), idl AS ({ITEM_DAILY}),
f AS (SELECT e.event_id, e.label, e.split, i.category_id,
  coalesce(CASE WHEN ud.event_timestamp > e.event_timestamp - INTERVAL 30 DAY THEN ud.u_clicks END, 0)::DOUBLE AS u_clicks,
  coalesce(CASE WHEN ud.event_timestamp > e.event_timestamp - INTERVAL 30 DAY THEN ud.u_purchases END, 0)::DOUBLE AS u_purchases,
  coalesce(CASE WHEN idl.event_timestamp > e.event_timestamp - INTERVAL 7 DAY THEN idl.i_clicks END, 0)::DOUBLE AS i_clicks,
  coalesce(CASE WHEN idl.event_timestamp > e.event_timestamp - INTERVAL 7 DAY THEN idl.i_purchases END, 0)::DOUBLE AS i_purchases
  FROM e LEFT JOIN items i ON i.item_id = e.item_id
         ASOF LEFT JOIN ud ON e.user_id = ud.user_id AND e.event_timestamp >= ud.event_timestamp
         ASOF LEFT JOIN idl ON e.item_id = idl.item_id AND e.event_timestamp >= idl.event_timestamp),
codes AS (SELECT category_id, row_number() OVER (ORDER BY count(*) DESC, category_id) - 1 AS code FROM f WHERE split = 'train' GROUP BY category_id),
t AS (SELECT f.*, coalesce(codes.code, (SELECT count(*) FROM codes))::DOUBLE AS category FROM f LEFT JOIN codes USING (category_id)),
s AS (SELECT {_MOMENTS} FROM t WHERE split = 'train')
SELECT t.event_id, t.label, t.split, {_STANDARD} FROM t, s""")
def training_matrix(fx):
    """M1: encoded (by train frequency), standardised training matrix (fit on
    the train split), as columns f_*."""
    from pyspark.ml.functions import vector_to_array
    _, t = ml.training_matrix(_frame(fx), FEATURES, ["category_id"])
    v = t.withColumn("v", vector_to_array("features"))
    return v.select("event_id", "label", "split", *[F.round(F.col("v")[i], 6).alias(f"f_{c}") for i, c in enumerate([*FEATURES, "category"])])


@query("ctr_model_grid")
def ctr_model_grid(fx):
    """M3: 3-fold cross-validated AUC of the 108 points of the model grid."""
    scores = _model(_frame(fx))[1]
    return scores.select(*bo.GRID, "trees", r6("auc").alias("auc"), F.array_join(F.transform("fold_auc", lambda x: F.round(x, 6).cast("string")), ",").alias("fold_auc"))


@query("ctr_model_scores")
def ctr_model_scores(fx):
    """M3/M6: the grid's best model, scores on the test split."""
    frame = _frame(fx)
    s = bo.scored(frame.where(F.col("split") == "test"), _model(frame)[0])
    return s.select("event_id", "label", "score")


@query("model_scored_candidates")
def model_scored_candidates(fx):
    """M6: the recall candidates scored by the grid's best model on the users'
    and items' latest daily features (the popularity fallback is
    ``score_candidates``)."""
    b, p = fx.shared_behaviors, _recall_parts(fx)
    views = _views(fx, b)
    user, item = (ao.latest_rows(v.df, v.keys, "event_timestamp").select(*v.keys, *v.features) for v in views)
    model = _model(_frame(fx, b))[0]
    # the bins of a candidate are those of its user and those of its item
    of_user, of_item = FEATURES[:2], [*FEATURES[2:], "category_id"]
    users = user.select("user_id", model.binning.cell(of_user).alias("_u"))
    items = (p["pop"].select("item_id", "category_id").join(item, "item_id", "full_outer")
             .select("item_id", "category_id", model.binning.cell(of_item).alias("_i")))
    rows = _candidates(fx, p, of_items=items, of_users=users)
    unknown = model.binning.cell(of_user, blank=True), model.binning.cell(of_item, blank=True)
    s = bo.scored(rows, model, cell=F.coalesce("_u", unknown[0]) + F.coalesce("_i", unknown[1]))
    return s.select("user_id", "item_id", "path", "category_id", "score")


@query("permutation_importance")
def permutation_importance(fx):
    """M5: AUC drop of the grid's best model on the test split when one feature is permuted."""
    frame = _frame(fx)
    test = frame.where(F.col("split") == "test").select("event_id", "label", "category_id", *FEATURES)
    return bo.permutation_importance(test, _model(frame)[0], FEATURES)


@query("als_recommendations")
def als_recommendations(fx):
    """M4: implicit ALS top-10 of each user's recall candidates."""
    return ml.als_top_n(ml.interaction_matrix(fx.shared_behaviors), _candidates(fx), 10)
