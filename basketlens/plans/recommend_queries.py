"""Recommendation queries: recall paths, candidates, scores, MMR, reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import category_sim, r6
from ..operators import experiments as ex
from ..operators import features as ft
from ..operators import recommend as rc
from ..operators import similarity as sm
from ..sources.shared import materialize
from .experiment_queries import EXP_VIEWS
from .registry import query
from .similarity_queries import POP_SQL, SIM_SQL, catalogue_popularity

RECENT6_SQL = """
SELECT user_id, item_id AS recent_item FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM behaviors) WHERE r <= 6"""
SIMTOP_SQL = f"""
SELECT item_id, similar_item FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, similar_item) AS r
  FROM (SELECT item_i AS item_id, item_j AS similar_item, similarity FROM ({SIM_SQL}) WHERE item_i <> item_j
        UNION ALL SELECT item_j, item_i, similarity FROM ({SIM_SQL}) WHERE item_i <> item_j)) WHERE r <= 11"""
POPTOP_SQL = f"SELECT item_id FROM ({POP_SQL}) ORDER BY popularity_score DESC, item_id LIMIT 101"
CATTOP_SQL = f"""
SELECT category_id, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY popularity_score DESC, item_id) AS r
  FROM ({POP_SQL})) WHERE r <= 31"""
TOPCAT3_SQL = """
SELECT user_id, category_id FROM (
  SELECT user_id, category_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_id) AS r
  FROM (SELECT user_id, category_id, count(*) AS n FROM behaviors WHERE action = 'purchase' GROUP BY ALL))
WHERE r <= 3"""
REC_SIM_SQL = f"""
SELECT DISTINCT r.user_id, s.similar_item AS item_id, 1 AS path
FROM ({RECENT6_SQL}) r JOIN ({SIMTOP_SQL}) s ON s.item_id = r.recent_item"""
REC_POP_SQL = f"SELECT c_custkey AS user_id, p.item_id, 2 AS path FROM customer, ({POPTOP_SQL}) p"
REC_CAT_SQL = f"""
SELECT DISTINCT t.user_id, c.item_id, 3 AS path FROM ({TOPCAT3_SQL}) t JOIN ({CATTOP_SQL}) c USING (category_id)"""
CANDS_SQL = f"""
SELECT user_id, item_id, min(path) AS path FROM (
  {REC_SIM_SQL} UNION ALL {REC_POP_SQL} UNION ALL {REC_CAT_SQL}) u
WHERE NOT EXISTS (SELECT 1 FROM behaviors b WHERE b.user_id = u.user_id AND b.item_id = u.item_id
                  AND b.action = 'purchase' AND b.ts > (SELECT as_of FROM as_of_t) - INTERVAL 7 DAY)
GROUP BY user_id, item_id"""
SCORED_SQL = f"""
SELECT c.user_id, c.item_id, c.path, p.category_id, round(coalesce(p.popularity_score, 0.0), 6) AS score
FROM ({CANDS_SQL}) c LEFT JOIN ({POP_SQL}) p ON p.item_id = c.item_id"""
VIEWS = ("behaviors", "items", "as_of_t")


def _recall_parts(fx):
    b = fx.shared_behaviors
    pop = materialize(catalogue_popularity(fx, b), "popularity")  # read by three paths and the scores
    sim_top = sm.similar_topn(sm.item_similarity(sm.item_cooccurrence(b), sm.item_marginals(b)), rc.SIMILAR_PER_ITEM)
    popular = sm.topn_by_group(pop, None, "popularity_score", "item_id", rc.POPULAR_N)
    cat_top = sm.topn_by_group(pop, "category_id", "popularity_score", "item_id", rc.CATEGORY_N)
    return {
        "similar": rc.recall_similar(rc.recent_for_recall(b), sim_top),
        "popular": rc.recall_popular(fx.users, popular),
        "category": rc.recall_category(ft.top_categories(b), cat_top),
        "popular_top": popular,
        "pop": pop,
    }


def _candidates(fx, parts=None, of_items=None, of_users=None):
    p = parts or _recall_parts(fx)
    return rc.merge_popular(fx.users, p["similar"].unionByName(p["category"]), p["popular_top"],
                            exclude=rc.recent_purchases(fx.shared_behaviors, fx.as_of), of_items=of_items, of_users=of_users)


def _scored(fx, parts=None, of_users=None):
    p = parts or _recall_parts(fx)
    cands = _candidates(fx, p, of_items=p["pop"].select("item_id", "category_id", "popularity_score"), of_users=of_users)
    return rc.score_candidates(cands).withColumn("score", r6("score"))


@query("recall_similar", views=VIEWS, oracle=REC_SIM_SQL)
def recall_similar(fx):
    """Recent items x top-11 similar items."""
    return _recall_parts(fx)["similar"].distinct()


@query("recall_popular", views=VIEWS, oracle=REC_POP_SQL)
def recall_popular(fx):
    """Popular top-101 for every user (bounded array, no cross join)."""
    return _recall_parts(fx)["popular"]


@query("recall_category", views=VIEWS, oracle=REC_CAT_SQL)
def recall_category(fx):
    """Top-31 items of each of the user's top-3 categories."""
    return _recall_parts(fx)["category"].distinct()


@query("recall_candidates", views=VIEWS, oracle=CANDS_SQL)
def recall_candidates(fx):
    """Distinct union of recall paths minus recent purchases."""
    return _candidates(fx)


@query("score_candidates", views=VIEWS, oracle=SCORED_SQL)
def score_candidates(fx):
    """Candidate scores (popularity fallback when no model)."""
    return _scored(fx).select("user_id", "item_id", "path", "category_id", "score")


@query("recommend_reason", views=VIEWS, oracle=f"""
WITH rec AS (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',') AS _x, list(item_id) AS recent FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
    FROM behaviors) WHERE r <= 10 GROUP BY user_id),
st AS (SELECT item_id, CASE WHEN count(*) FILTER (WHERE action = 'click') > 0
                  THEN CAST(count(*) FILTER (WHERE action = 'purchase') AS DOUBLE)
                       / count(*) FILTER (WHERE action = 'click') ELSE 0.0 END AS purchase_rate
       FROM behaviors GROUP BY item_id)
SELECT s.user_id, s.item_id,
       CASE WHEN coalesce(list_contains(rec.recent, s.item_id), false) THEN '{rc.REASON_RECENT}'
            WHEN coalesce(st.purchase_rate, 0.0) > 0.1 THEN '{rc.REASON_POPULAR}'
            ELSE '{rc.REASON_DEFAULT}' END AS reason
FROM ({SCORED_SQL}) s LEFT JOIN rec USING (user_id) LEFT JOIN st USING (item_id)""")
def recommend_reason(fx):
    """Reason label of every scored candidate."""
    p = _recall_parts(fx)
    s = _scored(fx, p).withColumnRenamed("path", "mmr_rank")
    r = rc.with_reasons(s, ft.recent_items(fx.shared_behaviors), ft.item_purchase_rate(fx.shared_behaviors), p["popular_top"])
    return r.select("user_id", "item_id", "reason")


@query("category_similarity", views=("behaviors", "items"), oracle="""
WITH m AS (SELECT user_id, item_id, count(*) AS m FROM behaviors WHERE action = 'purchase' GROUP BY ALL),
p AS (SELECT DISTINCT a.item_id AS item_i, b.item_id AS item_j FROM m a JOIN m b
      ON a.user_id = b.user_id AND a.item_id <= b.item_id
      WHERE a.item_id <> b.item_id OR a.m > 1)
SELECT p.item_i, p.item_j, i.category_id AS category_i, j.category_id AS category_j,
       CASE WHEN coalesce(i.category_id, '') = coalesce(j.category_id, '') THEN 0.8e0
            WHEN length(coalesce(i.category_id, '')) > 0 AND length(coalesce(j.category_id, '')) > 0
                 AND substr(i.category_id, 1, 3) = substr(j.category_id, 1, 3) THEN 0.5e0 ELSE 0.1e0 END
         AS category_similarity
FROM p JOIN items i ON i.item_id = p.item_i JOIN items j ON j.item_id = p.item_j""")
def category_similarity(fx):
    """Category similarity of every co-purchased item pair."""
    pairs = sm.item_cooccurrence(fx.behaviors).select("item_i", "item_j")
    it = fx.items.select("item_id", "category_id")
    j = (pairs.join(it.withColumnRenamed("item_id", "item_i").withColumnRenamed("category_id", "category_i"),
                    "item_i")
              .join(it.withColumnRenamed("item_id", "item_j").withColumnRenamed("category_id", "category_j"),
                    "item_j"))
    return j.select("item_i", "item_j", "category_i", "category_j",
                    category_sim("category_i", "category_j").alias("category_similarity"))


def lambdas(fx):
    """The lambda of every user's diversity variant."""
    return (ex.variant_params(ex.assign_variants(fx.users, fx.spark), fx.spark)
              .where(F.col("experiment_id") == "diversity_strategy")
              .select("user_id", F.col("params")["lambda"].cast("double").alias("lam")))


def recommend_all(fx):
    """M8: recall -> score -> MMR (lambda from the user's diversity variant)
    -> top 20 -> reason, for every user."""
    b, p = fx.shared_behaviors, _recall_parts(fx)
    s = _scored(fx, p, of_users=lambdas(fx)).withColumn("lam", F.coalesce("lam", F.lit(rc.MMR_LAMBDA)))
    ranked = rc.cut(rc.mmr_rerank(s, F.col("lam"), parts=rc.user_parts(fx.users)))
    return rc.with_reasons(ranked, ft.recent_items(b), ft.item_purchase_rate(b), p["popular_top"])


# Each user's candidates in order, and 20 greedy steps of the re-ranking.
RECOMMEND_VIEWS = {
    **EXP_VIEWS,
    "lambdas": (("assign",), """
        SELECT user_id, CASE variant WHEN 'treatment_a' THEN 0.3e0 WHEN 'treatment_b' THEN 0.7e0 ELSE 0.5e0 END AS lam
        FROM assign WHERE experiment_id = 'diversity_strategy'"""),
    "ordered": (("lambdas", "behaviors", "items", "as_of_t"), f"""
        SELECT s.user_id, s.item_id, s.score, coalesce(s.category_id, '') AS cat, coalesce(l.lam, {rc.MMR_LAMBDA}e0) AS lam,
               row_number() OVER (PARTITION BY s.user_id ORDER BY s.score DESC, s.item_id) AS pos
        FROM ({SCORED_SQL}) s LEFT JOIN lambdas l USING (user_id)"""),
    "mmr": (("ordered",), f"""
        SELECT user_id, CAST(0 AS BIGINT) AS mmr_rank, item_id, score, cat, [pos] AS taken, [cat] AS cats FROM ordered WHERE pos = 1
        UNION ALL
        SELECT user_id, mmr_rank + 1, item_id, score, cat, list_append(taken, pos), list_append(cats, cat) FROM (
          SELECT m.user_id, m.mmr_rank, c.item_id, c.score, c.cat, m.taken, m.cats, c.pos,
                 row_number() OVER (PARTITION BY m.user_id ORDER BY c.lam * c.score - (1.0e0 - c.lam) * list_max(
                   [CASE WHEN k = c.cat THEN 0.8e0 WHEN length(k) > 0 AND length(c.cat) > 0 AND substr(k, 1, 3) = substr(c.cat, 1, 3)
                         THEN 0.5e0 ELSE 0.1e0 END FOR k IN m.cats]) DESC, c.pos) AS r
          FROM mmr m JOIN ordered c ON c.user_id = m.user_id AND NOT list_contains(m.taken, c.pos)
          WHERE m.mmr_rank + 1 < {rc.NUM_RECOMMENDATIONS}) WHERE r = 1""", True),
}
RECOMMEND_SQL = f"""
SELECT m.user_id, m.mmr_rank, m.item_id, m.score, m.cat AS category_id,
       CASE WHEN coalesce(list_contains(rec.recent, m.item_id), false) THEN '{rc.REASON_RECENT}'
            WHEN coalesce(st.purchase_rate, 0.0) > 0.1 THEN '{rc.REASON_POPULAR}'
            ELSE '{rc.REASON_DEFAULT}' END AS reason
FROM mmr m LEFT JOIN (
  SELECT user_id, list(item_id) AS recent FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
    FROM behaviors) WHERE r <= 10 GROUP BY user_id) rec USING (user_id)
LEFT JOIN (
  SELECT item_id, CASE WHEN count(*) FILTER (WHERE action = 'click') > 0
                       THEN CAST(count(*) FILTER (WHERE action = 'purchase') AS DOUBLE)
                            / count(*) FILTER (WHERE action = 'click') ELSE 0.0 END AS purchase_rate
  FROM behaviors GROUP BY item_id) st USING (item_id)"""


@query("recommend", views=("mmr", "behaviors"), extra_views=RECOMMEND_VIEWS, oracle=RECOMMEND_SQL)
def recommend(fx):
    """Top-20 diversified recommendations with reasons for all
    users."""
    return recommend_all(fx).select("user_id", "mmr_rank", "item_id", "score", "category_id", "reason")


@query("impressions", views=("mmr", "as_of_t"), extra_views=RECOMMEND_VIEWS, oracle="""
SELECT user_id, item_id, mmr_rank AS position, 'batch-' || user_id AS request_id,
       '{"user_id":' || user_id || ',"item_id":' || item_id || ',"position":' || mmr_rank
       || ',"action":"impression","request_id":"batch-' || user_id || '","timestamp":"'
       || strftime((SELECT as_of FROM as_of_t), '%Y-%m-%dT%H:%M:%S.%g') || '"}' AS value
FROM mmr""")
def impressions(fx):
    """Impression events (JSON) for the batch recommendations."""
    return rc.impressions(recommend_all(fx), fx.as_of).select(
        "user_id", "item_id", "position", "request_id", "value")
