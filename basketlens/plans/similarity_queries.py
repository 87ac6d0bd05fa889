"""Queries over co-occurrence, similarity and top-N lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import features as ft
from ..operators import similarity as sm
from ..sources.shared import materialize
from .registry import query

COOC_SQL = """
SELECT a.item_id AS item_i, b.item_id AS item_j,
       CAST(sum(CASE WHEN a.item_id = b.item_id THEN a.m * (a.m - 1) // 2 ELSE a.m * b.m END) AS BIGINT)
         AS cooccurrence
FROM (SELECT user_id, item_id, count(*) AS m FROM behaviors WHERE action = 'purchase' GROUP BY ALL) a
JOIN (SELECT user_id, item_id, count(*) AS m FROM behaviors WHERE action = 'purchase' GROUP BY ALL) b
  ON a.user_id = b.user_id AND a.item_id <= b.item_id
GROUP BY ALL HAVING sum(CASE WHEN a.item_id = b.item_id THEN a.m * (a.m - 1) // 2 ELSE a.m * b.m END) > 0"""

SIM_SQL = f"""
SELECT p.item_i, p.item_j, p.cooccurrence,
       p.cooccurrence / (a.n + b.n - p.cooccurrence) AS similarity
FROM ({COOC_SQL}) p
JOIN (SELECT item, sum(cooccurrence) AS n FROM (
        SELECT item_i AS item, cooccurrence FROM ({COOC_SQL})
        UNION ALL SELECT item_j, cooccurrence FROM ({COOC_SQL}) WHERE item_i <> item_j) GROUP BY item) a
  ON a.item = p.item_i
JOIN (SELECT item, sum(cooccurrence) AS n FROM (
        SELECT item_i AS item, cooccurrence FROM ({COOC_SQL})
        UNION ALL SELECT item_j, cooccurrence FROM ({COOC_SQL}) WHERE item_i <> item_j) GROUP BY item) b
  ON b.item = p.item_j"""

POP_SQL = """
SELECT i.item_id, i.category_id,
       ln(1 + coalesce(count(b.action) FILTER (WHERE b.action = 'click'), 0)
            + 3 * coalesce(count(b.action) FILTER (WHERE b.action = 'add_to_cart'), 0)
            + 5 * coalesce(count(b.action) FILTER (WHERE b.action = 'purchase'), 0)) AS popularity_score
FROM items i LEFT JOIN behaviors b ON b.item_id = i.item_id GROUP BY ALL"""


def catalogue_popularity(fx, behaviors=None):
    """Every catalogue item with its A18 score (0 without behaviour)."""
    pop = ft.item_popularity(fx.behaviors if behaviors is None else behaviors)
    return (fx.items.select("item_id", "category_id").join(pop, "item_id", "left")
              .withColumn("popularity_score", F.coalesce("popularity_score", F.lit(0.0))))


@query("item_cooccurrence", views=("behaviors",), oracle=COOC_SQL)
def item_cooccurrence(fx):
    """Purchase co-occurrence counts (native, block-salted self-join)."""
    return sm.item_cooccurrence(fx.behaviors)


@query("item_similarity", views=("behaviors",), oracle=SIM_SQL)
def item_similarity(fx):
    """Jaccard similarity with symmetric marginals."""
    return sm.item_similarity(sm.item_cooccurrence(fx.behaviors), sm.item_marginals(fx.behaviors))


@query("item_similarity_left", views=("behaviors",), oracle=f"""
SELECT p.item_i, p.item_j, p.cooccurrence / (a.n + b.n - p.cooccurrence) AS similarity
FROM ({COOC_SQL}) p
JOIN (SELECT item_i, sum(cooccurrence) AS n FROM ({COOC_SQL}) GROUP BY item_i) a ON a.item_i = p.item_i
JOIN (SELECT item_i, sum(cooccurrence) AS n FROM ({COOC_SQL}) GROUP BY item_i) b ON b.item_i = p.item_j""")
def item_similarity_left(fx):
    """J2 (reference form): left-side marginals only."""
    pairs = materialize(sm.item_cooccurrence(fx.behaviors), "cooccurrence")  # read for the pairs and both counts
    return sm.item_similarity_left(pairs)


@query("similar_topn", views=("behaviors",), oracle=f"""
SELECT item_id, similar_item, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, similar_item) - 1 AS rank
  FROM (SELECT item_i AS item_id, item_j AS similar_item, similarity FROM ({SIM_SQL}) WHERE item_i <> item_j
        UNION ALL
        SELECT item_j, item_i, similarity FROM ({SIM_SQL}) WHERE item_i <> item_j))
WHERE rank < 11""")
def similar_topn(fx):
    """Top-11 similar items per item."""
    return sm.similar_topn(sm.item_similarity(sm.item_cooccurrence(fx.behaviors), sm.item_marginals(fx.behaviors))).select(
        "item_id", "similar_item", "similarity", "rank")


@query("popular_topn", views=("behaviors", "items"), oracle=f"""
SELECT item_id, round(popularity_score, 6) AS popularity_score,
       row_number() OVER (ORDER BY popularity_score DESC, item_id) - 1 AS rank
FROM ({POP_SQL}) ORDER BY popularity_score DESC, item_id LIMIT 101""")
def popular_topn(fx):
    """Global top-101 popular items (the top-k is the feature)."""
    top = sm.topn_by_group(catalogue_popularity(fx), None, "popularity_score", "item_id", 101)
    return top.select("item_id", r6("popularity_score").alias("popularity_score"), "rank")


@query("category_topn", views=("behaviors", "items"), oracle=f"""
SELECT category_id, item_id, round(popularity_score, 6) AS popularity_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY popularity_score DESC, item_id) - 1 AS rank
  FROM ({POP_SQL})) WHERE rank < 31""")
def category_topn(fx):
    """Top-31 items per category by popularity."""
    top = sm.topn_by_group(catalogue_popularity(fx), "category_id", "popularity_score", "item_id", 31)
    return top.select("category_id", "item_id", r6("popularity_score").alias("popularity_score"), "rank")
