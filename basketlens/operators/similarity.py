"""Item co-occurrence, Jaccard similarity and top-N lists.

Co-occurrence counts unordered purchase pairs per user with multiplicity, as
``combinations(sorted(items), 2)`` over each user's purchase list would:
an item bought ``m`` times gives ``m*(m-1)/2`` self pairs and two items give
``m_i*m_j`` pairs. It is computed natively: purchases are pre-aggregated to
(user, item, m) and self-joined. The pair rows of a user are the result
itself, so they cannot be avoided, but they are never produced by one task:
a user with ``d`` distinct items has their items hashed into
``B = ceil(d / block_items)`` blocks and the join key is (user, block_i,
block_j), so a buyer holding a third of all purchases is spread over ``B*B``
tasks of at most ``block_items**2`` pairs. Ordinary users have ``B = 1`` and
no replication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purchase_multiplicity(b: DataFrame) -> DataFrame:
    """(user_id, item_id, m): purchases per user and item (map-side combined)."""
    return (b.where(F.col("action") == "purchase")
             .groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("m")))


def item_cooccurrence(b: DataFrame, block_items: int = 2048) -> DataFrame:
    """A5: (item_i, item_j, cooccurrence) with item_i <= item_j."""
    m = purchase_multiplicity(b)
    deg = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("_d"))
    mb = (m.join(deg, "user_id")
           .withColumn("_B", F.greatest(F.lit(1), F.ceil(F.col("_d") / F.lit(block_items))).cast("int"))
           .withColumn("_blk", F.pmod(F.xxhash64("item_id"), F.col("_B")).cast("int")))
    left = mb.select("user_id", F.col("item_id").alias("item_i"), F.col("m").alias("m_i"),
                     F.col("_blk").alias("_p"),
                     F.explode(F.sequence(F.lit(0), F.col("_B") - 1)).alias("_q"))
    right = mb.select("user_id", F.col("item_id").alias("item_j"), F.col("m").alias("m_j"),
                      F.col("_blk").alias("_q"),
                      F.explode(F.sequence(F.lit(0), F.col("_B") - 1)).alias("_p"))
    pairs = left.join(right, ["user_id", "_p", "_q"]).where(F.col("item_i") <= F.col("item_j"))
    contrib = (F.when(F.col("item_i") == F.col("item_j"), F.col("m_i") * (F.col("m_i") - 1) / 2)
                .otherwise(F.col("m_i") * F.col("m_j"))).cast("bigint")
    return (pairs.select("item_i", "item_j", contrib.alias("c")).where(F.col("c") > 0)
                 .groupBy("item_i", "item_j").agg(F.sum("c").alias("cooccurrence")))


def item_marginals(b: DataFrame) -> DataFrame:
    """Symmetric marginal of every item straight from (user, item, m), without
    the pair table: the pairs containing ``i`` sum to
    ``sum_u m_ui * (M_u - m_ui) + m_ui * (m_ui - 1) / 2`` (M_u = the user's
    purchases), so the heavy self-join is not recomputed for the marginals."""
    m = purchase_multiplicity(b)
    tot = m.groupBy("user_id").agg(F.sum("m").alias("_M"))
    c = (F.col("m") * (F.col("_M") - F.col("m")) + F.col("m") * (F.col("m") - 1) / 2).cast("bigint")
    return (m.join(tot, "user_id").groupBy(F.col("item_id").alias("item"))
             .agg(F.sum(c).alias("item_count")))


def item_similarity(pairs: DataFrame, marginals: DataFrame | None = None) -> DataFrame:
    """J2 (symmetric marginals): ``count(i)`` sums the co-occurrence of every
    pair that contains ``i`` on either side; Jaccard = c / (n_i + n_j - c).
    Pass ``item_marginals(b)`` to avoid re-reading the pairs for the counts."""
    if marginals is not None:
        counts = marginals
    else:
        sides = (pairs.select(F.col("item_i").alias("item"), "cooccurrence")
                      .unionByName(pairs.where(F.col("item_i") != F.col("item_j"))
                                   .select(F.col("item_j").alias("item"), "cooccurrence")))
        counts = sides.groupBy("item").agg(F.sum("cooccurrence").alias("item_count"))
    a = counts.select(F.col("item").alias("item_i"), F.col("item_count").alias("count_i"))
    c = counts.select(F.col("item").alias("item_j"), F.col("item_count").alias("count_j"))
    return (pairs.join(a, "item_i").join(c, "item_j")
                 .select("item_i", "item_j", "cooccurrence",
                         (F.col("cooccurrence") / (F.col("count_i") + F.col("count_j") - F.col("cooccurrence")))
                         .alias("similarity")))


def item_similarity_left(pairs: DataFrame) -> DataFrame:
    """J2 as the reference computes it: marginals over the left item only, so
    pairs whose right item never appears on the left are dropped."""
    counts = pairs.groupBy("item_i").agg(F.sum("cooccurrence").alias("item_count"))
    a = counts.select("item_i", F.col("item_count").alias("count_i"))
    c = counts.select(F.col("item_i").alias("item_j"), F.col("item_count").alias("count_j"))
    return (pairs.join(a, "item_i").join(c, "item_j")
                 .select("item_i", "item_j",
                         (F.col("cooccurrence") / (F.col("count_i") + F.col("count_j") - F.col("cooccurrence")))
                         .alias("similarity")))


def similar_topn(sim: DataFrame, n: int = 11) -> DataFrame:
    """Per item, the ``n`` most similar other items (similarity desc, id asc).
    Both directions of every non-self pair are candidates."""
    both = F.explode(F.array(
        F.struct(F.col("item_i").alias("item_id"), F.col("item_j").alias("similar_item")),
        F.struct(F.col("item_j").alias("item_id"), F.col("item_i").alias("similar_item")))).alias("e")
    edges = (sim.where(F.col("item_i") != F.col("item_j")).select(both, "similarity")
                .select("e.item_id", "e.similar_item", "similarity"))     # one pass, both directions
    w = Window.partitionBy("item_id").orderBy(F.desc("similarity"), F.asc("similar_item"))
    # the filter is on the bare rank: only then is a partial limit planned before the shuffle
    return (edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                 .withColumn("rank", (F.col("rank") - 1).cast("bigint")))


def topn_by_group(df: DataFrame, group: str | None, score: str, item: str, n: int) -> DataFrame:
    """``n`` best items per group by score desc, item asc (0-based rank).
    Without a group this is a global top-n (TakeOrderedAndProject)."""
    if group is None:
        top = df.orderBy(F.desc(score), F.asc(item)).limit(n)
        w = Window.orderBy(F.desc(score), F.asc(item))  # over at most n rows
        return top.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
              .withColumn("rank", (F.col("rank") - 1).cast("bigint")))
