"""Batch recommendation for all users in one job (J8-J12, U1, U2, L2, L4,
M6, M8, M9, P12, X3, W11).

recall (three paths) -> exclude -> score -> MMR re-rank -> cut -> reason.

* The global popular list is attached to every user as a bounded array
  (scalar subquery over the top-k), so there is no cross join.
* Every per-user array is bounded by the recall design (recent 6 x similar
  11 + popular 101 + top-3 categories x 31 candidates), never by the data.
* MMR is a greedy, order-dependent fold; it runs over user-clustered Arrow
  batches in ``mapInPandas``, all users of a batch at a time, or natively as
  ``aggregate`` over the user's sorted candidate array (same result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import try_ratio
from ..sources.shared import materialize
from .sequences import _shuffle_partitions

# Recall sizes (top-N list lengths) and the MMR settings.
RECENT_FOR_RECALL = 6
SIMILAR_PER_ITEM = 11
POPULAR_N = 101
CATEGORY_N = 31
MMR_MAX_SELECT = 50
MMR_LAMBDA = 0.5
NUM_RECOMMENDATIONS = 20
USERS_PER_TASK = 4_000   # whose candidates (some 260 each at most) are held together, about
# Recommendation reasons (recently viewed / popular / for you).
REASON_RECENT = "因为您最近浏览过类似商品"
REASON_POPULAR = "热门推荐"
REASON_DEFAULT = "猜你喜欢"
PATH_SIMILAR, PATH_POPULAR, PATH_CATEGORY = 1, 2, 3


def recent_for_recall(b: DataFrame, n: int = RECENT_FOR_RECALL) -> DataFrame:
    """Each user's n most recent items (duplicates kept)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    # the filter is on the bare rank: only then is a partial limit planned before the shuffle
    return (b.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
             .select("user_id", F.col("item_id").alias("recent_item"), (F.col("_r") - 1).alias("recent_rank")))


def recall_similar(recent: DataFrame, similar_top: DataFrame) -> DataFrame:
    """Items similar to the user's recent items."""
    return (recent.join(similar_top.select(F.col("item_id").alias("recent_item"), "similar_item"), "recent_item")
                  .select("user_id", F.col("similar_item").alias("item_id"),
                          F.lit(PATH_SIMILAR).alias("path")))


def recall_popular(users: DataFrame, popular_top: DataFrame) -> DataFrame:
    """The global popular list for every user. The list (<= POPULAR_N
    items) is one bounded array from a scalar subquery; each user explodes
    it locally, so there is no cross join and no shuffle."""
    arr = popular_top.select(F.collect_list("item_id")).scalar()
    return users.select("user_id", F.explode(arr).alias("item_id"), F.lit(PATH_POPULAR).alias("path"))


def recall_category(top_cats: DataFrame, category_top: DataFrame) -> DataFrame:
    """Top items of each of the user's top categories."""
    uc = top_cats.select("user_id", F.explode("top_categories").alias("category_id"))
    return (uc.join(category_top.select("category_id", "item_id"), "category_id")
              .select("user_id", "item_id", F.lit(PATH_CATEGORY).alias("path")))


def recall_candidates(paths: list[DataFrame], exclude: DataFrame | None = None,
                      cap: int | None = None) -> DataFrame:
    """Distinct union of the paths (keeping the best path as
    provenance), minus the exclude list; optional cap per user by path
    priority then item id (off by default: every candidate is scored)."""
    u = paths[0]
    for p in paths[1:]:
        u = u.unionByName(p)
    c = u.groupBy("user_id", "item_id").agg(F.min("path").alias("path"))
    if exclude is not None:
        c = c.join(exclude.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    if cap is not None:
        w = Window.partitionBy("user_id").orderBy("path", "item_id")
        c = c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return c


def user_parts(users: DataFrame) -> int:
    """Tasks that rows of all users are dealt to: about USERS_PER_TASK users
    each, whose candidates the recall design bounds; never fewer than the
    session's shuffle partitions."""
    return max(_shuffle_partitions(users.sparkSession), -(-users.count() // USERS_PER_TASK))


def merge_popular(users: DataFrame, recalled: DataFrame, popular_top: DataFrame, exclude: DataFrame | None = None,
                  of_items: DataFrame | None = None, of_users: DataFrame | None = None) -> DataFrame:
    """U1/U2/J11 with the popular list merged inside each user's row: the
    recalled (user, item, path) rows, distinct and without the exclude list,
    are written once; to each user's row come the popular items that it was
    recalled or excludes, and the rest of the popular list is exploded there.
    So the popular list, the same for all users, is never shuffled. Paths are
    those of ``recall_candidates``: an item keeps its best path.

    ``of_items`` (by item_id) and ``of_users`` (by user_id) are left joined:
    popular items, which all users have, meet their rows by broadcast, and a
    user's columns are joined before the list is exploded. So no task gets all
    rows of a popular item."""
    popular = popular_top.agg(F.sort_array(F.collect_list("item_id")).alias("p"))  # at most POPULAR_N items
    p = popular.select("p").scalar()
    n = user_parts(users)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "user_id")

    # dealt before they are summed: the lists fan out from small tables, which are read by few tasks
    r = dealt(recalled.select("user_id", "item_id", "path")).groupBy("user_id", "item_id").agg(F.min("path").alias("path"))
    rows = dealt(users.select("user_id")).distinct()
    if exclude is not None:
        out = dealt(exclude.select("user_id", "item_id")).distinct()
        r = r.join(out, ["user_id", "item_id"], "left_anti")
        barred = dealt(exclude.join(F.broadcast(popular_top.select("item_id")), "item_id", "left_semi").select("user_id", "item_id"))
        rows = rows.join(barred.groupBy("user_id").agg(F.collect_set("item_id").alias("_out")), "user_id", "left")
    else:
        rows = rows.withColumn("_out", F.lit(None).cast("array<bigint>"))
    r = materialize(r, "recalled")
    shared = F.array_contains(p, F.col("item_id"))
    own = r.select("user_id", "item_id", F.when(shared, F.least("path", F.lit(PATH_POPULAR))).otherwise(F.col("path")).alias("path"))
    # every recalled user, with the popular items among theirs
    mine = dealt(r.select("user_id", F.when(shared, F.col("item_id")).alias("_i"))).groupBy("user_id").agg(F.collect_set("_i").alias("_mine"))
    rows = rows.join(mine, "user_id", "full_outer")
    if of_users is not None:
        rows, own = (x.join(dealt(of_users), "user_id", "left") for x in (rows, dealt(own)))
    none = F.array().cast("array<bigint>")
    rest = F.array_except(F.array_except(p, F.coalesce("_out", none)), F.coalesce("_mine", none))
    more = rows.select(*[c for c in rows.columns if c not in ("_out", "_mine")], F.explode(rest).alias("item_id"), F.lit(PATH_POPULAR).alias("path"))
    if of_items is not None:
        own = own.join(of_items, "item_id", "left")
        more = more.join(F.broadcast(of_items.join(F.broadcast(popular_top.select("item_id").distinct()), "item_id", "left_semi")), "item_id", "left")
    out = more.unionByName(own)
    return out.select("user_id", "item_id", "path", *[c for c in out.columns if c not in ("user_id", "item_id", "path")])


def recent_purchases(b: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Exclude list: items the user bought in the ``days`` before as_of."""
    return (b.where((F.col("action") == "purchase")
                    & (F.col("ts") > as_of - F.make_dt_interval(F.lit(days))))
             .select("user_id", "item_id").distinct())


def score_candidates(cands: DataFrame, item_features: DataFrame | None = None, model=None,
                     feature_cols: list[str] | None = None) -> DataFrame:
    """Join item features (unless ``merge_popular`` did); score with the
    model's positive-class probability, or fall back to the item's popularity
    (0 when unknown)."""
    j = cands if item_features is None else cands.join(item_features, "item_id", "left")
    if model is None:
        return j.withColumn("score", F.coalesce(F.col("popularity_score"), F.lit(0.0)))
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(j)
    return (scored.withColumn("score", F.coalesce(vector_to_array("probability")[1],
                                                  F.col("popularity_score"), F.lit(0.0)))
                  .drop("probability", "rawPrediction", "prediction", "features"))


def _cat_sim(a: Column, b: Column) -> Column:
    """P13 on two category strings (both already null-free)."""
    return (F.when(a == b, F.lit(0.8))
             .when((F.length(a) > 0) & (F.length(b) > 0) & (F.substring(a, 1, 3) == F.substring(b, 1, 3)),
                   F.lit(0.5))
             .otherwise(F.lit(0.1)))


def mmr_rerank(scored: DataFrame, lam: Column | float = MMR_LAMBDA,
               max_select: int = MMR_MAX_SELECT, engine: str = "pandas", parts: int | None = None) -> DataFrame:
    """Maximal Marginal Relevance per user.

    ``engine="pandas"`` (default) runs the greedy steps with numpy in
    ``mapInPandas``; ``engine="native"`` runs the same fold as
    Spark higher-order functions (no Python worker, but interpreted lambdas).
    Both give identical output. Users are dealt to ``parts`` tasks (default:
    the shuffle partitions; ``user_parts`` bounds what a task sorts).

    Candidates are ordered by score desc (item id asc on ties); the first is
    taken, then repeatedly the candidate maximising
    ``lam * score - (1 - lam) * max_sim(candidate, selected)`` (the earliest
    wins ties) until ``min(max_select, n)`` are selected. Output: user_id,
    item_id, score, category_id, mmr_rank (0-based).

    The fold state keeps, per remaining candidate, its running max similarity
    to the selected set, so each step is linear in the candidates; the chosen
    candidate is bound once per step with ``transform(array(x), b -> ...)[0]``.
    """
    lam_col = lam if isinstance(lam, Column) else F.lit(float(lam))
    d = scored.withColumn("_lam", lam_col.cast("double"))
    if engine == "pandas":
        return _mmr_pandas(d, max_select, parts)
    per_user = d.groupBy("user_id").agg(
        F.max("_lam").alias("_lam"),
        F.sort_array(F.collect_list(F.struct(
            (-F.col("score")).alias("neg_score"), F.col("item_id"),
            F.coalesce(F.col("category_id"), F.lit("")).alias("cat")))).alias("_c"))
    n = F.size("_c")
    steps = F.when(n <= 1, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(1), F.least(F.lit(max_select), n) - 1))
    first = F.col("_c")[0]
    init = F.struct(
        F.slice("_c", 1, 1).alias("sel"),
        F.transform(F.slice("_c", 2, 1 << 30), lambda c, i: F.struct(
            c.alias("c"), i.alias("i"), _cat_sim(c["cat"], first["cat"]).alias("ms"))).alias("rem"))
    lam_v = F.col("_lam")

    def step(state, _):
        cand = F.transform(state["rem"], lambda r: F.struct(
            (lam_v * (-r["c"]["neg_score"]) - (F.lit(1.0) - lam_v) * r["ms"]).alias("m"),
            (-r["i"]).alias("neg_i"), r["c"].alias("c")))
        return F.transform(F.array(F.array_max(cand)), lambda best: F.struct(
            F.concat(state["sel"], F.array(best["c"])).alias("sel"),
            F.transform(F.filter(state["rem"], lambda r: r["i"] != -best["neg_i"]), lambda r: F.struct(
                r["c"].alias("c"), r["i"].alias("i"),
                F.greatest(r["ms"], _cat_sim(r["c"]["cat"], best["c"]["cat"])).alias("ms"))).alias("rem")))[0]

    picked = per_user.select("user_id", F.aggregate(steps, init, step)["sel"].alias("_sel"))
    return picked.select("user_id", F.posexplode("_sel").alias("mmr_rank", "s")).select(
        "user_id", F.col("s.item_id").alias("item_id"), (-F.col("s.neg_score")).alias("score"),
        F.col("s.cat").alias("category_id"), F.col("mmr_rank").cast("bigint").alias("mmr_rank"))


def mmr_select_many(score, code, prefix, nonempty, lam, starts, sizes, max_select: int):
    """Greedy MMR for many users at once: each user's candidates, sorted
    (score desc, id asc), are laid out in a padded (users x max candidates)
    matrix and all users advance one step per iteration; the first index wins
    ties. ``code``: category codes, ``prefix``: 3-char prefix codes,
    ``nonempty``: category is non-empty. Returns, per user, the chosen row
    positions in order."""
    import numpy as np

    n_users = len(starts)
    if n_users == 0:
        return []
    width = int(sizes.max())
    rows = np.repeat(np.arange(n_users), sizes)
    cols = np.arange(len(score)) - np.repeat(starts, sizes)
    sc = np.full((n_users, width), -np.inf)
    cd = np.full((n_users, width), -1, dtype=np.int64)
    pf = np.full((n_users, width), -2, dtype=np.int64)
    ne = np.zeros((n_users, width), dtype=bool)
    sc[rows, cols], cd[rows, cols], pf[rows, cols], ne[rows, cols] = score, code, prefix, nonempty
    alive = np.zeros((n_users, width), dtype=bool)
    alive[rows, cols] = True
    steps = np.minimum(max_select, sizes)
    chosen = np.zeros((n_users, int(steps.max())), dtype=np.int64)
    alive[:, 0] = False
    max_sim = np.full((n_users, width), 0.1)
    every = np.arange(n_users)
    lam_col = lam[:, None]

    def absorb(j, who):
        same = cd[who] == cd[who, j[who]][:, None]
        pre = ne[who] & ne[who, j[who]][:, None] & (pf[who] == pf[who, j[who]][:, None])
        max_sim[who] = np.maximum(max_sim[who], np.where(same, 0.8, np.where(pre, 0.5, 0.1)))

    absorb(np.zeros(n_users, dtype=np.int64), every)
    for k in range(1, chosen.shape[1]):
        who = every[steps > k]
        mmr = np.where(alive[who], lam_col[who] * sc[who] - (1.0 - lam_col[who]) * max_sim[who], -np.inf)
        j = np.zeros(n_users, dtype=np.int64)
        j[who] = np.argmax(mmr, axis=1)          # first index wins ties
        chosen[who, k] = j[who]
        alive[who, j[who]] = False
        absorb(j, who)
    return [starts[u] + chosen[u, :steps[u]] for u in range(n_users)]


MMR_SCHEMA = "user_id long, item_id long, score double, category_id string, mmr_rank long"


def _mmr_batches(batches, max_select: int):
    """Rows arrive clustered by user and sorted (user, score desc, item asc);
    a user's rows may span Arrow batches, so the open user is carried over."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        users = pdf["user_id"].to_numpy()
        cats = pdf["category_id"].fillna("").astype(str)
        starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
        sizes = np.diff(np.r_[starts, len(users)])
        picks = mmr_select_many(pdf["score"].to_numpy(dtype=np.float64), pd.factorize(cats)[0],
                                pd.factorize(cats.str.slice(0, 3))[0], (cats.str.len() > 0).to_numpy(),
                                pdf["_lam"].to_numpy(dtype=np.float64)[starts], starts, sizes, max_select)
        pos = np.concatenate(picks) if picks else np.zeros(0, dtype=np.int64)
        out = pdf.iloc[pos][["user_id", "item_id", "score", "category_id"]].copy()
        out["category_id"] = out["category_id"].fillna("")
        out["mmr_rank"] = np.concatenate([np.arange(len(p)) for p in picks]).astype(np.int64) if picks \
            else np.zeros(0, dtype=np.int64)
        return out

    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        last = pdf["user_id"].iloc[-1]
        tail = pdf["user_id"].to_numpy() == last
        carry = pdf[tail].reset_index(drop=True)
        done = pdf[~tail].reset_index(drop=True)
        if len(done):
            yield run(done)
    if carry is not None and len(carry):
        yield run(carry)


def _mmr_pandas(d: DataFrame, max_select: int, parts: int | None = None) -> DataFrame:
    cols = d.select("user_id", "item_id", F.col("score").cast("double").alias("score"),
                    "category_id", "_lam")
    n_parts = parts or _shuffle_partitions(d.sparkSession)
    # by a hash that no input is dealt by: a shuffle left out as done already binds no one, and AQE may then part a user's rows
    clustered = (cols.repartition(n_parts, F.xxhash64("user_id"))
                     .sortWithinPartitions("user_id", F.desc("score"), F.asc("item_id")))
    return clustered.mapInPandas(lambda it: _mmr_batches(it, max_select), MMR_SCHEMA)


def with_reasons(recs: DataFrame, recent_items: DataFrame, item_stats: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Recently viewed > popular (purchase_rate > 0.1) > default. Rows of
    the ``frequent`` items (few, recommended to nearly all users) meet their
    rate by broadcast; for the join of the others they are dealt by user, so
    that no task gets all rows of one item."""
    stats, on = item_stats.select("item_id", "purchase_rate"), ["item_id"]
    j = recs.join(recent_items.select("user_id", "recent_items"), "user_id", "left")
    if frequent is not None:
        few = frequent.select("item_id").distinct()
        rates = stats.join(F.broadcast(few), "item_id", "left_semi").withColumnRenamed("purchase_rate", "_rate")
        j = j.join(F.broadcast(few.withColumn("_few", F.lit(True))), "item_id", "left").join(F.broadcast(rates), "item_id", "left")
        # below 0: matches nothing
        j = j.withColumn("_deal", F.when(F.col("_few"), -1 - F.pmod(F.xxhash64("user_id"), F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
        stats, on = stats.withColumn("_deal", F.lit(0).cast("long")), ["item_id", "_deal"]
    j = j.join(stats, on, "left")
    if frequent is not None:
        j = j.withColumn("purchase_rate", F.coalesce("_rate", "purchase_rate")).drop("_few", "_rate", "_deal")
    reason = (F.when(F.coalesce(F.array_contains("recent_items", F.col("item_id")), F.lit(False)),
                     F.lit(REASON_RECENT))
               .when(F.coalesce(F.col("purchase_rate"), F.lit(0.0)) > 0.1, F.lit(REASON_POPULAR))
               .otherwise(F.lit(REASON_DEFAULT)))
    return j.withColumn("reason", reason).drop("recent_items", "purchase_rate")


def cut(recs: DataFrame, n: int = NUM_RECOMMENDATIONS) -> DataFrame:
    """L2: keep the first ``n`` of each user's re-ranked list."""
    return recs.where(F.col("mmr_rank") < n)


def impressions(recs: DataFrame, request_ts: Column) -> DataFrame:
    """Impression events (position = 0-based rank) as JSON rows."""
    ev = recs.select("user_id", "item_id", F.col("mmr_rank").alias("position"),
                     F.lit("impression").alias("action"),
                     F.concat_ws("-", F.lit("batch"), F.col("user_id").cast("string")).alias("request_id"),
                     request_ts.alias("timestamp"))
    return ev.withColumn("value", F.to_json(F.struct(*ev.columns)))
