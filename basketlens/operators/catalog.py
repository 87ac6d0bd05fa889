"""Catalogue: product views, validation, search, category tree
(P5, P6, P10, P11, P14, J16, J20, A20, T1-T3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def products(part: DataFrame) -> DataFrame:
    """Product rows over ``part`` (FIXTURES.md section 3)."""
    return part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") - 5).alias("stock"),
        F.when(F.col("p_type") == "PROMO", "OFF_SHELF").otherwise("AVAILABLE").alias("status"),
        F.col("p_type").alias("category_id"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
        .alias("specs"))


def page_rank(df: DataFrame, order: list[Column], partition: str | None = None,
              page_size: int = 20) -> DataFrame:
    """0-based rank and page number in a total order; the whole result is
    kept (a page is ``where(page == n)``). Ranks come from a distributed
    range sort, never from a single-partition or per-group window."""
    from .sequences import global_rank, rank_within
    if partition is None:
        keyed = df.withColumn("_k", F.struct(*order))
        r = global_rank(keyed, "_k", out="_r").drop("_k", "_r_ties")
        r = r.withColumn("rank", (F.col("_r") - 1).cast("bigint")).drop("_r")
    else:
        r = rank_within(df, partition, order, out="rank")
    return r.withColumn("page", (F.col("rank") / page_size).cast("bigint"))


def available_products(p: DataFrame) -> DataFrame:
    """P5: in stock and AVAILABLE."""
    return p.where((F.col("stock") > 0) & (F.col("status") == "AVAILABLE"))


def price_range(p: DataFrame, category: str, lo: float, hi: float) -> DataFrame:
    """Category term and price range filter (pushed into the scan)."""
    return p.where((F.col("category_id") == category) & F.col("price").between(lo, hi))


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def keyword_search(p: DataFrame, terms: list[str]) -> DataFrame:
    """Products whose name or description contains any query term."""
    q = F.array(*[F.lit(t.lower()) for t in terms])
    toks = F.concat(tokens(F.col("name")), tokens(F.col("description")))
    return p.where(F.arrays_overlap(toks, q))


def boosted_search(p: DataFrame, terms: list[str]) -> DataFrame:
    """score = 3 * hits(name) + hits(description) + hits(spec values),
    hits = query-term occurrences among the field's tokens (documented simple
    scoring, not BM25); rows with score 0 dropped."""
    q = F.array(*[F.lit(t.lower()) for t in terms])

    def hits(tok: Column) -> Column:
        return F.size(F.filter(tok, lambda t: F.array_contains(q, t)))

    spec_tokens = F.flatten(F.transform(F.map_values("specs"), lambda v: tokens(v)))
    score = 3 * hits(tokens(F.col("name"))) + hits(tokens(F.col("description"))) + hits(spec_tokens)
    return p.withColumn("score", score.cast("bigint")).where(F.col("score") > 0)


#: What a hit in a field counts for.
FIELD_WEIGHT = {"name": 3, "description": 1, "specs": 1}
INDEX_SHARDS = 32
INDEX_ROWS = 50_000      # products of a task that makes posting lists, about


def posting_lists(p: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, field, product_id, hits): how often each term occurs in
    each field of each product. Products are dealt to ``parts`` tasks (default:
    the shuffle partitions) before their terms are taken out: hardly any two
    terms are summed, so sums made while reading would hold a split's terms."""
    from .sequences import _shuffle_partitions

    p = p.select("product_id", "name", "description", "specs").repartition(parts or _shuffle_partitions(p.sparkSession), "product_id")
    fields = {"name": tokens(F.col("name")), "description": tokens(F.col("description")),
              "specs": F.flatten(F.transform(F.map_values("specs"), lambda v: tokens(v)))}
    none = F.expr("cast(array() as array<string>)")

    def named(field: str, terms: Column) -> Column:
        return F.transform(F.coalesce(terms, none), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    found = F.flatten(F.array(*[named(f, t) for f, t in fields.items()]))
    return (p.select("product_id", F.explode(found).alias("x")).groupBy(F.col("x.term").alias("term"), F.col("x.field").alias("field"), "product_id")
            .agg(F.count(F.lit(1)).cast("int").alias("hits")))


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_SHARDS)).cast("int")


def write_index(p: DataFrame, path: str) -> None:
    """Write the posting lists, partitioned by a hash of the term and range
    split by (term, product), so that the list of a frequent term lies in as
    many files as it fills; and the terms' document frequencies."""
    from .sequences import _shuffle_partitions

    n = max(_shuffle_partitions(p.sparkSession), INDEX_SHARDS, -(-p.count() // INDEX_ROWS))
    lists = posting_lists(p, n).withColumn("shard", _shard(F.col("term")))
    (lists.repartitionByRange(n, "shard", "term", "product_id").sortWithinPartitions("shard", "term", "product_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/lists"))
    written = p.sparkSession.read.parquet(f"{path}/lists").select("shard", "term", "product_id")
    once = written.repartition(n, "shard", "term", "product_id").distinct()  # the fields of a product
    (once.groupBy("shard", "term").agg(F.count("product_id").alias("products"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/terms"))


def _lists(spark, path: str, kind: str, terms: list[str]) -> DataFrame:
    """Rows of the terms: only their shards are listed, and of these only the
    row groups that may hold a term are read."""
    known = sorted({t.lower() for t in terms})
    shards = [r[0] for r in spark.createDataFrame([(t,) for t in known], "term string").select(_shard(F.col("term"))).distinct().collect()]
    return spark.read.parquet(f"{path}/{kind}").where(F.col("shard").isin(shards) & F.col("term").isin(known))


def term_frequencies(spark, path: str, terms: list[str]) -> DataFrame:
    """(term, products): how many products each of the terms occurs in."""
    return _lists(spark, path, "terms", terms).select("term", "products")


def search_index(spark, path: str, terms: list[str], weights: dict[str, int] | None = None) -> DataFrame:
    """T2 (T1 with equal weights of name and description): product_id and
    score = sum of weight * hits, from the terms' lists only. Fields without a weight don't count."""
    weights = weights or FIELD_WEIGHT
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return (_lists(spark, path, "lists", terms).where(F.col("field").isin(list(weights)))
            .groupBy("product_id").agg(F.sum(F.col("hits") * weight[F.col("field")]).cast("bigint").alias("score")))


def validate_products(req: DataFrame) -> DataFrame:
    """P10: rule checks; ``reasons`` lists every failed rule in fixed order."""
    price = F.col("price")
    int_digits = F.length(F.floor(F.abs(price)).cast("bigint").cast("string"))
    cents_exact = (F.round(price * 100) == price * 100)
    rules = [
        ("name_blank", F.coalesce(F.length(F.trim(F.col("name"))) == 0, F.lit(True))),
        ("name_too_long", F.coalesce(F.length(F.col("name")) > 100, F.lit(False))),
        ("description_too_long", F.coalesce(F.length(F.col("description")) > 1000, F.lit(False))),
        ("price_missing", price.isNull()),
        ("price_below_min", F.coalesce(price < 0.01, F.lit(False))),
        ("price_digits", F.coalesce((int_digits > 10) | ~cents_exact, F.lit(False))),
        ("stock_negative", F.coalesce(F.col("stock") < 0, F.lit(False))),
        ("category_missing", F.col("category_id").isNull()),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return (req.withColumn("reasons", F.array_join(failed, ","))
               .withColumn("valid", F.size(failed) == 0))


def validate_cart_lines(lines: DataFrame) -> DataFrame:
    """sku/name non-blank, price non-null, quantity >= 1."""
    rules = [
        ("sku_blank", F.coalesce(F.length(F.trim(F.col("sku").cast("string"))) == 0, F.lit(True))),
        ("name_blank", F.coalesce(F.length(F.trim(F.col("name"))) == 0, F.lit(True))),
        ("price_missing", F.col("price").isNull()),
        ("quantity_below_one", F.coalesce(F.col("quantity") < 1, F.lit(True))),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return lines.withColumn("reasons", F.array_join(failed, ",")).withColumn("valid", F.size(failed) == 0)


def validate_users(users: DataFrame) -> DataFrame:
    """Username 3-50 characters, e-mail shape, password >= 8 (when given)."""
    email_ok = F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    rules = [
        ("username_length", ~F.coalesce(F.length("username").between(3, 50), F.lit(False))),
        ("email_invalid", ~F.coalesce(email_ok, F.lit(False))),
    ]
    if "password" in users.columns:
        rules.append(("password_short", F.coalesce(F.length("password") < 8, F.lit(True))))
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return users.withColumn("reasons", F.array_join(failed, ",")).withColumn("valid", F.size(failed) == 0)


def categories(region: DataFrame, nation: DataFrame) -> DataFrame:
    """Category table: regions are roots, nations their children."""
    roots = region.select(F.col("r_regionkey").cast("bigint").alias("category_id"),
                          F.col("r_name").alias("name"), F.lit(None).cast("bigint").alias("parent_id"))
    kids = nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("category_id"),
                         F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("parent_id"))
    return roots.unionByName(kids)


#: Rounds after which every chain of less than 2 ** TREE_ROUNDS categories has ended.
TREE_ROUNDS = 40


def category_ancestry(cats: DataFrame) -> DataFrame:
    """Every category (category_id, name, parent_id) with level (roots: 1),
    path (names from the root) and status: ``ok``, ``orphan`` (it or an
    ancestor names a parent that doesn't exist) or ``loop`` (it is its own
    ancestor, or below one that is); level and path only where it is ok.

    Pointer doubling: each category keeps the ancestor 2**k steps above it and
    the names in between; a round joins that ancestor's own pointer, which
    doubles k. So a tree of depth d takes log2(d) joins, each written to
    shared storage. A chain that hasn't ended when the rounds pass the number
    of categories runs in a loop. A category id that occurs twice raises an
    error; a null id is an orphan."""
    from ..sources.shared import materialize

    cats = cats.select("category_id", "name", "parent_id")
    total = cats.count()
    twice = F.raise_error(F.concat(F.lit("category tree has a loop or repeated id at "), F.col("category_id").cast("string")))
    known = (cats.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
             .select(F.when(F.col("_n") > 1, twice.cast("bigint")).otherwise(F.col("category_id")).alias("_k")))
    node = (cats.join(known, F.col("parent_id") == F.col("_k"), "left")
            .withColumn("_missing", (F.col("parent_id").isNotNull() & F.col("_k").isNull()) | F.col("category_id").isNull())
            # _up: the ancestor not yet passed; _names: those passed, nearest first
            .select("category_id", "name", "parent_id", F.when(~F.col("_missing"), F.col("parent_id")).alias("_up"), F.array("name").alias("_names"),
                    F.lit(1).alias("_steps"), F.col("_missing").alias("_orphan")))
    node = materialize(node, "category-pointers")
    for k in range(TREE_ROUNDS):
        if 2 ** k > total or node.where("_up IS NOT NULL").isEmpty():
            break
        above = node.select(F.col("category_id").alias("_a"), F.col("_up").alias("_up2"), F.col("_names").alias("_names2"), F.col("_steps").alias("_steps2"), F.col("_orphan").alias("_orphan2"))
        node = materialize(node.join(above, F.col("_up") == F.col("_a"), "left").select(
            "category_id", "name", "parent_id", F.col("_up2").alias("_up"), F.concat("_names", F.coalesce("_names2", F.expr("cast(array() as array<string>)"))).alias("_names"),
            (F.col("_steps") + F.coalesce("_steps2", F.lit(0))).alias("_steps"), (F.col("_orphan") | F.coalesce("_orphan2", F.lit(False))).alias("_orphan")), "category-pointers")
    status = F.when(F.col("_up").isNotNull(), "loop").when(F.col("_orphan"), "orphan").otherwise("ok")
    return node.withColumn("status", status).select(
        "category_id", "name", "parent_id", F.when(F.col("status") == "ok", F.col("_steps")).alias("level"),
        F.when(F.col("status") == "ok", F.array_join(F.reverse("_names"), " > ")).alias("path"), "status")


def category_tree(cats: DataFrame) -> DataFrame:
    """Level (roots: 1) and path of every category below a root, of any
    depth. Loops and repeated ids raise an error; categories whose root is
    missing are left out (``category_ancestry`` reports both)."""
    tree = category_ancestry(cats)
    loop = F.raise_error(F.concat(F.lit("category tree has a loop at "), F.col("category_id").cast("string"))).cast("int")
    return (tree.where("status <> 'orphan'")
            .select("category_id", "name", "parent_id", F.when(F.col("status") == "loop", loop).otherwise(F.col("level")).alias("level"), "path"))


def duplicate_siblings(items: DataFrame, id_col: str, name_col: str, parent_col: str) -> DataFrame:
    """Rows sharing (name, parent) with another id. Counted per key
    (one aggregate) instead of a self theta-join, so a hot name never
    produces pairs."""
    k = items.groupBy(name_col, parent_col).agg(F.countDistinct(id_col).alias("_n")).where(F.col("_n") > 1)
    return items.join(k.select(name_col, parent_col), [name_col, parent_col], "left_semi")


def count_per_category(p: DataFrame) -> DataFrame:
    """Products per category."""
    return p.groupBy("category_id").agg(F.count(F.lit(1)).alias("products"))


# Allowed order status transitions.
ORDER_TRANSITIONS = {("CREATED", "PAID"), ("PAID", "SHIPPED"), ("SHIPPED", "COMPLETED"),
                     ("CREATED", "CANCELLED")}


AUDIT_BLOCK = 10_000     # status changes of an order that are ordered together


def order_status_audit(status_events: DataFrame) -> DataFrame:
    """Each status change of an order against the allowed transitions
    CREATED -> PAID -> SHIPPED -> COMPLETED (CREATED -> CANCELLED); the first
    must be CREATED. The previous status is a lag by blocks of ``seq``, so a
    long-lived order is never a window over its whole history, and the log is
    not joined with itself. A change whose predecessor (seq - 1) is missing
    counts as a first one."""
    from .sequences import lag_within

    cur = status_events.select("order_id", "seq", "status", "ts")
    prev = lag_within(cur, "order_id", F.floor(F.col("seq") / AUDIT_BLOCK), ["seq"], {"status": "prev_status", "seq": "prev_seq"})
    prev = prev.withColumn("prev_status", F.when(F.col("prev_seq") == F.col("seq") - 1, F.col("prev_status"))).drop("prev_seq")
    allowed = F.lit(False)
    for a, b in sorted(ORDER_TRANSITIONS):
        allowed = allowed | ((F.col("prev_status") == a) & (F.col("status") == b))
    first_ok = F.col("prev_status").isNull() & (F.col("status") == "CREATED")
    return prev.withColumn("valid", F.coalesce(first_ok | allowed, F.lit(False)))


def latest_version(models: DataFrame, name_col: str = "model_name", version_col: str = "version") -> DataFrame:
    """Newest model version per model by the maximum version string
    (lexicographic, as the reference compares names)."""
    return models.groupBy(name_col).agg(F.max(version_col).alias("latest_version"))
