"""A Merkle manifest of a dataset: one root for all rows, and for each row the
digests that prove it.

Rows are leaves, ranked by id within their group. While a group has several
nodes, every FANOUT consecutive ones (the last run may be shorter, even one)
become the sha256 of their concatenated hex digests; the node that remains is
the group's subroot, and the subroots, in the order of their groups, make the
root in the same way.

Nodes are labelled by the interval [lo, hi) of leaf ranks that they cover. A
node of level L covers FANOUT**L ranks from a multiple of it, so a label falls
into the one bucket lo div FANOUT**L of its level, and a node is inside an
ancestor if their buckets at the ancestor's level agree and the interval
contains its own. ``paths`` attaches ancestors by such joins, from the top
down: a node's siblings are the parts of its parent outside the node's own
interval (those that end before it, and those that begin after it), and its
path is its siblings followed by the path of its parent. Only nodes are
joined level by level, N / FANOUT**L of them; leaves join once, with level 1.

All of it is DataFrame code. Ranks come from a written range-partitioned
table (``ranked``), where a group's rows may span any number of partitions,
so a hot group is never one task. Every level is a written table.

Edge cases: null groups sort first; null ids rank first in their group; rows
that repeat an id are ordered by digest, identical rows stay identical leaves;
a single leaf is its own subroot and a single subroot is the root, with no
siblings (proof: sha256 of the empty string); an empty table gives an empty
manifest; extra columns don't matter, only the named ones are hashed; texts
are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 16


def encoded(col: Column) -> Column:
    """``-`` for null, else the value as text after its UTF-8 byte count and a colon."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    """sha256 (lowercase hex) of the encoded values, concatenated."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(col: Column) -> Column:
    """A non-null text that sorts as the group does, null first."""
    return F.when(col.isNull(), "-").otherwise(F.concat(F.lit("="), col.cast("string")))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` (grp, ...) with ``rank``, the position (from 0) in its group by
    ``order``, and ``n``, the group's size.

    Rows are range-partitioned by (grp, order) and written with their position
    in the partition; a rank is that position plus the group's rows in earlier
    partitions (one summary row for each group and partition)."""
    keys = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_spread", F.monotonically_increasing_id())  # only tells identical rows apart
    placed = spread.repartitionByRange(parts, *keys, "_spread").sortWithinPartitions(*keys, "_spread").drop("_spread")
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), f"{name}-placed")
    runs = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("grp").alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(group).alias("n"))
    return (placed.join(runs, (F.col("grp") == F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_g", "_p", "_shift", "_part", "_at"))


def _as_nodes(leaves: DataFrame) -> DataFrame:
    return leaves.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "digest")


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The nodes above ``leaves`` (grp, rank, n, digest), a written table for
    each level from 1: grp, lo, hi, n, digest, kids (its children's lo, hi and
    digest in order). A group has nodes up to its subroot, which covers [0, n)."""
    out: list[DataFrame] = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = _as_nodes(leaves)
    while most > FANOUT ** len(out):  # the largest group has several nodes
        level = len(out) + 1
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))  # FANOUT at most
        nodes = (nodes.where(F.col("n") > FANOUT ** (level - 1)).groupBy("grp", F.floor(F.col("lo") / FANOUT ** level).alias("_bucket"))
                 .agg(kids.alias("kids"), F.min("n").alias("n")))
        nodes = nodes.select("grp", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n",
                             F.sha2(F.concat_ws("", F.col("kids")["digest"]), 256).alias("digest"), "kids")
        out.append(materialize(nodes, f"{name}-level{level}"))
        nodes = out[-1].drop("kids")
    return out


def subroots(leaves: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """The node of every group that covers it all: grp, digest."""
    nodes = reduce(DataFrame.unionByName, [_as_nodes(leaves), *[t.drop("kids") for t in tree]])
    return nodes.where("lo = 0 AND hi = n").select("grp", "digest")


def _below(nodes: DataFrame, parents: DataFrame, tops: DataFrame, level: int) -> DataFrame:
    """``nodes`` of a level (grp, lo, hi, n, ...) with the subroot and path of
    the group's own node (``tops``) if they cover their group, else with their
    siblings (digests to the left, to the right) and their parent's path."""
    up = parents.select(F.col("grp").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), "subroot")
    width = FANOUT ** (level + 1)
    inside = ((F.col("grp") == F.col("_g")) & (F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width))
              & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi")))
    # the parent's interval without the node's own: what ends before it, what begins after it
    left = F.concat_ws("", F.transform(F.filter("_kids", lambda k: k["hi"] <= F.col("lo")), lambda k: k["digest"]))
    right = F.concat_ws("", F.transform(F.filter("_kids", lambda k: k["lo"] >= F.col("hi")), lambda k: k["digest"]))
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    part = F.col("hi") - F.col("lo") < F.col("n")
    below = nodes.where(part).join(up, inside).withColumn("path", F.concat(own, "_path")).drop("_g", "_lo", "_hi", "_kids", "_path")
    return below.unionByName(_top(nodes.where(~part), tops))


def _top(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes that cover their group, with its subroot and path."""
    return nodes.join(tops.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).drop("_g")


def paths(leaves: DataFrame, tree: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """``leaves`` (grp, rank, n, ...) with subroot and path; ``tops`` (grp,
    subroot, path) gives the path above each group's own node."""
    above = None
    for level in range(len(tree), 0, -1):
        nodes = tree[level - 1]
        above = materialize(_top(nodes, tops) if above is None else _below(nodes, above, tops, level), f"{name}-paths{level}")
    leaves = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)
    return (_top(leaves, tops) if above is None else _below(leaves, above, tops, 0)).drop("lo", "hi")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """The leaves with their proofs, and the root (null without leaves).

    ``leaves``: id, grp (see ``group_key``), digest and any other columns,
    best a materialized table. Adds rank, n, subroot and path (pairs of the
    digests to the left and right, level by level up to the root)."""
    placed = materialize(ranked(leaves, ["id", "digest"], "merkle"), "merkle-leaves")
    tree = levels(placed, "merkle")
    groups = materialize(subroots(placed, tree).select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest"), "merkle-subroots")
    top = materialize(ranked(groups, ["id"], "merkle-groups"), "merkle-group-leaves")
    top_tree = levels(top, "merkle-groups")
    root = subroots(top, top_tree).first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    summit = subroots(top, top_tree).select("grp", F.col("digest").alias("subroot"), nothing.alias("path"))
    tops = paths(top, top_tree, summit, "merkle-groups").select(F.col("id").alias("grp"), F.col("digest").alias("subroot"), "path")
    return paths(placed, tree, materialize(tops, "merkle-tops"), "merkle"), root and root["digest"]


def check(rows: DataFrame, columns: list[str], id_col: str, group_col: str, tampered: Column, altered: dict[str, Column]) -> DataFrame:
    """The proof of every row of ``rows``, checked against a copy in which the
    ``tampered`` rows have the ``altered`` columns: id, leaf, subroot, root,
    proof_sha256 (of all sibling digests), folded_root, verified."""
    now = [altered.get(c, F.col(c)) for c in columns]
    leaves = rows.select(F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("grp"), row_digest([F.col(c) for c in columns]).alias("digest"),
                         F.when(tampered, row_digest(now)).alias("changed"))
    proofs, root = manifest(materialize(leaves, "merkle-digests"))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    out = proofs.select("id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
                        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
