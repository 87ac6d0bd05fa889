"""Mixing sources to target weights by Pfair scheduling.

The documents of each source are numbered in a pseudo-random but fixed order
and cut into blocks. A source with share w of the slots owes its block i
(from 0) a slot in the window from its release, floor(i / w), to its
deadline, ceil((i + 1) / w). Each slot goes to the released block with the
earliest deadline. The shares sum to one slot a slot, so all deadlines are
met, and after any number of slots each source has had less than one block
more or less than its share.

Shares are integers, weight / total in parts of 2 ** 60 (double precision),
and releases and deadlines are exact quotients of them, so the bound holds
against the weights at any length and for any number of sources. The
schedule is a fold over all blocks in one task, which compares the sources
at each; it keeps the state at every CHUNK-th block, from which the chunks
are then made in parallel. It takes some 50 microseconds a block, with 20
sources. Blocks have the rows that the caller names, at any size of the table,
so a document's place never hangs on a switch; a caller who would rather bound
the fold can take larger blocks from ``block_size``. All else is joins and
aggregates; nothing runs in Python.

With a ``resolution`` shares are rounded to 1 / resolution instead (one part
at least), so the schedule repeats and only one period of it, of about so
many slots, is made. Then the bound holds against the rounded shares only.

Numbering a source never brings its documents to one task: they are dealt to
buckets by a hash, buckets are counted with partial sums, and a document's
number is its bucket's offset and its rank in the bucket.

The mix keeps every row once. When a source runs out, the others go on within
their own windows; slots for which none has a block stay empty. A source without a
weight, or whose weight is null, not finite or not positive, has no share:
its blocks get no slot and follow the others.

Edge cases: null is a source like any other; rows that repeat an id, and
null ids, get numbers of their own; an empty table gives an empty result;
extra columns are kept, but one with the name of an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS

RESOLUTION = 1000        # slots of a period of rounded shares, about; so many sources at most
CHUNK = 1_000            # blocks between two kept states of the exact schedule
PARTS = float(1 << 60)   # of the exact shares, about
NEVER = (1 << 63) - 1    # release of a source that has run out
BLOCK_ROWS = 64          # documents of one source in a slot
MAX_BLOCKS = 1_000_000   # of a table, about
BUCKET_ROWS = 2_000      # documents of a numbering bucket, about,
BUCKET_DIGITS = 4        # with at most 16 ** 4 buckets a source: their offsets are summed in one task a source


def temperature_weights(df: DataFrame, exponent: float, source_col: str = "source") -> DataFrame:
    """(source, weight): the size of each source to a power; below 1 raises
    the shares of small sources."""
    return df.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(exponent)).alias("weight"))


def block_size(df: DataFrame, least: int = BLOCK_ROWS) -> int:
    """Documents of a block that keep ``df`` to about MAX_BLOCKS blocks, at
    least ``least``: for callers that bound the fold, as the mix changes with it."""
    return max(least, -(-df.count() // MAX_BLOCKS))


def shares(weights: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """One row (all, period): every source with a share and the parts of a
    period it gets, as an array sorted by source, and the sum of the parts.
    The array holds at most RESOLUTION sources; more raise an error."""
    w = F.col("weight").cast("double")
    good = weights.where((w > 0) & (w < float("inf"))).groupBy("source").agg(F.sum(w).alias("weight")).limit(resolution + 1)
    one = good.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("found"))
    one = one.where(F.when(F.size("found") > resolution, F.raise_error(F.lit(f"more than {resolution} sources"))).otherwise(F.size("found") > 0))
    total = F.aggregate("found", F.lit(0.0), lambda sum_, x: sum_ + x["weight"])
    one = one.withColumn("total", total).select(F.transform("found", lambda x: F.struct(
        x["source"].alias("source"), F.greatest(F.lit(1), F.round(x["weight"] / F.col("total") * resolution)).cast("long").alias("parts"))).alias("all"))
    return one.withColumn("period", F.aggregate("all", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["parts"]))


def period_schedule(one: DataFrame) -> DataFrame:
    """One period of the schedule of ``shares``, a row for every slot: source,
    parts, period, turn, and slot0, release0, deadline0. One row is folded
    over the slots; its arrays hold an entry for each source and slot (at
    most 2 * RESOLUTION slots)."""
    def step(state: Column, slot: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            done, parts = F.element_at(state["done"], i + 1), x["parts"]
            return F.struct(F.ceil((done + 1) * F.col("period") / parts).cast("long").alias("deadline"), i.alias("i"), done.alias("turn"),
                            F.floor(done * F.col("period") / parts).cast("long").alias("release"))

        due = F.array_min(F.filter(F.transform("all", window), lambda x: x["release"] <= slot))
        return F.struct(
            F.transform(state["done"], lambda d, j: F.when(j == due["i"], d + 1).otherwise(d)).alias("done"),
            F.concat(state["out"], F.array(F.struct(slot.alias("slot"), due["i"].alias("i"), due["turn"].alias("turn"), due["release"].alias("release"), due["deadline"].alias("deadline")))).alias("out"))

    start = F.struct(F.transform("all", lambda x: F.lit(0).cast("long")).alias("done"),
                     F.expr("cast(array() as array<struct<slot:bigint,i:int,turn:bigint,release:bigint,deadline:bigint>>)").alias("out"))
    plan = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step)["out"]
    return (one.select("all", "period", F.explode(plan).alias("x"))
            .select(F.element_at("all", F.col("x.i") + 1)["source"].alias("source"), F.element_at("all", F.col("x.i") + 1)["parts"].alias("parts"), "period",
                    F.col("x.turn").alias("turn"), F.col("x.slot").alias("slot0"), F.col("x.release").alias("release0"), F.col("x.deadline").alias("deadline0")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _entry(x: Column, turn: Column, release: Column, rest: Column) -> Column:
    """State of source ``x`` before its block ``turn``: release is
    turn * period / parts, rest its remainder; next and deadline follow."""
    more = rest + x["r"]
    over = (more >= x["parts"]).cast("long")
    after = F.when(release > 1 << 61, release + 1).otherwise(release + x["q"] + over)  # slots end before 2 ** 63
    return _let(F.struct(after.alias("next"), (more - over * x["parts"]).alias("rest")), lambda n: F.when(
        turn < x["blocks"], F.struct(turn.alias("turn"), release.alias("release"), (n["next"] + (n["rest"] > 0).cast("long")).alias("deadline"), n["next"].alias("next"), n["rest"].alias("rest"))
    ).otherwise(F.struct(turn.alias("turn"), *(F.lit(NEVER).alias(c) for c in ("release", "deadline", "next")), F.lit(0).cast("long").alias("rest"))))


def _place(state: Column, out: Column | None = None) -> Column:
    """The state after one more block: of the released blocks the one with the
    earliest deadline, in the first free slot in which a block is released."""
    def go(slot: Column) -> Column:
        ready = F.filter(F.transform(state["at"], lambda e, i: F.struct(e["deadline"].alias("deadline"), i.alias("i"), e["turn"].alias("block"), e["release"].alias("release"))), lambda x: x["release"] <= slot)
        return _let(F.array_min(ready), lambda due: place(slot, due))

    def place(slot: Column, due: Column) -> Column:
        at = F.transform(state["at"], lambda e, i: F.when(i == due["i"], _entry(F.element_at(F.col("all"), i + 1), e["turn"] + 1, e["next"], e["rest"])).otherwise(e))
        new = F.struct((slot + 1).alias("slot"), at.alias("at"))
        if out is None:
            return new
        row = F.struct(due["i"].alias("i"), due["block"].alias("block"), slot.alias("slot"), due["release"].alias("release"), due["deadline"].alias("deadline"))
        return F.struct(new.alias("state"), F.concat(out, F.array(row)).alias("out"))

    return _let(F.greatest(state["slot"], F.array_min(F.transform(state["at"], lambda e: e["release"]))), go)


def exact_schedule(weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, block, slot, release, deadline) of every block of ``blocks``
    (source, blocks) whose source has a share. The states of the fold are one
    row: an entry for each source and CHUNK blocks."""
    w, zero = F.col("weight").cast("double"), F.lit(0).cast("long")
    good = weights.where((w > 0) & (w < float("inf"))).groupBy("source").agg(F.sum(w).alias("weight"))
    sizes = blocks.select(F.col("source").alias("s"), "blocks")
    found = good.join(sizes, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "weight", F.coalesce("blocks", zero).alias("blocks"))
    one = found.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight", "blocks"))).alias("found"), F.max("weight").alias("top"), F.sum("blocks").alias("n")).where("n > 0")
    one = one.withColumn("total", F.aggregate("found", F.lit(0.0), lambda sum_, x: sum_ + x["weight"] / F.col("top")))
    one = one.withColumn("found", F.transform("found", lambda x: F.struct(
        x["source"].alias("source"), x["blocks"].alias("blocks"), F.greatest(F.lit(1).cast("long"), F.floor(x["weight"] / F.col("top") / F.col("total") * PARTS).cast("long")).alias("parts"))))
    one = one.withColumn("period", F.aggregate("found", zero, lambda sum_, x: sum_ + x["parts"]))
    # sources without a block need no slot, but have their part of the period
    one = one.select("n", F.transform(F.filter("found", lambda x: x["blocks"] > 0), lambda x: F.struct(
        x["source"].alias("source"), x["blocks"].alias("blocks"), x["parts"].alias("parts"),
        F.call_function("div", F.col("period"), x["parts"]).alias("q"), (F.col("period") % x["parts"]).alias("r"))).alias("all"))

    def steps(chunk: Column) -> Column:
        return F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("n") - chunk * CHUNK))

    start = F.struct(zero.alias("slot"), F.transform("all", lambda x: _entry(x, zero, zero, zero)).alias("at"))
    one = one.withColumn("start", start).withColumn("none", F.filter(F.array("start"), lambda x: F.lit(False)))
    kept = F.aggregate(
        F.sequence(zero, F.floor((F.col("n") - 1) / CHUNK)), F.struct(F.col("start").alias("state"), F.col("none").alias("kept")),
        lambda acc, chunk: F.struct(F.aggregate(steps(chunk), acc["state"], lambda state, _: _place(state)).alias("state"), F.concat(acc["kept"], F.array(acc["state"])).alias("kept")))["kept"]
    chunks = one.select("all", "n", F.posexplode(kept).alias("chunk", "state"))
    chunks = chunks.repartition(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    empty = F.expr("cast(array() as array<struct<i:int,block:bigint,slot:bigint,release:bigint,deadline:bigint>>)")
    rows = F.aggregate(steps(F.col("chunk")), F.struct(F.col("state"), empty.alias("out")), lambda acc, _: _place(acc["state"], acc["out"]))["out"]
    return (chunks.select("all", F.explode(rows).alias("x"))
            .select(F.element_at("all", F.col("x.i") + 1)["source"].alias("source"), *(F.col("x")[c].alias(c) for c in ("block", "slot", "release", "deadline"))))


def numbered(df: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, source, nr): each row of ``df`` as a struct and its number (from
    0) in its source, in the order of md5(id), id. Rows are shuffled once, by
    source and bucket."""
    n = df.count()
    digits = min(BUCKET_DIGITS, max(0, math.ceil(math.log(max(1, n / BUCKET_ROWS), 16))))
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # a key that is never null: rows dealt by it for the ranks stay where they are for the join
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).alias("source"), key.alias("key"), F.col(id_col).alias("id"), mark.alias("mark"))
    d = d.withColumn("bucket", F.substring("mark", 1, digits) if digits else F.lit(""))
    sizes = d.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = sizes.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset"))
    inside = Window.partitionBy("key", "bucket").orderBy("mark", F.asc_nulls_first("id"))
    ranked = d.withColumn("rank", F.row_number().over(inside))
    return ranked.join(offsets, ["key", "bucket"]).select("row", "source", (F.col("offset") + F.col("rank") - 1).alias("nr"))


def _blocks(df: DataFrame, id_col: str, source_col: str, block_rows: int) -> DataFrame:
    """(row, source, block, place)."""
    return numbered(df, id_col, source_col).select("row", "source", F.floor(F.col("nr") / block_rows).cast("long").alias("block"), (F.col("nr") % block_rows).cast("int").alias("place"))


def _scheduled_exactly(df: DataFrame, weights: DataFrame, id_col: str, source_col: str, block_rows: int) -> DataFrame:
    blocks = df.groupBy(F.col(source_col).alias("source")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    few = (blocks.agg(F.sum("blocks")).first()[0] or 0) <= BROADCAST_IDS
    plan = exact_schedule(weights, blocks).withColumnsRenamed({"source": "s", "block": "b"})
    rows = _blocks(df, id_col, source_col, block_rows)
    rows = rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["s"]) & (rows["block"] == plan["b"]), "left")
    return rows.select("row", "source", "block", "place", "slot", "release", "deadline")


def scheduled(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, resolution: int | None = None) -> DataFrame:
    """(row, source, block, place, slot, release, deadline): each row of
    ``df`` as a struct; its block and its place in it; the slot, release and
    deadline of the block. The mix is the order (slot nulls last, source,
    block, place)."""
    if resolution is None:
        return _scheduled_exactly(df, weights, id_col, source_col, block_rows)
    plan = period_schedule(shares(weights, resolution)).withColumnRenamed("source", "s")
    per = plan.select("s", "parts", "period").distinct()
    rows = _blocks(df, id_col, source_col, block_rows)
    # at most RESOLUTION rows, and at most 2 * RESOLUTION slots
    rows = rows.join(F.broadcast(per), rows["source"].eqNullSafe(per["s"]), "left").drop("s")
    rows = rows.withColumn("k", F.col("block") % F.col("parts"))
    plan = plan.select("s", "turn", "slot0", "release0", "deadline0")
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["s"]) & (rows["k"] == plan["turn"]), "left")
    base = F.floor(F.col("block") / F.col("parts")) * F.col("period")
    return rows.select("row", "source", "block", "place", *((base + F.col(f"{c}0")).cast("long").alias(c) for c in ("slot", "release", "deadline")))


def mix(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, resolution: int | None = None) -> DataFrame:
    """``df`` (all columns) with block, place, slot, release and deadline, as
    ``scheduled`` gives them. Columns of ``df`` with these names are replaced."""
    new = ["block", "place", "slot", "release", "deadline"]
    out = scheduled(df, weights, id_col, source_col, block_rows, resolution)
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in new), *new)


def in_order(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows of ``scheduled`` as sorted range partitions: part files, taken
    in the order of their names, hold the mix."""
    key = [F.asc_nulls_last("slot"), F.asc_nulls_first("source"), F.asc("block"), F.asc("place")]
    return rows.repartitionByRange(partitions, *key).sortWithinPartitions(*key).select("row.*")
