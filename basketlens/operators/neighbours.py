"""Nearest items by embedding cosine, for every item against all items.

Random hyperplanes give each vector a signature in several bands. A band's
vectors are range-partitioned by signature, read as a Gray code so that
neighbours in the order differ in few bits, and each is compared with the block
of vectors that it falls in and the blocks before and after. Blocks are cut by
count, so a dense direction makes no large bucket, whatever its density: a task
holds three blocks, and a band shuffles each vector once. Only the ``n`` best of
a vector leave a band; all its bands' finds are merged.

How many bands are needed depends on the data. Some vectors, chosen by hash,
are compared with all vectors, and bands are added until the lists hold
``target`` of their true neighbours. Up to two blocks of vectors are compared
whole, which is exact.

Equal vectors are compared once. A class of equal vectors passes on its n + 1
smallest ids only, as no list can need more of them.

Vectors that are null, zero or hold null or non-finite components take no part;
an id with several vectors has its smallest; vectors must have one length; ids
without other items get no rows; extra columns play no part.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

BLOCK = 1_024          # vectors compared at once
TASK_BLOCKS = 64       # blocks of a task, about
ROUND = 8              # bands added at a time
MOST = 64              # bands at most
SAMPLE = 256           # vectors compared with all others to measure recall
BITS = 62

_FOUND = "cid long, found array<struct<cosine:double,other:long>>"


def _matrix(column) -> np.ndarray:
    """Rows of a list column, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError("embeddings differ in length")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow below
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signatures(bands: range, seed: int):
    """(band, place, cid, v) rows: each vector's place in each band's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            for band in bands:
                planes = np.random.default_rng([seed, band]).standard_normal((x.shape[1], BITS))
                gray = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for shift in (1, 2, 4, 8, 16, 32):
                    gray ^= gray >> shift
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band, np.int32)), pa.array(gray), batch.column("cid"), batch.column("v")],
                                                 names=["band", "place", "cid", "v"])
    return run


def _best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, n: int) -> pa.RecordBatch:
    """The n nearest of (others, y) for each of (ids, x), itself left out."""
    near = x @ y.T
    near[ids[:, None] == others[None, :]] = -np.inf
    k = min(n, len(others))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    real = np.isfinite(np.take_along_axis(near, top, axis=1))
    row, col = np.nonzero(real)
    col = top[row, col]
    cosine = (x[row] * y[col]).sum(axis=1)  # the same in every band, whatever the block
    found = pa.StructArray.from_arrays([pa.array(cosine), pa.array(others[col])], names=["cosine", "other"])
    edges = np.concatenate(([0], np.cumsum(real.sum(axis=1)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(edges), found)], names=["cid", "found"])


def _compare(n: int, block: int):
    """Each vector's n nearest in its block and the blocks beside it, of rows
    sorted by band and place."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, now = 0, None

        def cut() -> tuple[int, np.ndarray, np.ndarray]:
            return now, np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])

        for batch in batches:
            if not batch.num_rows:
                continue
            band, ids, x = batch.column("band").to_numpy(), batch.column("cid").to_numpy(), _matrix(batch.column("v"))
            at = 0
            while at < len(ids):
                if size == block or (size and band[at] != now):
                    yield cut()
                    held, size = [], 0
                now = int(band[at])
                end = min(at + block - size, int(np.searchsorted(band, now, side="right")))
                held.append((ids[at:end], x[at:end]))
                size += end - at
                at = end
        if size:
            yield cut()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, this = None, None
        for after in itertools.chain(blocks(batches), [None]):
            if this is not None:
                beside = [b for b in (before, this, after) if b is not None and b[0] == this[0]]
                yield _best(this[1], this[2], np.concatenate([b[1] for b in beside]), np.concatenate([b[2] for b in beside]), n)
            before, this = this, after
    return run


def _against(ids: np.ndarray, x: np.ndarray, n: int):
    """The n nearest of each task's vectors for the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _best(ids, x, batch.column("cid").to_numpy(), _matrix(batch.column("v")), n)
    return run


def _merged(found: DataFrame, n: int) -> DataFrame:
    """The n best finds of each vector, a find of several bands once."""
    one = found.select("cid", F.explode("found").alias("f")).groupBy("cid", "f.other").agg(F.max("f.cosine").alias("cosine"))
    best = Window.partitionBy("cid").orderBy(F.desc("cosine"), "other")
    return (one.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
            .groupBy("cid").agg(F.collect_list(F.struct("cosine", "other")).alias("found")))


def vector_lists(vectors: DataFrame, n: int = 10, target: float = 0.95, block: int = BLOCK, step: int = ROUND, most: int = MOST, seed: int = 17) -> tuple[DataFrame, float, int]:
    """(lists, recall, bands) of written (cid, v) rows with distinct vectors:
    lists (cid, found: at most n structs of cosine and other), the share of the
    sample's true neighbours in them, and the bands that took."""
    spark = vectors.sparkSession
    rows = vectors.count()
    few = rows <= 2 * block
    if few:
        step = most = 1
    chosen = vectors.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow()
    truth: dict[int, set[int]] = {}
    if chosen.num_rows:
        ids, x = chosen.column("cid").to_numpy(), _matrix(chosen.column("v"))
        near = _merged(vectors.mapInArrow(_against(ids, x, n), _FOUND), n)
        truth = {r.cid: {f.other for f in r.found} for r in near.collect()}  # SAMPLE rows of n at most
    sample = spark.createDataFrame([(i,) for i in truth], "cid long")
    lists, recall, bands = None, 0.0, 0
    while True:
        new = range(bands, min(bands + step, most))
        parts = 1 if few else max(min(len(new), int(rows * len(new) // block) or 1), -(-rows * len(new) // (TASK_BLOCKS * block)))
        placed = vectors.mapInArrow(_signatures(new, seed), "band int, place long, cid long, v array<double>")
        found = placed.repartitionByRange(parts, "band", "place", "cid").sortWithinPartitions("band", "place", "cid").mapInArrow(_compare(n, block), _FOUND)
        lists = materialize(_merged(found if lists is None else lists.unionByName(found), n), "vector-lists")
        bands = new.stop
        got = {r.cid: {f.other for f in r.found} for r in lists.join(F.broadcast(sample), "cid").collect()}
        wanted = sum(map(len, truth.values()))
        recall = sum(len(truth[i] & got.get(i, set())) for i in truth) / wanted if wanted else 1.0
        if recall >= target or few:
            return lists, recall, bands
        if bands >= most:
            warnings.warn(f"{bands} bands found {recall:.3f} of the sample's true neighbours, {target} were asked for")
            return lists, recall, bands


def all_neighbours(emb: DataFrame, n: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(item_id, neighbour, cosine, rank from 1): each item's ``n`` nearest other
    items by cosine, ties to the smaller id. ``options`` go to ``vector_lists``."""
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    items = (emb.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
             .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole & F.exists("v", lambda c: c != 0))
             .groupBy("id").agg(F.min("v").alias("v")))
    in_class = Window.partitionBy("v").orderBy("id")
    items = materialize(items, "item-vectors")
    smallest = items.withColumn("_r", F.row_number().over(in_class)).where(F.col("_r") <= n + 1)
    classes = materialize(smallest.groupBy("v").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids")), "vector-classes")
    lists = vector_lists(classes.select("cid", "v"), n, **options)[0]

    ids = classes.select(F.col("cid").alias("other"), "ids")
    outside = lists.select("cid", F.explode("found").alias("f")).select("cid", "f.cosine", "f.other").join(ids, "other").select("cid", "cosine", F.explode("ids").alias("neighbour"))
    inside = classes.where(F.size("ids") > 1).select("cid", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    best = Window.partitionBy("cid").orderBy(F.desc(F.round("cosine", 12)), "neighbour")
    near = (outside.unionByName(inside).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n + 1)  # one may be the item itself
            .groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("_r", "neighbour", "cosine"))).alias("near")))
    alone = classes.where(F.size("ids") == 1).select(F.col("cid").alias("id"), "cid")
    copies = items.join(classes.where(F.size("ids") > 1).select("v", "cid"), "v").select("id", "cid")
    own = alone.unionByName(copies).join(near, "cid")
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, n)
    return (own.select(F.col("id").alias("item_id"), F.posexplode(others).alias("at", "x"))
            .select("item_id", "x.neighbour", "x.cosine", (F.col("at") + 1).cast("long").alias("rank")))
